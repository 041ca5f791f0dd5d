"""Quality rules: counts of every text, and robust multivariate outliers per language and source.

The statistics of a text become a vector; the minimum covariance determinant (MCD) estimates centre
and scatter of each group from its most central three quarters, and texts far away by Mahalanobis
distance are rejected. Counting, concentration steps and distances are DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import fits_broadcast
from tidemark.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: The vector, and for each part the least standard deviation that counts as ordinary spread. Most texts have
#: no symbol and no repeated line, so their spread alone would reject the first that has one.
FEATURES = {"log_words": 1.0, "word_length": 0.4, "symbol_rate": 0.05, "log_dup_lines": 0.8, "repeat_rate": 0.12}
CORE = 0.75  # share of a group that the estimate rests on
CORE_FACTOR = 1.41  # makes the core's covariance that of the whole: CORE / P(chi2 with 7 degrees <= 75 % point of chi2 with 5)
CUTOFF = 36.0  # squared distance; chi-square with 5 degrees of freedom passes it once in a million
STEPS = 3  # concentration steps
MIN_GROUP = 100  # smaller groups take the estimate of their language, small languages that of all texts
SALTS = 64


def text_counts(documents: DataFrame, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """``_doc`` (the columns ``carry`` of the row), ``lang, source`` and the counts of every text; a null text counts as empty.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word that
    equal an earlier line), ``n_repeat_words`` (words in 3-word windows that occur twice or more, the first included).
    Windows are compared by 64-bit hash; a text is sorted once, so the cost is that of its length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.struct(*carry).alias("_doc"), "lang", "source", text.alias("_text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"),
    )
    n = F.size("_words")
    last = F.greatest(n - 2, F.lit(0))
    windows = F.transform(F.slice("_words", F.lit(1), last), lambda w, i: F.struct(
        F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2)).alias("h"), i.alias("i")))
    rows = rows.select(
        "_doc", "lang", "source", n.cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("_w"),
    )
    same = lambda i, w: F.coalesce(F.get(F.col("_w"), i)["h"] == w["h"], F.lit(False))
    again = F.filter("_w", lambda w, i: same(i - 1, w) | same(i + 1, w))
    rows = rows.withColumn("_again", F.sort_array(F.transform(again, lambda w: w["i"]))).drop("_w")
    # Each repeated window covers three words, less those that the next repeated window covers.
    covered = F.aggregate(
        F.transform("_again", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_again"), i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, c: total + c,
    )
    return rows.withColumn("n_repeat_words", covered).drop("_again")


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(words), F.col("word_chars") / words, F.least(F.col("n_symbols") / words, F.lit(3.0)),
        F.log1p(F.col("n_dup_lines").cast("double")), F.col("n_repeat_words") / words,
    ]


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _with(stats: DataFrame, parameters: DataFrame) -> DataFrame:
    """Rows with the parameters of their group; groups too many to broadcast are joined by group and salt."""
    if fits_broadcast(parameters, rows=200_000):
        return stats.join(F.broadcast(parameters), "_group")
    salted = parameters.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = stats.withColumn("_salt", F.pmod(F.xxhash64(*[f"_x{i}" for i in range(len(FEATURES))]), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["_group", "_salt"]).drop("_salt")


def _whitened(names: list[str]) -> Column:
    """Squared length of ``L^-1 (x - m)``: columns ``_m{i}`` and the lower triangle ``_l{i}{j}``."""
    z: list[Column] = []
    for i in range(len(names)):
        rest = [F.col(f"_l{i}{j}") * z[j] for j in range(i)]
        z.append((F.col(f"_x{i}") - F.col(f"_m{i}") - (_total(rest) if rest else F.lit(0.0))) / F.col(f"_l{i}{i}"))
    return _total([v * v for v in z])


def _triangle(groups: DataFrame, floors: list[float]) -> DataFrame:
    """Cholesky factor of the scaled covariance, the ordinary spread added to its diagonal."""
    d = len(floors)
    for i in range(d):
        for j in range(i + 1):
            value = F.coalesce(F.col(f"_c{i}{j}"), F.lit(0.0)) * CORE_FACTOR
            if i == j:
                value = value + floors[i] ** 2
            for k in range(j):
                value = value - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            value = F.sqrt(F.greatest(value, F.lit(floors[i] ** 2))) if i == j else value / F.col(f"_l{j}{j}")
            groups = groups.withColumn(f"_l{i}{j}", value)
    return groups.select("_group", *[f"_m{i}" for i in range(d)], *[f"_l{i}{j}" for i in range(d) for j in range(i + 1)])


def mcd(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """Centre and Cholesky factor of each ``_group`` of vectors ``_x0.._x4`` by concentration steps.

    The start is the median and the median absolute deviation of each part. Every step keeps the rows within the
    group's 75 % point of the squared distance and estimates anew. Aggregates only: a hot group is added up in every task.
    """
    floors = list(FEATURES.values())
    d = len(floors)
    middle = stats.groupBy("_group").agg(*[F.percentile_approx(f"_x{i}", 0.5, 10_000).alias(f"_m{i}") for i in range(d)])
    middle = materialize(middle, "mcd-middle")
    away = [F.percentile_approx(F.abs(F.col(f"_x{i}") - F.col(f"_m{i}")), 0.5, 10_000).alias(f"_a{i}") for i in range(d)]
    spread = _with(stats, middle).groupBy("_group", *[f"_m{i}" for i in range(d)]).agg(*away)
    zero = {f"_l{i}{j}": F.lit(0.0) for i in range(d) for j in range(i)}
    wide = {f"_l{i}{i}": F.greatest(F.col(f"_a{i}") * 1.4826, F.lit(floors[i])) for i in range(d)}
    model = spread.withColumns(zero | wide)
    model = materialize(model.drop(*[f"_a{i}" for i in range(d)]), "mcd-start")
    for _ in range(steps):
        far = _with(stats, model).withColumn("_d", _whitened(list(FEATURES)))
        edge = far.groupBy("_group").agg(F.percentile_approx("_d", CORE, 10_000).alias("_edge"))
        core = _with(far, materialize(edge, "mcd-edge")).filter("_d <= _edge")
        moments = core.groupBy("_group").agg(
            *[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(d)],
            *[F.covar_samp(f"_x{i}", f"_x{j}").alias(f"_c{i}{j}") for i in range(d) for j in range(i + 1)],
        )
        model = materialize(_triangle(moments, floors), "mcd-step")
    return model


def judge_quality(documents: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """:func:`judge_rows` with ``doc_id`` in place of the whole row."""
    rows = judge_rows(documents.select("doc_id", "text", "lang", "source"), cutoff, carry=("doc_id",))
    return rows.select("_doc.doc_id", *[c for c in rows.columns if c != "_doc"])


def judge_rows(documents: DataFrame, cutoff: float = CUTOFF, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """Counts and verdict of every row of ``documents`` (``doc_id, text, lang, source`` and any others).

    Returns ``_doc`` (the columns ``carry`` as they came), ``n_words``, the counts of :func:`text_counts`, ``base_failed`` (fewer than 50 words, or over half
    of the words in repeated windows), ``distance`` (squared, from the centre of the row's group; null where
    the base failed) and ``kept`` (base passed and distance within ``cutoff``).

    Estimates rest on the rows that pass the base rules. A null language or source is a group like any other. Groups of fewer
    than 100 rows take the estimate of their language, such languages that of all rows. A null or empty text has no
    words and fails the base. Rows are never merged: equal ids or texts give one row each. Other columns are carried in ``_doc``
    only, so their names cannot clash. An empty table gives no rows.
    """
    name = lambda *parts: F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(p)), F.lit("-")) for p in parts])
    counts = text_counts(documents, carry).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    counts = materialize(counts.withColumns({f"_x{i}": x for i, x in enumerate(_vector())} | {
        "_fine": F.concat(F.lit("s"), name("lang", "source")), "_mid": F.concat(F.lit("l"), name("lang")), "_all": F.lit("a")}), "text-counts")
    d = len(FEATURES)
    levels = counts.filter("NOT base_failed").select(
        F.explode(F.array("_fine", "_mid", "_all")).alias("_group"), *[f"_x{i}" for i in range(d)])
    sizes = levels.groupBy("_group").agg(F.count("*").alias("_n")).filter((F.col("_n") >= MIN_GROUP) | (F.col("_group") == "a"))
    large = materialize(sizes, "group-sizes").select("_group")
    model = mcd(_with(levels, large))

    def take(rows: DataFrame, key: Column, label: str) -> DataFrame:
        """The distance by the model of ``key`` for rows that have none yet."""
        flat = rows.withColumn("_group", key)
        if fits_broadcast(model, rows=200_000):
            met = flat.join(F.broadcast(model), "_group", "left")
        else:
            met = flat.withColumn("_salt", F.pmod(F.xxhash64("n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(
                model.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_group", "_salt"], "left").drop("_salt")
        met = met.withColumn(label, _whitened(list(FEATURES)))
        return met.drop("_group", *[c for c in model.columns if c != "_group"])

    judged = take(take(take(counts, F.col("_fine"), "_d0"), F.col("_mid"), "_d1"), F.col("_all"), "_d2")
    distance = F.when(~F.col("base_failed"), F.coalesce("_d0", "_d1", "_d2"))
    return judged.withColumn("distance", distance).select(
        "_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"),
    )
