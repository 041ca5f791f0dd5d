"""What changed between two dated snapshots of pages and facts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.ordinals import with_hash_position
from tidemark.operators.sampling import order_hash
from tidemark.operators.skew import lookup_join
from tidemark.session import bound_batches, materialize

FACT = ["subject", "relation", "object"]
# Spark trims ranked groups before the shuffle up to this rank (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1_000
OBJECTS = 1_000  # objects that meet a page's text together, give or take what hashing does
FEW_OBJECTS = 8  # so many are looked for one by one, which takes no Python
_TOLD = pa.schema([("subject", pa.string()), ("split", pa.string()), ("object", pa.string())])


def page_diff(prev: DataFrame, curr: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """``key, status`` of every page: new, updated, unchanged or deleted.

    A page without text is there all the same; two pages without text are equal. Only keys and hashes are shuffled,
    never the texts.
    """
    old = prev.select(key, F.sha2(text, 256).alias("_old"), F.lit(True).alias("_before"))
    new = curr.select(key, F.sha2(text, 256).alias("_new"), F.lit(True).alias("_now"))
    status = (
        F.when(F.col("_before").isNull(), "new")
        .when(F.col("_now").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("updated")
    )
    return old.join(new, key, "full_outer").select(key, status.alias("status"))


def changed_pages(prev: DataFrame, curr: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """New and updated pages of ``curr``, by the rules of ``page_diff``. Of ``prev`` only keys and hashes are shuffled."""
    missing = F.lit("")  # no digest is empty
    old = prev.select(key, F.coalesce(F.sha2(text, 256), missing).alias("_hash"))
    now = curr.withColumn("_hash", F.coalesce(F.sha2(text, 256), missing))
    return now.join(old, [key, "_hash"], "left_anti").select(curr.columns)


def novel_sentences(prev: DataFrame, curr: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """``key, pos, sentence`` of all sentences that the page did not have before.

    One join by page; unchanged pages leave right after it, before any sentence is split. The sentences are compared
    within the partitioning of that join, so nothing else is shuffled, and nothing at all when both snapshots are
    bucketed by page (``write_snapshot``).
    """
    both = curr.select(key, text).join(prev.select(key, F.col(text).alias("_old")), key, "left")
    changed = both.filter(F.col("_old").isNull() | (F.col("_old") != F.col(text)))
    cell = lambda s, pos: F.struct(s.alias("sentence"), pos.cast("int").alias("pos"))
    now = F.transform(T.sentences(F.col(text)), lambda s, i: cell(s, i))
    before = F.transform(T.sentences(F.coalesce("_old", F.lit(""))), lambda s: cell(s, F.lit(None)))
    sentences = changed.select(key, F.explode(F.concat(now, before)).alias("_s")).select(key, "_s.sentence", "_s.pos")
    # All cells of one sentence lie within one page. collect_list leaves the earlier ones out, they have no position.
    found = sentences.groupBy(key, "sentence").agg(
        F.max(F.col("pos").isNull()).alias("_known"), F.collect_list("pos").alias("_at")
    )
    return found.filter(~F.col("_known")).select(key, F.explode("_at").alias("pos"), "sentence")


def diff_corpus(prev: DataFrame, curr: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """``key, text``: the novel sentences of each page, joined in order."""
    cells = novel_sentences(prev, curr, key, text).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("_cells")
    )
    return cells.select(key, F.array_join(F.col("_cells.sentence"), " ").alias(text))


def fact_diff(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Current facts with ``status`` unchanged, updated or new, and ``split`` unchanged or changed.

    A fact is updated when the earlier snapshot had its subject and relation with other objects only.
    Both snapshots meet in one aggregation; the subject and relation pairs are made distinct
    before the join, so a pair with very many facts meets a single row.
    """
    both = prev.select(*FACT, F.lit(0).alias("_now")).unionByName(curr.select(*FACT, F.lit(1).alias("_now")))
    facts = both.groupBy(*FACT).agg(F.min("_now").alias("_first"), F.max("_now").alias("_last")).filter("_last = 1")
    pairs = prev.select("subject", "relation").distinct().withColumn("_pair", F.lit(True))
    status = (
        F.when(F.col("_first") == 0, "unchanged").when(F.col("_pair"), "updated").otherwise("new")
    )
    found = facts.join(pairs, ["subject", "relation"], "left").select(*FACT, status.alias("status"))
    return found.withColumn("split", F.when(F.col("status") == "unchanged", "unchanged").otherwise("changed"))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects that a page's text holds. An automaton of the page's objects reads the text once, however many there are."""
    import ahocorasick  # only tasks need it

    for rows in batches:
        subjects, splits, objects = [], [], []
        columns = (rows.column(name).to_pylist() for name in ("subject", "split", "_objects", "_text"))
        for subject, split, wanted, text in zip(*columns):
            if text is None:
                continue
            words = ahocorasick.Automaton()
            for word in filter(None, wanted):
                words.add_word(word, word)
            words.make_automaton()
            found = {word for _, word in words.iter(text)} if len(words) else set()
            found |= {"" for word in wanted if not word}  # every text holds the empty one
            subjects += [subject] * len(found)
            splits += [split] * len(found)
            objects += found
        yield pa.RecordBatch.from_pydict({"subject": subjects, "split": splits, "object": objects}, schema=_TOLD)


def align_facts(facts: DataFrame, pages: DataFrame, diff: DataFrame, key: str = "title", text: str = "text") -> DataFrame:
    """Facts that a page of their kind tells.

    A changed fact needs a new or updated page, an unchanged fact an unchanged one, with the
    subject as its title and the object in its text. ``facts`` has ``split``, ``diff`` has ``status``. Facts without a subject or object, and
    pages without a title or text, tell nothing; a fact told by several pages of one title comes once for each.

    The objects of a subject travel in lists of about ``OBJECTS``, so a subject with most of the facts is many rows, and each list meets the
    page's text once: lists of more than ``FEW_OBJECTS`` by an automaton, shorter ones object by object. Texts are moved once, for the join by title.
    """
    bound_batches(pages.sparkSession)
    facts = materialize(facts.filter("subject IS NOT NULL AND object IS NOT NULL"), "facts")
    large = facts.groupBy("subject", "split").agg(F.count("*").alias("_n")).filter(F.col("_n") > OBJECTS)
    placed = lookup_join(facts.select("subject", "split", "object"), materialize(large, "large-subjects"), ["subject", "split"])
    place = F.pmod(F.xxhash64("object"), F.ceil(F.coalesce("_n", F.lit(1)) / OBJECTS))
    lists = placed.groupBy("subject", "split", place.alias("_place")).agg(F.collect_set("object").alias("_objects"))
    kind = F.when(F.col("status") == "unchanged", "unchanged").otherwise("changed")
    kinds = diff.filter(F.col("status") != "deleted").select(F.col(key).alias("subject"), kind.alias("split"))
    asked = lists.join(kinds, ["subject", "split"]).select("subject", "split", "_objects", (F.size("_objects") > FEW_OBJECTS).alias("_many"))
    met = pages.select(F.col(key).alias("subject"), F.col(text).alias("_text")).join(asked, "subject")
    held = F.filter("_objects", lambda word: F.contains("_text", word))
    few = met.filter(~F.col("_many")).select("subject", "split", F.explode(held).alias("object"))
    many = met.filter("_many").mapInArrow(_told, "subject string, split string, object string")
    told = few.unionByName(many)
    return facts.join(told, ["subject", "split", "object"]).select(facts.columns)


def plausible_facts(facts: DataFrame, max_object_words: int = 5) -> DataFrame:
    """Facts whose object is short, and where neither subject nor object holds the other."""
    subject, obj = F.lower("subject"), F.lower("object")
    return facts.filter(
        ~F.contains(subject, obj) & ~F.contains(obj, subject)
        & (F.size(F.split(F.trim("object"), " +")) <= max_object_words)
    )


def cap_per_key(facts: DataFrame, key: str | list[str], cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` facts per key, the first in hash order.

    Facts without a key are capped like those of any other key. Spark trims small ranks before the shuffle. For a larger cap the
    rank comes from hash buckets, which spread a hot key over many tasks; both ways keep the same facts.
    """
    keys = [key] if isinstance(key, str) else key
    rows = facts.withColumn("_hash", order_hash(F.lit(seed), *FACT))
    if cap <= GROUP_LIMIT:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("_hash", *FACT))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_hash", "_rank")
    ranked = with_hash_position(rows, "_hash", FACT, keys, name="_rank")
    return ranked.filter(F.col("_rank") < cap).drop("_hash", "_rank")


def share_size(total: int, largest: list[int], share: int) -> int:
    """Facts that stay when no key may hold more than ``share`` in 1,000 of what stays, or one fact where that is less than one.

    The largest ``n`` with ``n`` = sum of ``min(count, max(1, n * share // 1000))`` over all keys. ``largest`` holds the counts of the
    ``2000 // share + 1`` largest keys: no more than these can lie over their share in the end.
    """
    others = total - sum(largest)
    size = total
    while True:
        most = max(1, size * share // 1000)
        left = others + sum(min(n, most) for n in largest)
        if left == size:
            return size
        size = left


def share_caps(facts: DataFrame, shares: dict[str, int], seed: int = 42) -> DataFrame:
    """Facts of which no subject, relation or object holds more than its share, in 1,000 of the facts that stay.

    Every key keeps at least one fact, a missing key is a key like any other, and equal facts count each. ``shares`` maps columns to
    shares from 1 to 1,000. One column after the other is cut to the largest set that keeps its share; as
    that makes the set smaller, and with it the shares of the others, rounds go on until one removes nothing. Each key keeps its first facts in hash order, so
    the result depends on neither partitioning nor the order of rows. Only the counts of the ``2000 // share + 1`` largest keys
    reach the driver, at most 2,001.
    """
    for column, share in shares.items():
        if not 1 <= share <= 1_000:
            raise ValueError(f"the share of {column} is {share}, not within 1 and 1000")
    facts = materialize(facts, "facts")
    size, before = facts.count(), -1
    while size != before:
        before = size
        for column, share in shares.items():
            counts = facts.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n")).limit(2_000 // share + 1)
            largest = [r["_n"] for r in counts.select("_n").collect()]
            left = share_size(size, largest, share)
            if left < size:
                facts = materialize(cap_per_key(facts, column, max(1, left * share // 1000), seed), "facts")
                size = left
    return facts


def filter_facts(
    facts: DataFrame, max_object_words: int = 5, caps: dict[str, int] | None = None, seed: int = 42
) -> DataFrame:
    """Plausible facts, then one cap after the other (by subject, relation, object)."""
    facts = plausible_facts(facts, max_object_words)
    for key, cap in (caps or {}).items():
        facts = cap_per_key(facts, key, cap, seed)
    return facts


def month_pairs(months: DataFrame, month: str = "month", corpus: str = "corpus") -> DataFrame:
    """Each month with the next: ``prev_month, month, diff_name, probe_name``.

    ``months`` holds ``yyyyMM`` texts. It is made distinct first; there is one row per calendar month.
    """
    order = W.orderBy(month)  # calendar months only
    pairs = months.select(month).distinct().select(F.col(month).alias("prev_month"), F.lead(month).over(order).alias("month"))
    number = lambda c: F.substring(c, 5, 2)
    return pairs.filter("month is not null").select(
        "prev_month", "month",
        F.concat(F.lit(corpus + "_"), number("prev_month"), number("month")).alias("diff_name"),
        F.concat(number("prev_month"), F.lit("01-"), number("month"), F.lit("01")).alias("probe_name"),
    )


def normalize_probe_name(name: Column) -> Column:
    """``0801_0901_changed`` and ``0801-0901_changed`` are the same set."""
    return F.regexp_replace(name, r"^(\d{4})_(\d{4})", "$1-$2")
