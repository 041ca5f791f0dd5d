"""Positions, batches, running sums, samples and lookup joins, with hot groups."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import grouping, ordinals, perplexity, sampling, skew
from tidemark.session import materialize
from tidemark.sources.tables import csv_positions


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; one group holds a third of them, ids are sparse."""
    return spark.range(3000).select(
        (F.col("id") * F.col("id") + 7).alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g")
    ).repartition(7)


def test_with_position(skewed):
    ids = sorted(r["id"] for r in skewed.collect())
    found = ordinals.with_position(skewed, ["id"])
    assert rows(found, "position", "id") == sorted(enumerate(ids), key=repr)
    by_group = {}
    for r in skewed.collect():
        by_group.setdefault(r["g"], []).append(r["id"])
    expected = sorted(((g, i, p) for g, v in by_group.items() for p, i in enumerate(sorted(v))), key=repr)
    assert rows(ordinals.with_position(skewed, ["id"], ["g"]), "g", "id", "position") == expected
    hashed = ordinals.with_hash_position(skewed.withColumn("h", F.md5(F.col("id").cast("string"))), "h", ["id"], ["g"], digits=2)
    order = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    expected = sorted(((g, i, p) for g, v in by_group.items() for p, i in enumerate(sorted(v, key=order))), key=repr)
    assert rows(hashed, "g", "id", "position") == expected


def test_position_of_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, g string")
    assert rows(ordinals.with_position(df, ["id"], ["g"]), "id", "position") == [(1, 0), (2, 1), (3, 0)]


def test_file_position(spark, skewed):
    ordered = materialize(skewed.repartitionByRange(5, "id").sortWithinPartitions("id"), "test")
    found = ordinals.with_file_position(ordered)
    assert rows(found, "position", "id") == sorted(enumerate(sorted(r["id"] for r in skewed.collect())), key=repr)


def test_drop_short_batch(spark):
    placed = spark.range(10).withColumnRenamed("id", "position")
    assert ordinals.drop_short_batch(placed, 4).count() == 8
    assert ordinals.drop_short_batch(placed, 11).count() == 0


@pytest.mark.parametrize("size", [0, 1, 137, 2999, 3000, 5000])
def test_sample_exact(skewed, size):
    order = sorted((r["id"] for r in skewed.collect()), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    taken, rest = sampling.split_exact(skewed, ["id"], size, digits=2)
    assert rows(taken, "id") == sorted(((i,) for i in order[:size]), key=repr)
    assert rows(rest, "id") == sorted(((i,) for i in order[size:]), key=repr)


def test_replay_and_batches(spark):
    new, old = spark.range(10), spark.range(100, 200)
    mixed = sampling.replay_mix(new, old, ["id"])
    assert rows(mixed.groupBy("origin").count()) == [("new", 10), ("old", 10)]
    later = sampling.replay_mix(new, old, ["id"], epoch=2, decay=0.7)
    assert rows(later.groupBy("origin").count()) == [("new", 10), ("old", 4)]
    batches = sampling.training_batches(mixed, ["origin", "id"], 6)
    assert rows(batches.groupBy("batch_id").count()) == [(0, 6), (1, 6), (2, 6)]
    again = sampling.training_batches(mixed.repartition(5), ["origin", "id"], 6)
    assert rows(batches) == rows(again), "the order does not depend on the partitioning"
    assert rows(batches) != rows(sampling.training_batches(mixed, ["origin", "id"], 6, epoch=1))


def test_hold_out_is_disjoint(skewed):
    tuning, rest = sampling.hold_out(skewed, ["id"], 500)
    assert (tuning.count(), rest.count(), tuning.join(rest, "id").count()) == (500, 2500, 0)


def test_running_perplexity(spark):
    losses = [((i * 37) % 11) / 10 for i in range(500)]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(losses)], "run string, batch_id long, loss double").repartition(5)
    found = {r["batch_id"]: r["running_ppl"] for r in perplexity.running_perplexity(df, ["run"], width=16).collect()}
    assert found == {i: pytest.approx(math.exp(sum(losses[: i + 1]) / (i + 1))) for i in range(500)}


def test_class_perplexity(spark):
    df = spark.createDataFrame(
        [(0, "ner", 1.0), (0, None, 3.0), (1, "noun", 2.0), (1, "noun", 4.0)], "batch_id int, word_class string, nll double"
    )
    row = perplexity.class_perplexity(df).first()
    assert row["all"] == pytest.approx(math.exp(2.5)) and row["ner"] == pytest.approx(math.e)
    assert row["noun"] == pytest.approx(math.exp(3)) and row["verb"] is None
    row = perplexity.class_perplexity(df, empty="propagate").first()
    assert math.isnan(row["ner"]) and math.isnan(row["verb"]) and row["all"] == pytest.approx(math.exp(2.5))


@pytest.mark.parametrize("broadcast_rows", [0, 10, 1_000_000])
def test_lookup_join(spark, skewed, broadcast_rows):
    """Hot known keys, hot unknown keys and null keys all keep every row."""
    facts = skewed.select("id", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("g")).alias("k"))
    facts = facts.unionByName(skewed.select("id", F.lit("unknown").alias("k")))
    lookup = materialize(skewed.select(F.col("g").alias("k")).distinct().withColumn("v", F.length("k")), "lookup")
    found = skew.lookup_join(facts, lookup, ["k"], broadcast_rows=broadcast_rows, sample=facts.sample(0.2, 3))
    assert rows(found, "id", "k", "v") == rows(facts.join(lookup, "k", "left"), "id", "k", "v")


@pytest.mark.parametrize("hitters", [2, 10_000])
def test_lookup_join_by_sketches(spark, skewed, monkeypatch, hitters):
    monkeypatch.setattr(skew.heavy_hitters, "__defaults__", (hitters,))
    facts = skewed.select("id", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("g")).alias("k"))
    facts = facts.unionByName(skewed.select("id", F.lit("unknown").alias("k")))
    lookup = materialize(skewed.select(F.col("g").alias("k")).distinct().withColumn("v", F.length("k")), "lookup")
    found = skew.lookup_join(facts, lookup, ["k"], broadcast_rows=0, costly=True)
    assert rows(found, "id", "k", "v") == rows(facts.join(lookup, "k", "left"), "id", "k", "v")
    assert skew.heavy_hitters(facts.limit(0), ["k"]).count() == 0
    binary = [t.withColumn("k", F.col("k").cast("binary")) for t in (facts, lookup)]
    assert skew.lookup_join(*binary, ["k"], broadcast_rows=0).count() == facts.count()


def test_no_task_gets_a_hot_key(spark, skewed):
    """Half of the facts carry one key. The plain join puts them in one task, the lookup join does not."""
    facts = skewed.select("id", F.col("g").alias("k")).unionByName(skewed.select("id", F.lit("unknown").alias("k")))
    lookup = materialize(skewed.select(F.col("g").alias("k")).distinct().withColumn("v", F.length("k")), "lookup")
    share = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] / facts.count()
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in off.items():
        spark.conf.set(key, value)
    try:
        assert share(facts.join(lookup, "k", "left")) >= 0.5
        assert share(skew.lookup_join(facts, lookup, ["k"], broadcast_rows=0, sample=facts.sample(0.2, 3))) < 0.15
        assert share(skew.lookup_join(facts, lookup, ["k"], broadcast_rows=0)) < 0.15
    finally:
        for key in off:
            spark.conf.unset(key)


def test_lookup_few_does_not_shuffle_the_lookup(spark, capsys):
    few = materialize(spark.createDataFrame([("a", 1), ("b", 1), ("x", 2)], "k string, n int"), "few")
    lookup = materialize(spark.range(1000).select(F.chr(F.col("id") % 26 + 97).alias("k"), "id").dropDuplicates(["k"]), "lookup")
    found = skew.lookup_few(few.filter("n = 1"), lookup, ["k"])
    found.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert rows(found, "k", "n") == [("a", 1), ("b", 1)]
    assert rows(skew.lookup_few(spark.createDataFrame([("?",)], "k string"), lookup, ["k"])) == [("?", None)]


def test_fits_broadcast_checks_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert skew.fits_broadcast(df) and not skew.fits_broadcast(df, size=50_000) and not skew.fits_broadcast(df, rows=99)


def test_grouping(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("bbacab")], "i int, k string")
    found = grouping.grouped(df, "i", F.col("k"))
    assert rows(found, "group_pos", "member_pos", "i") == [(0, 0, 0), (0, 1, 1), (0, 2, 5), (1, 0, 2), (1, 1, 4), (2, 0, 3)]
    found = grouping.grouped(df, "i", F.col("k"), order="key")
    assert rows(found.select("group_key", "group_pos").distinct()) == [("a", 0), ("b", 1), ("c", 2)]
    restored = grouping.once_per_key(df, F.col("k"), lambda keys: keys.withColumn("n", F.ascii("group_key")))
    assert rows(restored, "i", "n") == [(i, ord(k)) for i, k in enumerate("bbacab")]
    assert grouping.uncovered(df, df.filter("k <> 'c'").select("k").distinct(), ["k"]).count() == 1
    assert rows(grouping.chunks(df.withColumnRenamed("i", "p"), "p", 4, "k")) == [(0, ["b", "b", "a", "c"]), (1, ["a", "b"])]


def test_epoch_cursor(spark):
    epoch, file = sampling.epoch_cursor(F.col("id"), 3)
    assert rows(spark.range(7).select(epoch.alias("e"), file.alias("f"))) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]


def test_tagged_union(spark):
    both = sampling.tagged_union({"x": spark.range(1), "y": spark.range(2)})
    assert rows(both) == [(0, "x", 0), (0, "y", 1), (1, "y", 1)]


def test_rows_without_a_group_keep_their_running_sums(spark):
    df = spark.createDataFrame([(None, 0, 1.0), ("a", 0, 2.0), (None, 250_000, 4.0)], "split string, step long, x double")
    found = ordinals.running_sums(df, ["split"], "step", {"total": F.col("x")})
    assert rows(found, "split", "step", "total") == sorted([(None, 0, 1.0), ("a", 0, 2.0), (None, 250_000, 5.0)], key=repr)


def test_csv_positions_follow_file_names_not_sizes(spark, tmp_path):
    sizes = {"a": 3, "b": 400, "c": 50}
    for name, size in sizes.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.csv").write_text("text\n" + "".join(f"{name}{i}\n" for i in range(size)))
    found = csv_positions(spark, str(tmp_path / "in"), str(tmp_path / "out"), "text string")
    assert [r["text"] for r in found.orderBy("position").collect()] == [f"{n}{i}" for n, size in sizes.items() for i in range(size)]
    assert sorted(r["position"] for r in found.collect()) == list(range(453))
