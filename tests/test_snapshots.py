"""Snapshot differences on hand-written pages and facts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import snapshots as S
from tidemark.sources.tables import write_snapshot


@pytest.fixture(scope="module")
def pages(spark):
    prev = spark.createDataFrame([(1, "Same."), (2, "Old one. Kept."), (3, "Gone."), (5, "A. A. B.")], "page_id int, text string")
    curr = spark.createDataFrame(
        [(1, "Same."), (2, "Kept. Brand new. Brand new."), (4, "Fresh page.\nTwo"), (5, "A. A. B. A.")], "page_id int, text string"
    )
    return prev, curr


def test_page_diff(pages):
    assert rows(S.page_diff(*pages)) == [(1, "unchanged"), (2, "updated"), (3, "deleted"), (4, "new"), (5, "updated")]


def test_novel_sentences(pages):
    assert rows(S.novel_sentences(*pages)) == [(2, 1, "Brand new."), (2, 2, "Brand new."), (4, 0, "Fresh page."), (4, 1, "Two")]
    assert rows(S.diff_corpus(*pages)) == [(2, "Brand new. Brand new."), (4, "Fresh page. Two")]


def test_changed_pages(pages):
    assert rows(S.changed_pages(*pages), "page_id") == [(2,), (4,), (5,)]


def test_bucketed_snapshots_are_not_shuffled(spark, pages, tmp_path, capsys):
    prev, curr = (
        write_snapshot(p, f"snapshot_{name}", str(tmp_path / name), "page_id", 4) for p, name in zip(pages, ("prev", "curr"))
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.diff_corpus(prev, curr)
        found.explain()
        assert "Exchange" not in capsys.readouterr().out
        assert rows(found) == rows(S.diff_corpus(*pages))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE snapshot_prev")
        spark.sql("DROP TABLE snapshot_curr")


FACTS = "subject string, relation string, object string"


def test_fact_diff(spark):
    prev = spark.createDataFrame([("a", "r", "x"), ("a", "r", "y"), ("b", "r", "x"), ("d", "r", "z")], FACTS)
    curr = spark.createDataFrame([("a", "r", "x"), ("a", "r", "w"), ("b", "q", "x"), ("c", "r", "x"), ("c", "r", "x")], FACTS)
    assert rows(S.fact_diff(prev, curr), "subject", "relation", "object", "status", "split") == [
        ("a", "r", "w", "updated", "changed"), ("a", "r", "x", "unchanged", "unchanged"),
        ("b", "q", "x", "new", "changed"), ("c", "r", "x", "new", "changed"),
    ]


def test_align_facts(spark):
    facts = spark.createDataFrame(
        [("P", "r", "red", "changed"), ("P", "r", "blue", "changed"), ("Q", "r", "red", "unchanged"), ("Q", "r", "red", "changed")],
        FACTS + ", split string",
    )
    pages = spark.createDataFrame([("P", "now red"), ("Q", "still red"), ("R", "x")], "title string, text string")
    diff = spark.createDataFrame([("P", "updated"), ("Q", "unchanged"), ("R", "deleted")], "title string, status string")
    assert rows(S.align_facts(facts, pages, diff)) == [("P", "r", "red", "changed"), ("Q", "r", "red", "unchanged")]


@pytest.mark.parametrize(("together", "few"), [(1, 8), (3, 0), (1_000, 0), (1_000, 1)])
def test_align_many_objects(spark, monkeypatch, together, few):
    """Objects inside one another, empty and missing ones, equal facts, pages that share a title; a subject with most facts, in lists of any length."""
    monkeypatch.setattr(S, "OBJECTS", together)
    monkeypatch.setattr(S, "FEW_OBJECTS", few)
    names = ["he", "she", "hers", "his", "", None, "é", "a b", "zz"]
    facts = [("P", f"r{i}", o, split) for i, o in enumerate(names * 2) for split in ("changed", "unchanged")]
    facts += [("Q", "r", "his", "changed")] * 2 + [("R", "r", "he", "changed"), (None, "r", "he", "changed"), ("S", "r", "", "changed")]
    pages = [("P", "ushers a b"), ("P", "this é"), ("Q", "his"), ("R", None), (None, "he"), ("T", "he"), ("S", "")]
    diff = [("P", "updated"), ("Q", "new"), ("R", "new"), ("S", "new"), ("T", "deleted"), (None, "new")]
    expected = sorted((f for f in facts for title, text in pages for t, status in diff
                       if title is not None and f[0] == title == t and f[2] is not None and text is not None and f[2] in text
                       and status != "deleted" and (status == "unchanged") == (f[3] == "unchanged")), key=repr)
    found = S.align_facts(
        spark.createDataFrame(facts, FACTS + ", split string"), spark.createDataFrame(pages, "title string, text string"),
        spark.createDataFrame(diff, "title string, status string"))
    assert rows(found) == expected and expected


def test_align_moves_texts_once(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pages = spark.range(9).select(F.col("id").cast("string").alias("title"), F.concat(F.lit("the "), "id").alias("text"))
        diff = S.page_diff(pages, pages, "title")
        facts = pages.select(F.col("title").alias("subject"), F.lit("r").alias("relation"), F.col("title").alias("object"),
                             F.lit("unchanged").alias("split"))
        found = S.align_facts(facts, pages, diff)
        capsys.readouterr()
        found.explain("formatted")
        plan = capsys.readouterr().out
        moved = [p for p in plan.split("\n\n") if " Exchange" in p.splitlines()[0] and "_text#" in p]
        assert len(moved) == 1
        assert found.count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_plausible_facts(spark):
    facts = spark.createDataFrame(
        [("Paris", "r", "paris hilton"), ("New York City", "r", "new york"), ("a", "r", "one two three"), ("x", "r", "good one")], FACTS
    )
    assert rows(S.plausible_facts(facts, 2)) == [("x", "r", "good one")]


@pytest.mark.parametrize("cap", [1, 7, 1500])
def test_cap_per_key(spark, cap):
    """A relation with two thirds of the facts keeps exactly its first ones in hash order, below and above the window bound."""
    facts = spark.range(3000).select(
        F.concat(F.lit("s"), "id").alias("subject"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("relation"),
        F.concat(F.lit("o"), "id").alias("object"),
    )
    by_key = {}
    for r in facts.collect():
        by_key.setdefault(r["relation"], []).append(tuple(r))
    order = lambda f: hashlib.md5(f"42:{f[0]}:{f[1]}:{f[2]}".encode()).hexdigest()
    expected = sorted((f for v in by_key.values() for f in sorted(v, key=order)[:cap]), key=repr)
    assert rows(S.cap_per_key(facts, "relation", cap)) == expected


def test_month_pairs(spark):
    months = spark.createDataFrame([("202109",), ("202108",), ("202109",), ("202112",)], "month string")
    assert rows(S.month_pairs(months, corpus="wikipedia")) == [
        ("202108", "202109", "wikipedia_0809", "0801-0901"), ("202109", "202112", "wikipedia_0912", "0901-1201"),
    ]
    names = spark.createDataFrame([("1001_1101_changed",), ("1001-1101_changed",)], "n string")
    assert {r[0] for r in names.select(S.normalize_probe_name(F.col("n"))).collect()} == {"1001-1101_changed"}


def test_pages_without_text(spark):
    prev = spark.createDataFrame([(1, None), (2, None), (3, "a"), (5, None), (6, "x")], "page_id int, text string")
    curr = spark.createDataFrame([(2, None), (3, None), (4, None), (5, "b"), (6, "x")], "page_id int, text string")
    assert rows(S.page_diff(prev, curr)) == [
        (1, "deleted"), (2, "unchanged"), (3, "updated"), (4, "new"), (5, "updated"), (6, "unchanged")]
    assert rows(S.changed_pages(prev, curr), "page_id") == [(3,), (4,), (5,)]
    assert rows(S.diff_corpus(prev, curr)) == [(5, "b")]


def test_both_ways_of_a_cap_keep_facts_without_a_key(spark):
    facts = spark.createDataFrame([(None if i % 2 else "s", "r", f"o{i}") for i in range(12)], "subject string, relation string, object string")
    small, large = (rows(S.cap_per_key(facts, "subject", cap)) for cap in (1_000, 1_001))
    assert small == large and len(small) == 12
    kept = rows(S.cap_per_key(facts, "subject", 4))
    S.GROUP_LIMIT, old = 0, S.GROUP_LIMIT
    assert rows(S.cap_per_key(facts, "subject", 4)) == kept and len(kept) == 8
    S.GROUP_LIMIT = old


def brute_shares(facts, shares):
    """Cuts by trying every size from the largest down, one column after the other, until nothing changes."""
    order = lambda f: (hashlib.md5((":".join(["42", *(x for x in f if x is not None)])).encode()).hexdigest(), repr(f))
    facts, before = sorted(facts, key=order), None
    while facts != before:
        before = facts
        for column, share in shares.items():
            by = {}
            for f in facts:
                by.setdefault(f[S.FACT.index(column)], []).append(f)
            most = lambda n: max(1, n * share // 1000)
            n = next((n for n in range(len(facts), 0, -1) if sum(min(len(v), most(n)) for v in by.values()) >= n), 0)
            facts = sorted((f for v in by.values() for f in v[:most(n)]), key=order)
    return facts


@pytest.mark.parametrize("shares", [
    {"subject": 20, "relation": 300, "object": 60}, {"object": 1, "relation": 500}, {"relation": 999, "subject": 7}, {"relation": 100}])
def test_shares_hold_together(spark, shares):
    """A relation and an object with most of the facts, missing keys and equal facts; the same from one partition and from many."""
    facts = [(f"s{i % 97}" if i % 11 else None, "hot" if i % 5 else f"r{i % 4}", f"o{i % (3 if i % 2 else 41)}") for i in range(900)]
    table = spark.createDataFrame(facts, FACTS)
    found = rows(S.share_caps(table.repartition(7), shares))
    assert found == rows(S.share_caps(table.coalesce(1), shares)) == sorted(brute_shares(facts, shares), key=repr)
    for column, share in shares.items():
        held = [f[S.FACT.index(column)] for f in found]
        assert max(held.count(k) for k in set(held)) <= max(1, len(found) * share // 1000)


def test_shares_of_nothing(spark):
    assert rows(S.share_caps(spark.createDataFrame([], FACTS), {"subject": 10})) == []
    with pytest.raises(ValueError):
        S.share_caps(spark.createDataFrame([], FACTS), {"subject": 0})
