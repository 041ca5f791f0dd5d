"""CSV read in splits against the same files read whole."""

import csv
import random

import pytest
from conftest import rows

from tidemark.sources import csv_splits, tables

SCHEMA = "id int, text string, more string"


def odd_rows(n, seed):
    draw = random.Random(seed)
    parts = ["a", "word ", "\n", '"', '""', ",", "\xe9", "漢", "\r\n", " ", "'", "\\", "x" * 40, "\n\n"]
    return [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 12))), draw.choice(["", "m", "two\nlines"])) for i in range(n)]


def write(path, found, end="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=quoting)
        out.writerow(["id", "text", "more"])
        out.writerows(found)


@pytest.mark.parametrize("size", [16, 50, 400, 1 << 20])
def test_splits_give_the_rows_of_the_whole_file(spark, tmp_path, size):
    write(tmp_path / "a.csv", odd_rows(60, 1))
    write(tmp_path / "b.csv", odd_rows(60, 2), "\n", csv.QUOTE_ALL)
    (tmp_path / "c.csv").write_text('id,text,more\n1,"' + "long\n" * 60 + '",z\n\n2,last,')  # one record over many splits, no line feed at the end
    (tmp_path / "d.csv").write_text("id,text,more\n")
    whole = tables.read_csv(spark, str(tmp_path), SCHEMA)
    assert rows(csv_splits.split_csv(spark, str(tmp_path), SCHEMA, split_bytes=size)) == rows(whole)
    if size == 50:
        with csv_splits._split_bytes(spark, size):
            assert csv_splits._lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() >= 8


def test_every_border(spark, tmp_path):
    text = 'id,text,more\n1,"a\n""b""\n",""\n2,c,"\n"\n3,,d\n'
    (tmp_path / "x.csv").write_text(text)
    want = rows(tables.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA))
    for size in range(1, len(text) + 1, 3):
        assert rows(csv_splits.split_csv(spark, str(tmp_path / "x.csv"), SCHEMA, split_bytes=size)) == want


def test_carriage_returns_end_lines(spark, tmp_path):
    found = [(i, t.replace("\r\n", "\n"), m) for i, t, m in odd_rows(40, 3)]
    write(tmp_path / "a.csv", found, "\r\n", csv.QUOTE_ALL)
    write(tmp_path / "plain.csv", found, "\n", csv.QUOTE_ALL)
    got = csv_splits.split_csv(spark, str(tmp_path / "a.csv"), SCHEMA, split_bytes=64)
    assert rows(got) == rows(tables.read_csv(spark, str(tmp_path / "plain.csv"), SCHEMA))


def test_positions_and_columns(spark, tmp_path):
    write(tmp_path / "b.csv", odd_rows(50, 4), quoting=csv.QUOTE_ALL)
    write(tmp_path / "a.csv", odd_rows(30, 5), quoting=csv.QUOTE_ALL)
    got = csv_splits.split_csv(spark, str(tmp_path), SCHEMA, ["id"], position="at", split_bytes=100)
    assert got.columns == ["id", "at"]
    assert [r["id"] for r in got.orderBy("at").collect()] == [*range(30), *range(50)]
    assert sorted(r["at"] for r in got.collect()) == list(range(80))


def test_starts_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    write(tmp_path / "a.csv", odd_rows(60, 6))
    monkeypatch.setattr(csv_splits, "fits_broadcast", lambda df: False)
    whole = tables.read_csv(spark, str(tmp_path), SCHEMA)
    assert rows(csv_splits.split_csv(spark, str(tmp_path), SCHEMA, split_bytes=80)) == rows(whole)


def test_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    """A file of over 200 splits is written down by 32 tasks, four for each core, with the same rows."""
    write(tmp_path / "a.csv", odd_rows(300, 6), quoting=csv.QUOTE_ALL)
    size = (tmp_path / "a.csv").stat().st_size // 200
    with csv_splits._split_bytes(spark, size):
        assert csv_splits._lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() >= 200
    wrote, real = {}, csv_splits.materialize
    monkeypatch.setattr(csv_splits, "materialize", lambda df, label: wrote.setdefault(label, real(df, label)))
    got = csv_splits.split_csv(spark, str(tmp_path), SCHEMA, split_bytes=size)
    assert rows(got) == rows(tables.read_csv(spark, str(tmp_path), SCHEMA))
    assert wrote["csv-records"].select("_metadata.file_path").distinct().count() <= 4 * spark.sparkContext.defaultParallelism
