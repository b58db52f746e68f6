"""One file from many tasks: order, odd values, replaced paths, lost attempts."""

import csv
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from litsieve.sources import ordered, tables


def lines_of(path):
    (file,) = [p for p in Path(path).iterdir() if not p.name.startswith(".")]
    return file.read_text(encoding="utf-8").split("\n")[:-1]


def test_rows_of_many_tasks_keep_their_order(spark, tmp_path):
    df = spark.range(20_000, numPartitions=7).select((F.col("id") * 7919 % 20_011).alias("k"), F.repeat(F.lit("é"), (F.col("id") % 40).cast("int")).alias("t"))
    out = str(tmp_path / "a b" / "review")
    tables.write_review(df, out, order=("k",))
    got = lines_of(out)
    assert got[0] == "k,t" and [int(x.split(",")[0]) for x in got[1:]] == sorted(r.k for r in df.collect())
    assert [p.name for p in (tmp_path / "a b").iterdir()] == ["review"]  # no parts are left
    with pytest.raises(FileExistsError):
        tables.write_review(df, out)


def test_odd_values_come_back(spark, tmp_path):
    rows = [(1, 'a "q", b', None), (2, "two\nlines\t", ""), (None, "x" * 100_000, "ж"), (4, " lead", "\\")]
    df = spark.createDataFrame(rows, "k long, `a,b` string, c string").repartition(3)
    for sep in (",", "\t"):
        tables.write_review(df, str(tmp_path / "odd"), sep, overwrite=True)
        back = tables.read_csv(spark, str(tmp_path / "odd"), sep)
        df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("sep", sep).csv(str(tmp_path / "plain"))
        assert back.columns == ["k", "a,b", "c"]
        assert sorted(map(str, back.collect())) == sorted(map(str, tables.read_csv(spark, str(tmp_path / "plain"), sep).collect()))
    tables.write_review(back, str(tmp_path / "odd"), overwrite=True)  # rows from the path that is replaced
    assert tables.read_csv(spark, str(tmp_path / "odd")).count() == 4
    tables.write_review(df.limit(0), str(tmp_path / "none"))
    (file,) = (tmp_path / "none").iterdir()
    assert list(csv.reader(file.open())) == [["k", "a,b", "c"]]


def test_only_parts_that_count_are_joined(tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 3)
    (tmp_path / "p").mkdir()
    w = ordered.OrderedWriter({"path": str(tmp_path / "to"), "parts": str(tmp_path / "p"), "file": "f", "header": "h"})
    for name, text in (("0-x", "lost attempt\n"), ("0-y", "first\n"), ("2-z", "last\n"), ("1-e", "")):
        (tmp_path / "p" / name).write_text(text)
    w.commit([ordered.Part(2, str(tmp_path / "p" / "2-z"), 5), None, ordered.Part(0, str(tmp_path / "p" / "0-y"), 6), ordered.Part(1, str(tmp_path / "p" / "1-e"), 0)])
    assert (tmp_path / "to" / "f").read_text() == "h\nfirst\nlast\n" and not (tmp_path / "p").exists()
    (tmp_path / "p").mkdir()
    w.abort([None])
    assert not (tmp_path / "p").exists() and (tmp_path / "to" / "f").exists()


def test_titles_by_cluster(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 2, 2, 10, 999]), f"t{rng.randrange(40):02d}") for _ in range(500)] + [(5, None), (None, "free"), (999, "a\r\nb"), (7, "")]
    df = spark.createDataFrame(rows, "cluster int, title string").repartition(5)
    want = []
    for c in [None, 1, 2, 5, 7, 10, 999]:
        want += ["solo" if c == 999 else f"cluster {'null' if c is None else c}", *sorted(t.replace("\r\n", " ") for k, t in rows if k == c and t is not None), ""]
    assert [r.value for r in tables.title_lines(df).collect()] == want
    tables.write_titles(df, str(tmp_path / "titles"))
    assert lines_of(tmp_path / "titles") == want
    assert tables.title_lines(df.limit(0)).count() == 0
