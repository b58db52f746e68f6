"""Near duplicates of a stream against an index of what it has kept."""

import random

import pytest

from litsieve.streaming.ingest import BandIndex


def said(rng, n=40):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "id long, t string, part string, band long")


def rows_of(pairs):
    return [(k, t, "p", 1) for k, t in pairs]


def test_three_batches(spark, frame, tmp_path):
    rng = random.Random(1)
    texts = [said(rng) for _ in range(30)]
    near = lambda t: t + " new"
    index = BandIndex(str(tmp_path / "index"), "id", "t", 0.8)
    out = []
    keep = lambda batch, n: out.append(sorted(r["id"] for r in index(frame(rows_of(batch)), n).collect()))

    keep([(k, texts[k]) for k in range(10)] + [(50, near(texts[3])), (51, texts[3]), (52, None), (53, " ?! "), (None, "x y"), (0, texts[0])], 0)
    assert out[0] == list(range(10)) and index.read_keys == 0
    keep([(k, texts[k]) for k in range(10, 20)], 1)  # nothing in common with the store: its sets are not read
    assert out[1] == list(range(10, 20)) and index.read_keys == 0
    keep([(60, near(texts[2])), (61, texts[15]), (62, near(texts[25])), (63, texts[25]), (64, texts[26])], 2)
    assert out[2] == [62, 64] and 0 < index.read_keys <= 3
    keep([(60, near(texts[2])), (61, texts[15]), (62, near(texts[25])), (63, texts[25]), (64, texts[26])], 2)  # the batch runs again
    assert out[3] == [62, 64]
    stored = spark.read.parquet(str(tmp_path / "index/sets"))
    assert sorted(r[0] for r in stored.select("set_id").collect()) == [*range(20), 62, 64]


def test_a_stream_in_three_batches(spark, tmp_path):
    rng = random.Random(2)
    texts = [said(rng) for _ in range(9)]
    source = tmp_path / "in"
    for b in range(3):
        own = [(10 * b + k, texts[3 * b + k]) for k in range(3)] + [(100 + b, texts[0] + " more")]
        spark.createDataFrame(own, "id long, t string").coalesce(1).write.parquet(str(source / f"d{b}"))
    index = BandIndex(str(tmp_path / "index"), "id", "t", 0.8)
    kept = []
    stream = spark.readStream.schema("id long, t string").option("maxFilesPerTrigger", 1).parquet(str(source / "d*"))
    query = stream.writeStream.foreachBatch(lambda df, n: kept.extend(r["id"] for r in index(df, n).collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sorted(kept) == [0, 1, 2, 10, 11, 12, 20, 21, 22] or sorted(x for x in kept if x < 100) == [1, 2, 10, 11, 12, 20, 21, 22]
    assert len(kept) == 9  # the text of which four rows are near copies is kept once


def test_an_empty_batch(spark, frame, tmp_path):
    index = BandIndex(str(tmp_path / "index"), "id", "t")
    assert index(frame([]), 0).collect() == []
    assert [r["id"] for r in index(frame(rows_of([(1, "a b c")])), 1).collect()] == [1]
