import base64
import gzip
import hashlib
import io
import json
import math
import random
from collections import Counter

import numpy as np
import pytest

from litsieve.llm import topk, warc
from litsieve.storage import fresh_dir

SCHEMA = "page_id long, url string, html string, payload string, d string, n string, first string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], SCHEMA)


PAGES = [
    (5, "http://a/1", "<p>same</p>"),
    (3, "http://a/2", "<p>same</p>"),
    (9, "http://a/3", "<p>same</p>"),
    (3, "http://a/2b", "<p>same</p>"),
    (1, None, None),
    (2, "http://a/\r\nX: y", ""),
    (None, "u", "<p>same</p>"),
    (7, "http://a/é", "é\r\n\r\nWARC/1.1\r\n" * 3),
    (8, "http://a/long", "z" * 700_000),
    (10, "http://a/10", "unique"),
]


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def brute(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= min_bytes:
            first[h or ""] = min(first.get(h or "", i), i)
    out = Counter()
    for i, _, h in rows:
        f = first.get(h or "")
        again = i is not None and f is not None and i > f and len((h or "").encode()) >= min_bytes
        out[i, len((h or "").encode()), digest(h), "revisit" if again else "response", f if again else None] += 1
    return out


@pytest.mark.parametrize("min_bytes", [0, 5, 100])
def test_archives_round_trip(spark, min_bytes):
    uri = fresh_dir(spark, "t")
    files = warc.write(pages(spark, PAGES), f"{uri}/m", min_bytes)
    got = warc.read(spark, warc.normalise_all(spark, files, f"{uri}/n"))
    assert Counter(tuple(r) for r in got.collect()) == brute(PAGES, min_bytes)


def test_no_pages(spark):
    files = warc.write(pages(spark, []), fresh_dir(spark, "t"))
    assert files == [] and warc.read(spark, warc.normalise_all(spark, files, "x")).count() == 0


def test_normaliser_splits_one_stream_into_members():
    own = [warc.record(k, f"http://x/{k}", b"p" * (k * 1000), None) for k in range(30)]
    whole = gzip.compress(b"".join(own[:10])) + gzip.compress(b"".join(own[10:]))
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(whole), out, index) == 30
    raw = out.getvalue()
    for line, want in zip(index.getvalue().splitlines(), own, strict=True):
        at = json.loads(line)
        assert gzip.decompress(raw[at["offset"] : at["offset"] + at["length"]]) == want
    assert gzip.decompress(raw) == b"".join(own)
    with pytest.raises(ValueError):
        list(warc.records([own[1][:-30]]))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")


def brute_topk(rows, queries, k):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i in queries}):
        qv = min([v for i, v in ok if i == q])
        s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BYTES", 4000)
    monkeypatch.setattr(topk, "TILE_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(4)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)]
    rows += [(400, None), (420, [1.0, None, 0.0, 0.0]), (440, [float("nan")] * 4), (460, [float("inf")] * 4), (480, []), (500, [1.0, 2.0]), (520, [0.5, 0.5]), (None, [1.0] * 4), (20, [0.1] * 4)]
    df = vectors(spark, rows)
    got = sorted(tuple(r) for r in topk.search(df.repartition(5), df.where("vec_id % 20 = 0"), 20).collect())
    assert got == brute_topk(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)


def test_topk_of_few_and_none_and_large_values(spark):
    df = vectors(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0])])
    assert [tuple(r) for r in topk.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 64 * 64 * 1)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    big = vectors(spark, [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0])])
    got = [tuple(r) for r in topk.search(big, big.where("vec_id = 0")).collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
