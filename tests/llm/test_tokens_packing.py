import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from litsieve.llm import packing, sstable
from litsieve.llm.tokens import SegmentEncoder, tokenizer_path
from litsieve.storage import fresh_dir

from .corpus import ODD, documents, empty


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def brute(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_segments_equal_whole_text_encoding(tok):
    rng = random.Random(3)
    bits = ["a", "the", "Wort", "é", " ", "  ", "\n", "\t", "'s", "12", "!?", "你", " ", "\x1c", "<|endoftext|>", " ", "y" * 70]
    some = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(400)]
    for limit in (1_000_000, 20):
        enc = SegmentEncoder(tokenizer_path(), limit=limit)
        got = [y for k in range(0, len(some), 50) for y in enc.encode_all(some[k : k + 50])]
        assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [brute(tok, t) for t in some]


def test_packing_keeps_every_token_once(spark, tok):
    rows = packing.pack(documents(spark, ODD)).collect()
    want = Counter()
    for doc_id, text in ODD:
        ids = [*brute(tok, text), 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024


def test_only_the_first_piece_is_shorter():
    assert packing.cut(1, 1024) == [(0, 1)]
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_packing_of_nothing(spark):
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_the_histogram_and_is_near_the_bound(seed):
    rng = random.Random(seed)
    hist = Counter(rng.choice([rng.randrange(1, 1025), rng.randrange(500, 700), 1024]) for _ in range(20_000))
    bins = packing.plan(dict(hist))
    got = Counter()
    for b in bins:
        assert 0 <= b.free == 1024 - sum(n * k for n, k in b.slots)
        for n, k in b.slots:
            got[n] += k * b.count
    assert got == hist
    first_fit = packing._BestFit(1024, [])
    for n in sorted(hist, reverse=True):
        first_fit.place(n, hist[n])
    assert sum(b.count for b in bins) <= 1.01 * sum(b.count for b in first_fit.done())


@pytest.mark.parametrize("hist", [{}, {1024: 5}, {1: 3}, {600: 7}, {512: 9, 513: 4}, {300: 1, 1024: 1, 2: 1}])
def test_plan_of_small_histograms(hist):
    got = Counter()
    for b in packing.plan(hist):
        for n, k in b.slots:
            got[n] += k * b.count
    assert got == hist


def test_shards_round_trip_and_lookup(spark, tok):
    docs = documents(spark, ODD)
    manifest = sstable.write_shards(docs, fresh_dir(spark, "t"), shards=3)
    rows = [tuple(r) for r in sstable.read_shards(spark, manifest).collect()]
    want, at = [], 0
    for doc_id, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*brute(tok, text), 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(rows, key=lambda r: r[1]) == want
    wanted = spark.createDataFrame([(1,), (5,), (77,), (None,)], "doc_id long")
    found = Counter(r.doc_id for r in sstable.lookup(spark, manifest, wanted).collect())
    assert found == {1: 2, 5: 1, None: 1}
    assert sum(sstable.ShardReader(m[1]).may_hold(10_000 + k) for m in manifest for k in range(300)) < 60


def test_hot_ids_fill_several_shards(spark, tok):
    rows = [(i, f"text {i}") for i in range(100)] + [(41, "the same copy")] * 150 + [(41, f"other {i}") for i in range(150)] + [(None, "no id")] * 90 + [(None, None)] * 60
    docs = documents(spark, rows).repartition(3)
    manifest = sstable.write_shards(docs, fresh_dir(spark, "t"), shards=10)
    sizes = [m[2] for m in manifest]
    assert sum(sizes) == len(rows) and max(sizes) < 0.25 * len(rows)
    got = sorted((tuple(r) for r in sstable.read_shards(spark, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    crc = lambda t: zlib.crc32(np.array([*brute(tok, t), 0], dtype="<u4").tobytes())
    assert Counter((r[0], r[3]) for r in got) == Counter((i, crc(t)) for i, t in rows)
    wanted = spark.createDataFrame([(41,), (41,), (None,), (7,), (500,)], "doc_id long")
    assert Counter(r.doc_id for r in sstable.lookup(spark, manifest, wanted).collect()) == {41: 301, None: 150, 7: 1}


def test_shards_of_nothing(spark):
    manifest = sstable.write_shards(empty(spark), fresh_dir(spark, "t"))
    assert manifest == [] and sstable.read_shards(spark, manifest).count() == 0
    assert sstable.lookup(spark, manifest, spark.range(3).withColumnRenamed("id", "doc_id")).count() == 0


def test_many_blocks(spark, tmp_path):
    from litsieve.llm.files import atomic_write

    uri = f"{tmp_path}/a/b.sst"
    with atomic_write(uri) as f:
        w = sstable.ShardWriter(f, block_bytes=200)
        for k in range(0, 2000, 2):
            w.add(sstable.key_of(k), sstable.encode_value(np.array([k, 70_000], dtype="<u4").tobytes()), 2)
        w.finish()
    r = sstable.ShardReader(uri)
    assert len(r.index) > 20 and [i for i, _ in r.scan()] == list(range(0, 2000, 2))
    assert r.get(500)[0].tolist() == [500, 70_000] and r.get(501) == [] and r.get(5000) == []
