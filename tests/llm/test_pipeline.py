import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from litsieve.llm import packing, pii, registry, toxicity
from litsieve.llm.tokens import tokenizer_path
from litsieve.storage import materialize

from .test_decontam_pii import brute as contaminated
from .test_stage_jaccard import components


def test_pipeline_equals_the_stages_by_brute_force(spark, sf):
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.score(t or "") < 0.5]
    assert len(rows) > 100
    first = components(rows)
    rows = [(i, t) for i, t in rows if first[i] == i]
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(i, t) for i, t in rows if not contaminated(t, items)[4]]
    rows = [(i, pii.redact(t, pii.find(t))) for i, t in rows]
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "stage-test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() > 0, name


def test_ten_operators_are_registered():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in registry.queries()


def test_licence_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(registry.oracle_sql()["op4_license_scan"])
    got = registry.queries()["op4_license_scan"](spark, sf)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
