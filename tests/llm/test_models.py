import math
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from litsieve.llm import licenses, perplexity, toxicity
from litsieve.storage import materialize

from .corpus import ODD, documents, empty


def labelled(spark, rows):
    return spark.createDataFrame([(i, q, t) for i, q, t in rows], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(600)]
    stems = ["zorkum", "quazzle", "vixtra"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 40, 200]))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "s", "ing", "ed", "."]))
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, 1, int(bad)))
    truth = {i: t for i, _, t in labels}
    return rows, labels, truth


def test_held_out_accuracy(spark, toxic_corpus):
    rows, labels, truth = toxic_corpus
    docs = documents(spark, rows)
    got = toxicity.scored(docs, toxicity.train(docs, labelled(spark, labels))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(p == t for p, t in held) / len(held) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark, toxic_corpus):
    import zlib

    rows, labels, _ = toxic_corpus
    docs = documents(spark, rows)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.train(docs, labelled(spark, x)) for x in (labels, turned))
    assert (a.theta == b.theta).all() and a.bias == b.bias


def test_toxicity_of_odd_tables(spark, toxic_corpus):
    docs = documents(spark, ODD)
    model = toxicity.train(docs, labelled(spark, []))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 and math.isfinite(r.score) for r in got)
    assert toxicity.scored(empty(spark), model).count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and kept.count() == len(ODD)
    assert toxicity.train(documents(spark, [(1, "a"), (2, None)]), labelled(spark, [(1, 1, 1), (2, None, 1), (None, 1, 1)])) is not None


def brute_perplexities(rows, trusted, order):
    """Interpolated modified Kneser-Ney over byte strings, with dictionaries."""
    padded = lambda t: b"\x00" * (order - 1) + t.encode()
    counts = {k: Counter() for k in range(1, order + 1)}
    for i, t in rows:
        if i in trusted:
            raw = padded(t)
            counts[order].update(raw[j : j + order] for j in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    stats, d = {}, {}
    for k, c in counts.items():
        n = Counter(min(v, 5) for v in c.values())
        d[k] = perplexity.discounts_of(n[1], n[2], n[3], n[4])
        total, mass = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[k][min(v, 3) - 1]
        stats[k] = total, mass

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        total, mass = stats[k]
        lower = p(g[1:])
        if g[:-1] not in total:
            return lower
        c = counts[k][g]
        own = max(c - d[k][min(c, 3) - 1], 0) if c else 0
        return own / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * lower

    out = []
    for i, t in rows:
        raw = padded(t or "")
        grams = [raw[j : j + order] for j in range(len(raw) - order + 1)]
        out.append((i, math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)) if grams else None))
    return out


@pytest.mark.parametrize("folds", [2, 4])
def test_perplexity_equals_brute_force(spark, folds):
    rng = random.Random(2)
    words = ["the", "and", "été", "of", "sand", "thing", "ring"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(60)] + [(70, "zzqx##!"), (71, ""), (72, None), (73, "the")]
    docs = documents(spark, rows)  # not from files
    trusted = set(range(0, 60, 2))
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    fold = {r[0]: r[1] for r in ids.select("doc_id", perplexity.fold_of(F.col("doc_id"), folds)).collect()}
    assert len(set(fold.values())) == folds
    got = {r.doc_id: r for r in perplexity.judge(docs, ids, quantile=0.9, folds=folds).collect()}
    want = dict(brute_perplexities(rows, trusted, perplexity.ORDER))
    for f in range(folds):  # a trusted document is judged by the other folds
        other = dict(brute_perplexities(rows, {i for i in trusted if fold[i] != f}, perplexity.ORDER))
        want |= {i: other[i] for i in trusted if fold[i] == f}
    for i, value in want.items():
        assert (got[i].perplexity is None) if value is None else got[i].perplexity == pytest.approx(value, rel=1e-9)
    by_value = sorted(want[i] for i in trusted)
    limit = by_value[math.ceil(0.9 * len(by_value)) - 1]
    assert {round(r.threshold, 9) for r in got.values()} == {round(limit, 9)}
    assert {i: r.keep for i, r in got.items()} == {i: v is not None and v <= limit * (1 + 1e-12) for i, v in want.items()}
    assert not got[70].keep and not got[71].keep and not got[72].keep


def test_unseen_good_text_is_kept_as_trusted_text_is(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8))) for _ in range(4000)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 90))) for _ in range(300)]
    rows = list(enumerate(good)) + [(1000 + k, "".join(rng.choice("nopqrstuvwxyz .") for _ in range(300))) for k in range(40)]
    got = perplexity.judge(documents(spark, rows), spark.range(0, 300, 2).withColumnRenamed("id", "doc_id"), quantile=0.95).collect()
    share = lambda own: sum(r.keep for r in own) / len(own)
    trusted, unseen = ([r for r in got if r.doc_id < 300 and r.doc_id % 2 == k] for k in (0, 1))
    assert abs(share(trusted) - 0.95) < 0.02 and share(unseen) > share(trusted) - 0.04
    assert not any(r.keep for r in got if r.doc_id >= 1000)


def test_trusted_ids_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"some words number {i % 7}") for i in range(40)] + [(None, "x y"), (3, "again")]
    ids = spark.range(0, 40, 3).withColumnRenamed("id", "doc_id")
    ask = lambda: sorted((str(r.doc_id), round(r.perplexity, 9), r.keep) for r in perplexity.judge(documents(spark, rows), ids).collect())
    small = ask()
    monkeypatch.setattr(perplexity, "BROADCAST_BYTES", 0)
    assert ask() == small


def test_probabilities_sum_to_one(spark):
    grams = Counter({int.from_bytes(b"abcd" + bytes([c])): c - 96 for c in range(97, 103)})
    counts = spark.createDataFrame(list(grams.items()), "gram long, c0 long")
    every = spark.createDataFrame([(int.from_bytes(b"abcd" + bytes([c])), True) for c in range(256)], "gram long, a0 boolean")
    total = sum(math.exp(r.l0) for r in perplexity.probabilities(every, counts).collect())
    assert total == pytest.approx(1, rel=1e-9)


def test_perplexity_of_odd_tables(spark):
    docs = materialize(documents(spark, ODD), "t")
    none = spark.createDataFrame([], "doc_id long")
    got = perplexity.judge(docs, none).collect()
    assert len(got) == len(ODD) and {round(r.perplexity) for r in got if r.perplexity} == {256}
    assert perplexity.judge(materialize(empty(spark), "t"), none).count() == 0


def licence_brute(rows, table):
    """Every unit of every text counted one by one, and bigrams given to the best unit over them."""
    import re

    def pairs(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if x]
        return list(zip(w, w[1:]))

    flat = [(f"{n}/{k}", n, pairs(t)) for n, ts in table.items() for k, t in enumerate(ts)]
    want: dict = {}
    for i, text in {(i, t) for i, t in rows if t is not None}:
        own = pairs(text)
        units = {}
        for name, lic, t in flat:
            bag = Counter(t)
            if not any(p in bag for p in own):
                continue
            step = max(1, len(t) // 8)
            for m in licenses.sizes(len(t)):
                for start in range(0, len(own), step):
                    part = own[start : start + m]
                    dice = 2 * sum((Counter(part) & bag).values()) / (len(part) + len(t))
                    if dice >= licenses.THRESHOLD:
                        units[-dice, -len(part), name, start] = lic
        held = Counter()
        for p in range(len(own)):
            over = [u for u in units if u[3] <= p < u[3] - u[1]]
            if over:
                held[min(over)] += 1
        for u, c in held.items():
            if 2 * c > -u[1]:
                k, top = want.get((i, units[u]), (0, 0.0))
                want[i, units[u]] = (k + 1, max(top, round(-u[0], 6)))
    return want


def licence_result(df):
    return {(r.doc_id, r.license): (r.n_units, r.best_dice) for r in df.collect()}


def test_licences_equal_brute_force(spark):
    rng = random.Random(6)
    flat = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rows = [(i, t) for i, t in ODD if t is None or len(t) < 6000]
    for i in range(100, 150):
        t = rng.choice(flat).split()
        for _ in range(rng.randrange(0, 1 + len(t) // 5)):
            t[rng.randrange(len(t))] = rng.choice(["foo", "the", "License"])
        lines = [" ".join(t)] + [f"filler line {k}" for k in range(rng.randrange(3))] + ([" ".join(rng.choice(flat).split())] if rng.random() < 0.3 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [rows[-1], (149, rows[-2][1]), (None, rows[-3][1]), (None, rows[-4][1])]
    got = licence_result(licenses.scan(documents(spark, rows), licenses.templates(spark, licenses.TEMPLATES)))
    assert got == licence_brute(rows, licenses.TEMPLATES) and len(got) > 30
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(documents(spark, [(5, "word " * 30_000)])).count() == 0


def test_wrapped_and_embedded_licences_are_found(spark):
    """Every template, wrapped at 12 words with comment signs between lines of code, inside one longer line, and by itself."""
    rows, want = [], {}
    for name, ts in licenses.texts().items():
        for t in ts:
            w = t.split()
            code = [f"x{k} = call{k % 7}(y{k})" for k in range(70)]
            wrapped = ["# " + " ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
            for text in ("\n".join(code[:31] + wrapped + code[31:]), " ".join(code[:9] + w + code[9:]), t):
                want[len(rows)] = name
                rows.append((len(rows), text))
    got = licence_result(licenses.scan(documents(spark, rows)))
    # complete texts quote the short statements of other licences nowhere; their own notice may count beside them
    assert {i: n for i, n in got} == want and len(got) == len(want)
    assert min(d for _, d in got.values()) >= 0.93


def test_no_licence_in_plain_prose(spark):
    rows = [(1, "the terms of the agreement and the conditions of the sale " * 300), (2, "Copyright the authors. All rights reserved. See the file for details.")]
    assert licenses.scan(documents(spark, rows)).count() == 0


def test_licence_plan_has_no_python(spark):
    plan = licenses.scan(documents(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
