import hashlib
import pickle
import random
import re

import pytest

from litsieve.llm import decontam, pii

from .corpus import ODD, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, size=10):
    own, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        n = min(size, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for p in range(len(own) - n + 1 if n else 0):
            if tuple(own[p : p + n]) in grams:
                hit.update(range(p, p + n))
                found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    vocab = ["alpha", "Béta", "gamma2", "d", "E", "zeta-x", "你"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ".", ",", "\n"]) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 9, 10, 11, 25]))) for k in range(10, 30)] + [(7, None), (8, "..."), (9, ""), (10, say(12))]
    rows = ODD + [(100 + k, say(rng.randrange(60)) + " " + items[k % 20][1]) for k in range(60)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return rows, [x for x in items if x[1]], bench


@pytest.mark.parametrize("chunk", [1 << 20, 1500])
def test_hits_equal_brute_force(spark, tables, chunk):
    rows, items, bench = tables
    got = [tuple(r) for r in decontam.scan(documents(spark, rows), bench, chunk_bytes=chunk).collect()]
    want = [(i, *brute(t, items)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_clean_leaves_no_window(spark, tables, mode):
    rows, items, bench = tables
    docs = documents(spark, rows)
    out = decontam.clean(docs, bench, mode)
    assert out.schema == docs.schema
    kept = out.collect()
    assert not any(brute(r.text, items)[4] for r in kept)
    sound = [i for i, t in rows if not brute(t, items)[4]]
    assert len(kept) == (len(sound) if mode == "documents" else len(rows))
    if mode == "spans":
        assert all(r.text is None or r.n_chars == len(r.text) for r in kept)


def test_windows_take_few_bytes():
    """Items of 4 MB in short, mostly distinct words: the arrays stay within what the size check counts."""
    rng = random.Random(2)
    items = [(str(k), " ".join(f"{rng.randrange(10**5):x}" for _ in range(200))) for k in range(4000)]
    text = sum(len(t) + len(i) + 64 for i, t in items)
    built = decontam.Windows(items)
    assert built.nbytes() <= text + decontam.WORD_BYTES * 200 * len(items)
    assert len(pickle.dumps(built)) < 1.1 * built.nbytes() + 100 * len(items)
    own = [f"x {items[7][1]} y".encode(), b"", items[9][1].encode()]
    (a, found), (b, none), (c, also) = decontam.judge(own, [built])
    assert (a.sum(), found, len(b), none, c.all(), also) == (200, {"7"}, 0, set(), True, {"9"})


def test_decontam_of_nothing(spark, tables):
    _, _, bench = tables
    assert decontam.scan(empty(spark), bench).count() == 0
    assert {r.contaminated for r in decontam.scan(documents(spark, ODD), bench.limit(0)).collect()} == {False}


def regexes(text):
    out = []
    for kind, p in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    bits = ["@", ".", "-", "+", " ", "(", ")", "a", "Zb", "%", "_", "1", "255", "256", "00", "9" * 5, "4111111111111111", "4111 1111 1111 1111", "x.org", "İ", "é", "://", "10.0.0.1", "+49 30 1234567", "iban", "account: "]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == regexes(text), text


def test_added_kinds_and_redaction():
    text = "IBAN: DE89 3704 0044 0532 0130 00 and SSN 123-45-6789, https://me:secret@host.example.org/x acct no. 12345678"
    kinds = {k for k, _, _ in pii.find(text)}
    assert {"iban", "ssn", "url_user", "account"} <= kinds
    out = pii.redact(text, pii.find(text))
    assert "secret" not in out and "6789" not in out and "0532" not in out and "12345678" not in out


def test_secrets_follow_their_cues():
    key = "a1" * 12
    for text in (f'token = "{key}"', f"API_KEY: {key}", f"Authorization: Bearer {key}", f"password={key}", f'"secret": "{key}"'):
        (span,) = [s for s in pii.find(text) if s[0] == "secret"]
        assert text[span[1] : span[2]] == key
    for text in ("the token of gratitude", "a secret", "token = short1", "tokens are counted", "password: onlylettersinthisone", f"mytoken {key}"):
        assert not [s for s in pii.find(text) if s[0] == "secret"]


def test_digit_anchors_equal_the_patterns():
    rng = random.Random(19)
    for _ in range(20_000):
        text = "".join(rng.choice("0011 25 5..--+x") for _ in range(rng.randrange(40)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == regexes(text), text


def test_long_runs_are_linear():
    for unit in ("a", "1", "1.", "+1", "@", "a@", "1 ", "-", "+1(", "1.1", "token=", "token a1", "secret: ", "1-1 ", "11.11.x"):
        pii.find(unit * 200_000)


def test_scan_of_odd_tables(spark):
    rows = [*ODD, (50, "mail a.b@c.de or +1 (555) 010-9999")]
    got = pii.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    (r,) = [r for r in got if r.doc_id == 50]
    base = "email:5:13,phone:17:34"
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 0, 0, 1, base)
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    docs = documents(spark, rows)
    red = pii.redacted(docs)
    assert red.schema == docs.schema and pii.scan(red).where("spans <> ''").count() == 0
    assert pii.scan(empty(spark)).count() == 0 and pii.redacted(empty(spark)).count() == 0
