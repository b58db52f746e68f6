"""Operator 13 against whole-text encodings and all pairs of tokens, token by token."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from litsieve.llm import align
from litsieve.llm.tokens import _CHARS, TOKENIZER, tokenizer_path
from tests.llm.corpus import ODD, documents, empty

AWKWARD = [
    "",
    " ",
    "plain words",
    " lead and tail ",
    "two  spaces\n\nand lines\n \n x\ty",
    "a\r\nb\r c",
    "été 你好 \U0001f600 é",
    "under▁score",
    "<|endoftext|> <s> </s> <unk> <0x0A> x<|endoftext|>y",
    "nul\x00byte \x0b\x0c z",
    "nb sp   　全角",
    "don't we'll 12345 1,234.5 --- !!!???",
    "x" * 3000,
    "﻿bom ￿",
    "line\nline\nline a\nb",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(align.PIECES))


def tokens(libraries, text):
    """``(id, bytes)`` lists of both tokenizers for one whole text, or two empty ones."""
    a, b = libraries
    raw = {c: k for k, c in enumerate(_CHARS)}
    left = [(k, bytes(raw[c] for c in a.id_to_token(k))) for k in a.encode(" " + (text or ""), add_special_tokens=False).ids]
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    right = [(k, piece(k)) for k in b.encode(text or "")]
    want = (" " + (text or "")).encode()
    if not text or b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
        return [], []
    return left, right


def spans(side):
    at, out = 0, []
    for k, x in side:
        out.append((k, at, at + len(x)))
        at += len(x)
    return out


def brute(libraries, rows):
    links, per = Counter(), []
    for i, text in rows:
        left, right = map(spans, tokens(libraries, text))
        own, first = [], 0
        for k, s, e in left:
            while first < len(right) and right[first][2] <= s:
                first += 1
            j = first
            while j < len(right) and right[j][1] < e:
                own.append((k, right[j][0]))
                j += 1
        links.update(own)
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups, lo = [], 0
        for c in cuts:
            groups.append(",".join(str(k) for k, s, e in left if lo <= s < c) + "|" + ",".join(str(k) for k, s, e in right if lo <= s < c))
            lo = c
        per.append((i, len(left), len(right), len(groups), own, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = Counter()
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    return [(i, a, b, g, len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own), h) for i, a, b, g, own, h in per]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_ids_are_those_of_whole_texts(libraries):
    coder = align.coder(tokenizer_path(TOKENIZER), tokenizer_path(align.PIECES))
    a, a_at, b, b_at = coder.encode(pa.array(AWKWARD))
    for k, t in enumerate(AWKWARD):
        left, right = tokens(libraries, t)
        assert a[a_at[k] : a_at[k + 1]].tolist() == [x for x, _ in left], t
        assert b[b_at[k] : b_at[k + 1]].tolist() == [x for x, _ in right], t


@pytest.mark.parametrize("held", [align.PAIRS_HELD, 50, 0])
def test_odd_rows_and_any_number_of_held_pairs(spark, libraries, held):
    rows = [(i, t if t is None else t[:4000]) for i, t in ODD] + [(100 + k, t) for k, t in enumerate(AWKWARD)] + [(100, "plain words"), (None, None)]
    got = align.align(documents(spark, rows), pairs_held=held)
    assert ordered(got.collect()) == ordered(brute(libraries, rows))
    assert align.align(empty(spark), pairs_held=held).count() == 0


def test_whole_query(spark, sf, libraries):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in align.op13_token_alignment(spark, sf).collect()}
    cut = {i for i, t in rows if len(t) < 20_000}
    want = {r[0]: r for r in _shortened(libraries, rows, cut)}
    assert set(got) == set(want)
    for i, r in want.items():
        assert got[i] == r if i in cut else got[i][1:3] + got[i][4:7] == r[1:3] + r[4:7], i


def _shortened(libraries, rows, cut):
    """Brute force whose group listings of long texts (quadratic) are left out."""
    links, per = Counter(), []
    for i, text in rows:
        left, right = map(spans, tokens(libraries, text))
        own, first = [], 0
        for k, s, e in left:
            while first < len(right) and right[first][2] <= s:
                first += 1
            j = first
            while j < len(right) and right[j][1] < e:
                own.append((k, right[j][0]))
                j += 1
        links.update(own)
        per.append((i, text, len(left), len(right), own))
    top = Counter()
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    out = []
    for i, text, a, b, own in per:
        whole = brute(libraries, [(i, text)])[0] if i in cut else (i, a, b, -1, len(own), 0, 0, "")
        out.append((i, a, b, whole[3], len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own), whole[7]))
    return out


def test_batches_of_any_size(spark, libraries, monkeypatch):
    rows = [(k, t) for k, t in enumerate(AWKWARD)]
    column = pa.array([t for _, t in rows])
    coder = align.coder(tokenizer_path(TOKENIZER), tokenizer_path(align.PIECES))
    whole = align.Alignment(*coder.encode(column), coder.a_len, coder.b_len)
    for k in range(len(rows)):
        one = align.Alignment(*coder.encode(column.slice(k, 1)), coder.a_len, coder.b_len)
        assert one.n_groups()[0] == whole.n_groups()[k]
        assert list(one.listings(align.digits(60_000)))[0] == list(whole.listings(align.digits(60_000)))[k]
