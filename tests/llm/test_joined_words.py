"""Words of letters go to the library together, with the ids that they have alone."""

import itertools

import numpy as np

from litsieve.llm import sstable, tokens

LETTERS = "aeiourstlnmäöüßéñçœřžłαβγδжщыĠĊſǅ"


class Counted:
    def __init__(self, own):
        self.own, self.calls = own, 0

    def encode_batch_fast(self, *a, **kw):
        self.calls += 1
        return self.own.encode_batch_fast(*a, **kw)


def test_words_of_letters_share_calls_and_keep_their_ids():
    enc = tokens.SegmentEncoder(tokens.tokenizer_path())
    enc.joined = Counted(enc.joined)
    words = ["".join(w) for w in itertools.islice(itertools.product(LETTERS, LETTERS, "nqé", LETTERS), 0, 60_000, 13)]
    text = "x " + " ".join(words)
    assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert 0 < enc.joined.calls <= len(words) / 25


def test_shard_writers_encoder_remembers_more_and_forgets_the_later_ones():
    assert tokens.encoder(tokens.tokenizer_path(), limit=sstable.CACHED).limit > tokens.encoder(tokens.tokenizer_path()).limit
    enc = tokens.SegmentEncoder(tokens.tokenizer_path(), limit=30)
    for k in range(0, 100, 10):
        text = " ".join(f"w{i}x" for i in range(k, k + 10))
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids
        assert len(enc.cache) <= 30
    enc.forget()
    assert "w1x" in enc.cache and len(enc.cache) <= 10
