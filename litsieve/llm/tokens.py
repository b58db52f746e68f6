"""Exact byte-level BPE encoding of whole texts with the tokenizers library, at word-cache speed.

The byte-level pre-tokeniser never joins a piece across a single U+0020 that stands between two
non-space characters: the space starts the next piece. So a text falls apart at those spaces, each
segment (a word with its leading space, or the line end that takes its place) is encoded once by the
library, and equal segments reuse their ids. Texts with other white space next to a space are cut only where both neighbours are
non-space; texts with the special token's string go to the library undivided. The ids are those of
one call on the whole text.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from litsieve.llm.common import ON_RELEASE

TOKENIZER = "byte_bpe_50k.json"
_LONG = 64
#: Bytes of text whose ids are put together at once.
_SLICE = 2 << 20
#: Words of letters in one call of the library.
_TOGETHER = 50
#: Fixed values of the byte-level scheme: how it cuts texts, and the printable character of each byte.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: b if b in _SHOWN else 256 + k for k, b in [(sum(x not in _SHOWN for x in range(b)), b) for b in range(256)]}
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CHARS = [chr(_BYTES[b]) for b in range(256)]
_MARKS = frozenset(".,;:!?")
_LOADED: dict[tuple[str, bool, int], "SegmentEncoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _shown(piece: str) -> str:
    """A piece in the scheme's printable characters."""
    return "".join(map(_CHARS.__getitem__, piece.encode()))


class SegmentEncoder:
    """``encode(text)`` gives little-endian unsigned 32-bit ids as bytes.

    ``limit`` bounds the cached segments (about 200 bytes each); a full cache falls back to the common ones.
    ``special_as_text`` makes the special token's string in a text ordinary text (default: the
    library's own default, one special id).
    """

    def __init__(self, path: str, special_as_text: bool = False, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.named = any(s.isalnum() for s in self.special)
        self.limit = limit
        self.cache: dict[str, bytes] = {}

        # the same model over words in printable characters, cut before each one's space; no other token starts with a space
        self.joined = Tokenizer(self.tok.model)
        self.joined.pre_tokenizer = Split("\u0120", "merged_with_next")
        vocabulary = self.tok.get_vocab()
        self.heads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.heads[[k for token, k in vocabulary.items() if token[0] == "\u0120"]] = True
        self.pattern = regex.compile(_PATTERN)
        self.small: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, shown: list[str]) -> list[bytes]:
        """Ids of each word of letters after one space, given in printable characters."""
        out: list[bytes] = []
        for at in range(0, len(shown), _TOGETHER):
            some = "\u0120" + "\u0120".join(shown[at : at + _TOGETHER])
            ids = np.array(self.joined.encode_batch_fast([some], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts, raw = (np.flatnonzero(self.heads[ids]) * 4).tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word after one space, or after the line end it starts with.

        Words of letters, digits and marks below U+0530 are cut by the pre-tokeniser's own pattern and
        their pieces go straight to the library's BPE model; all others go through its whole pipeline.
        """
        out, later, plain, shown = [], [], [], []
        tokenize, small, known = self.tok.model.tokenize, self.small, self.cache
        for w in words:
            if w.isascii():
                if w.isalpha():
                    plain.append(len(out))
                    shown.append(w)
                    out.append(b"")
                    continue
            elif max(w) >= "\u0530":
                later.append(len(out))
                out.append(w)
                continue
            elif w.isalpha():
                plain.append(len(out))
                shown.append(_shown(w))
                out.append(b"")
                continue
            # letters and one mark are two pieces; anything else is cut by the pattern
            body = w[:-1]
            ids = b""
            for piece in (" " + body, w[-1]) if w[-1] in _MARKS and body.isalpha() else self.pattern.findall(w if w[0] == "\n" else " " + w):
                own = small.get(piece) or (known.get(piece[1:]) if piece[0] == " " else None)
                if own is None:
                    own = small[piece] = array("I", [t.id for t in tokenize(_shown(piece))]).tobytes()
                ids += own
            out.append(ids)
        if len(small) > self.limit // 4:
            small.clear()
        for k, ids in zip(plain, self._letters(shown), strict=True):
            out[k] = ids
        for k, ids in zip(later, self._library([out[k] if out[k][0] == "\n" else " " + out[k] for k in later]), strict=True):
            out[k] = ids
        return out

    def forget(self) -> None:
        """Keep the segments met first, which are the common ones; a dictionary remembers its order."""
        keep = self.limit // 3
        self.cache = dict(islice(self.cache.items(), keep))
        self.small = dict(islice(self.small.items(), keep))

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, null as empty."""
        return self.encode_column(pa.array([t or "" for t in texts], type=pa.string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Ids of each string of a column without nulls, of about ``_SLICE`` bytes of whole texts at a time."""
        size = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
        out: list[bytes] = []
        while (at := len(out)) < len(column):
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _SLICE, side="right")))
            out += self._encode_slice(column.slice(at, upto - at))
        return out

    def _encode_slice(self, column: pa.Array) -> list[bytes]:
        """Arrow cuts the texts and numbers the distinct segments; Python sees each of those once; numpy puts the ids together."""
        n = len(column)
        gc.disable()  # nothing here is cyclic, and the cache is long to walk
        try:
            # a line end between two visible characters starts a segment too, one without a space
            lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = pc.dictionary_encode(lists.flatten())
            # by way of numpy: pyarrow's own lists make an object of each value first
            words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
            first = at[starts[:-1]]
            known, odd = self._lookup(words)
            careful = np.logical_or.reduceat(odd[at], starts[:-1]) if odd.any() else np.zeros(n, dtype=bool)
            ids = [*known, *self._library([words[k] for k in first.tolist()])]
            at[starts[:-1]] = len(words) + np.arange(n)
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            pool = np.frombuffer(b"".join(ids), dtype="<u4")
            begin = np.cumsum(sizes) - sizes
            each = sizes[at]
            ends = np.cumsum(each)
            raw = memoryview(pool[np.repeat(begin[at] - ends + each, each) + np.arange(ends[-1])]).cast("B")
            cuts = (np.concatenate([[0], ends])[starts] * 4).tolist()
            return [self._careful(column[k].as_py()) if careful[k] else bytes(raw[cuts[k] : cuts[k + 1]]) for k in range(n)]
        finally:
            gc.enable()

    def _lookup(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of each segment, and which ones need the careful cut of their text."""
        out = list(map(self.cache.get, words))
        odd = np.zeros(len(words), dtype=bool)
        missing = []
        for k, ids in enumerate(out):
            if ids is None:
                w = words[k]
                if w.isalnum() and not self.named:
                    missing.append(k)
                    continue
                inner = w[1:] if w[:1] == "\n" else w
                if not inner or inner[0].isspace() or inner[-1].isspace() or any(s in w for s in self.special):
                    odd[k], out[k] = True, b""
                else:
                    missing.append(k)
        if len(self.cache) + len(missing) > self.limit:
            self.forget()
        for k, ids in zip(missing, self._words([words[k] for k in missing]), strict=True):
            out[k] = ids
            if len(words[k]) <= _LONG:
                self.cache[words[k]] = ids
        return out, odd

    def _careful(self, text: str) -> bytes:
        """Spaces in a row or beside other white space: cut only between non-space characters."""
        if not text or any(s in text for s in self.special):
            return self._library([text])[0] if text else b""
        own = _SAFE.split(text)
        rest = list(map(self.cache.get, own[1:]))
        lack = [k for k, ids in enumerate(rest) if ids is None]
        for k, ids in zip(lack, self._library([" " + own[k + 1] for k in lack]), strict=True):
            rest[k] = ids
        return self._library(own[:1])[0] + b"".join(rest)


def encoder(path: str, special_as_text: bool = False, limit: int = 300_000) -> SegmentEncoder:
    """One encoder for each Python worker."""
    key = (path, special_as_text, limit)
    if key not in _LOADED:
        _LOADED[key] = own = SegmentEncoder(path, special_as_text, limit)
        ON_RELEASE.append(own.forget)
    return _LOADED[key]
