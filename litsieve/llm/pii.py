"""Operator 10: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, URL schemes, identifier cues such as "iban",
a dot between two digits (addresses), and two digits with at most a space or a hyphen between them (account numbers).
From each anchor a deterministic local parser grows the span to its boundaries and validates it.
The four base kinds (email, ip, card, phone) equal the leftmost non-overlapping matches of their
patterns; parsers look at each character a bounded number of times, also in one very long run.
The method's own kinds follow them: ``url_user`` (user:password in a URL), ``iban`` (mod-97
checked), ``ssn`` and ``account`` (digits after a cue), ``secret``: after a cue such as "token =" a key of 16 or more characters
with letters and digits, after a password cue and a sign of assignment any value (but for a bare word after ": ", which is prose;
after "is" one with letters and digits), and
keys that show themselves by their head (``KEYS``). They add spans and never replace base ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from litsieve.llm.common import batches, doc_rows, texts, tidy, tune

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url_user", "iban", "ssn", "account", "secret")
#: Identifier cues, matched in lower case with an optional separator behind.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account", "token": "secret", "secret": "secret", "password": "password", "passwd": "password", "passphrase": "password", "api key": "secret", "api_key": "secret", "api-key": "secret", "apikey": "secret", "access key": "secret", "access_key": "secret", "bearer": "secret"}
_CUE_GAP = re.compile(r"(?: ?(?:number|no|nr|num|id)\b\.?)? ?[:=#]? ?", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,}+")
#: Neither part holds a slash, so a scan ends before the next scheme; no part is ever given back.
_USER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]++:[^\s/@]++(?=@)")
#: What stands between a cue and its secret: a sign of assignment, " is ", or a space after "bearer" and the like.
_SET = re.compile(r"[\"']?(?: ?(?:=>|:=|[:=]) ?| is | )?[\"']?")
#: A password's value behind a sign of assignment, up to the quote that opened it or to white space; behind " is " it needs letters and digits.
_PASSWORD = re.compile(r"[\"']? ?(?:=>|:=|[:=]) ?(?:\"(?P<double>[^\"\n]++)\"|'(?P<single>[^'\n]++)'|(?P<plain>[^\s\"']\S*+))")
_SAID = re.compile(r"[\"']? is [\"']?(?P<plain>[^\s\"']++)")
#: The heads of public key formats, in lower case, and what follows them.
KEYS = {"ghp_": r"[A-Za-z0-9]{36,}+", "gho_": r"[A-Za-z0-9]{36,}+", "github_pat_": r"[A-Za-z0-9_]{22,}+", "akia": r"[0-9A-Z]{16}(?![0-9A-Za-z])", "xoxb-": r"[0-9A-Za-z-]{20,}+", "xoxp-": r"[0-9A-Za-z-]{20,}+", "-----begin ": r"(?:[A-Z]+ ){0,3}?PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]+ ){0,3}?PRIVATE KEY-----)?"}
_KEYS = {k: re.compile(v) for k, v in KEYS.items()}
_SECRET = re.compile(r"[A-Za-z0-9_+/=.-]{16,}+")
_DIGITS = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[A-Za-z]")
_DECIMAL = frozenset("0123456789")
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        pairs = [(x, y) for x in "0123456789" for y in "0123456789"]
        digits = [(f"{x}{mark}{y}", tag) for x, y in pairs for mark, tag in (("", "card"), (" ", "card"), ("-", "card"), (".", "ip"))]
        for word, tag in [("@", "email"), ("+", "phone"), ("://", "url_user"), *digits, *((k, "key") for k in KEYS), *CUES.items()]:
            a.add_word(word, (tag, len(word)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _same_length_lower(text: str) -> str:
    """Lower case of the same length; where a letter's lower case is longer, only A-Z change."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind as listed; offsets count code points, the end is exclusive."""
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for end, (tag, size) in automaton().iter(_same_length_lower(text)):
        at, after = end - size + 1, end + 1
        if tag == "card":
            if at < done["card"]:
                continue
            m = _CARD.match(text, at)  # the first anchor of a run is at its first digit
            done["card"] = m.end()
            if m.end() - at >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append(("card", at, m.end()))
        elif tag == "ip":
            if at < done["ip"]:
                continue
            start = at
            while start > done["ip"] and text[start - 1] in _DECIMAL:
                start -= 1
            m = _IP.match(text, start)
            if m:
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append(("ip", start, m.end()))
        elif tag == "email":
            if at < done["email"]:
                continue
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            m = start < at and _DOMAIN.match(text, after)
            if m:
                found.append(("email", start, m.end()))
                done["email"] = m.end()
        elif tag == "phone":
            m = at >= done["phone"] and _PHONE.match(text, at)
            if m:
                done["phone"] = m.end()
                if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                    found.append(("phone", at, m.end()))
        elif tag == "url_user":
            m = _USER.match(text, after)
            if m:
                found.append(("url_user", after, m.end()))
        elif tag == "secret":
            if at < done["secret"] or (at and text[at - 1].isalnum()):
                continue
            start = _SET.match(text, after).end()
            m = start > after and _SECRET.match(text, start)
            if m:
                done["secret"] = m.end()  # what a failed run ends with fails too
                if _DIGITS.search(m[0]) and _LETTERS.search(m[0]):
                    found.append(("secret", start, m.end()))
        elif tag == "password":
            if at < done["secret"] or (at and text[at - 1].isalnum()):
                continue
            m = _PASSWORD.match(text, after) or _SAID.match(text, after)
            if m:
                where = m.lastgroup
                done["secret"] = m.end()
                prose = m.re is _SAID or (where == "plain" and text[m.start("plain") - 2 : m.start("plain")] == ": " and m["plain"].isalpha())
                if not prose or (_DIGITS.search(m[where]) and _LETTERS.search(m[where])):
                    found.append(("secret", *m.span(where)))
        elif tag == "key":
            m = at >= done["secret"] and not (at and text[at - 1].isalnum()) and _KEYS[text[at:after].lower()].match(text, after)
            if m:
                found.append(("secret", at, m.end()))
                done["secret"] = m.end()
        elif at >= done[tag] and not (at and text[at - 1].isalnum()):
            start = _CUE_GAP.match(text, after).end()
            m = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[tag].match(text, start)
            if m and start > after and (tag != "iban" or _iban_ok(m[0])):
                found.append((tag, start, m.end()))
                done[tag] = m.end()
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span as ``[KIND]``; overlapping spans become one, named after the first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    A null text is an empty one; rows with a null or repeated doc_id are each scanned; an empty table
    gives no rows; columns other than doc_id and text are not read. No row leaves its task.
    """
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text in doc_rows(parts):
                spans = find(text)
                base = [s for s in spans if s[0] in BASE]
                yield doc_id, *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)

        yield from batches(rows(), schema)

    return texts(docs).mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with spans replaced; other columns pass through, ``n_chars`` follows the text if there.

    Null texts stay null; rows with a null or repeated doc_id are each redacted; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                old = some.column(at).to_pylist()
                new = [None if t is None else redact(t, find(t)) for t in old]
                cols = list(some.columns)
                cols[at] = pa.array(new, type=some.schema.field(at).type)
                if count is not None:
                    size = zip(some.column(count).to_pylist(), old, new, strict=True)
                    cols[count] = pa.array([n if o == x else len(x) for n, o, x in size], type=some.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(cols, schema=some.schema)

    return docs.mapInArrow(tidy(run), docs.schema)


def op10_pii_anchors(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
