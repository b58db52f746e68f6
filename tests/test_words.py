"""Treebank words: cases by hand, and the rules written once more over odd strings."""

import random

from pyspark.sql import functions as F

from litsieve.functions import text

BLANK = " \t\n\r\f\x0b"
CASES = {
    "They'll say it can't, won't they?": ["They", "'ll", "say", "it", "ca", "n't", ",", "wo", "n't", "they", "?"],
    'He said: "Stop (now)!"': ["He", "said", ":", "``", "Stop", "(", "now", ")", "!", "''"],
    "Dr. Lee's results, 3,000 of 5:1.": ["Dr.", "Lee", "'s", "results", ",", "3,000", "of", "5:1", "."],
    "CANNOT gonna 'tis cannot-do": ["CAN", "NOT", "gon", "na", "'t", "is", "cannot-do"],
    "a--b...c dogs' end.) ": ["a", "--", "b", "...", "c", "dogs", "'", "end", ".", ")"],
    " \t\n": [],
    "": [],
}


def paired(s, first, second, join):
    """Left to right: a letter that ``first`` takes, before one of the strings ``second``."""
    out, i = "", 0
    while i < len(s):
        hit = next((x for x in second if first(s[i]) and s.startswith(x, i + 1)), None)
        out += s[i] if hit is None else join(s[i], hit)
        i += 1 if hit is None else 1 + len(hit)
    return out


def scanned(s):
    s = "`` " + s[1:] if s.startswith('"') else s
    s = paired(s.replace("``", " `` "), lambda c: c in " ([{<", ['"', "''"], lambda c, x: c + " `` ")
    out, i = "", 0
    while i < len(s):
        two = s[i] in ":," and i + 1 < len(s) and s[i + 1] not in "0123456789"
        out += f" {s[i]} {s[i + 1]}" if two else s[i]
        i += 1 + two
    s = out[:-1] + f" {out[-1]} " if out and out[-1] in ":," else out
    s = "".join(f" {c} " if c in ";@#$%&" else c for c in s.replace("...", " ... "))
    t = s.rstrip(BLANK)
    j = len(t.rstrip("])}>\"'"))
    if j > 1 and t[j - 1] == "." and t[j - 2] != ".":
        s = f"{t[: j - 1]} .{t[j:]} "
    s = "".join(f" {c} " if c in "?!" else c for c in s)
    s = paired(s, lambda c: c != "'", ["' "], lambda c, x: c + " ' ")
    s = "".join(f" {c} " if c in "[](){}<>" else c for c in s).replace("--", " -- ")
    s = f" {s} ".replace('"', " '' ")
    s = paired(s, lambda c: c not in BLANK, ["''"], lambda c, x: f"{c} {x} ")
    for ends in (["'s ", "'S ", "'m ", "'M ", "'d ", "'D ", "' "], ["'ll ", "'LL ", "'re ", "'RE ", "'ve ", "'VE ", "n't ", "N'T "]):
        s = paired(s, lambda c: c not in "' ", ends, lambda c, x: f"{c} {x}")
    out = []
    for w in "".join(" " if c in BLANK else c for c in s).split(" "):
        k = text.CONTRACTIONS.get(w.lower(), 0)
        out += [x for x in (w[:k], w[k:]) if x]
    return out


def test_cases_and_odd_strings(spark):
    rng = random.Random(12)
    bits = ["'", '"', "''", "``", ".", "...", "--", ",", ":", "3", " ", "  ", "\n", "(", ")", "]", "{", "<", "?", "!", "%", "$", "n't", "'ll", "'S", "N'T", "cannot", "Gonna", "d'ye", "more'n", "é", "a", "can", " ", "\\", "t.", "𝒳"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(1500)] + ["can't " * 20_000, "'" * 5000]
    texts = [*CASES, *odd, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", text.words(F.col("t")).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else scanned(t)), repr(t)[:200]
    for i, (t, want) in enumerate(CASES.items()):
        assert got[i] == want, t
