"""Text operators as Column expressions (Tx in the survey); no Python runs on the executors."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns of the method, in their order -------------------------------------------
HEADERS = [
    "background[:.]",
    "background.[:.]",
    "background and aims[:.]",
    "background/aims[:.]",
    "background and purpose[:.]",
    "background and objectives[:.]",
    "background & objectives[:.]",
    "summary[:.]",
    "introduction[:.]",
    "methods[:.]",
    "results[:.]",
    "conclusions[:.]",
    "objective[:.]",
    "objectives[:.]",
    "discussion[:.]",
    "aims[:.]",
    "aims/hypothesis",
    "rationale[:.]",
    "importance[:.]",
    r"\[abstract from author\]",
]
COPYRIGHT = [
    r"\(c\)\s*(?:20\d{2}|19\d{2}).*",
    r"\(c\).*?press.*",
    "copyright .*",
    "© .*",
    r"\(\w+ database record.*",
]
MARKDOWN = [
    r"\*\*(.*?)\*\*",
    "__(.*?)__",
    r"\*(.*?)\*",
    "_(.*?)_",
    r"!\[(.*?)\]\((.*?)\)",
    r"\[(.*?)\]\((.*?)\)",
]
PUNCTUATION = "!\"#$%&'()*+,/:;<=>?@[\\]^_`{|}~"
# ----------------------------------------------------------------------------------------------------

#: Short English stop-word list for the self-contained queries; pipelines use ``stopwords``.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with".split()
_DOT = "(?d)"  # only a line feed ends a line, as in Python


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_tags(c: Column) -> Column:
    """T1 without entities: script, style and comments go, other tags become spaces."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(c, r"<[^<>]*>", " ")


#: The five named references of XML.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def unescape_xml(c: Column) -> Column:
    """Numeric references, then the named ones, ``&amp;`` last, so nothing is decoded twice."""
    refs = F.array_distinct(F.regexp_extract_all(c, F.lit("&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(0)))

    def one(acc: Column, ref: Column) -> Column:
        body = F.regexp_replace(ref, "[&#;]", "")
        code = F.when(F.lower(F.substring(body, 1, 1)) == "x", F.substring(body, 2, 9)).otherwise(F.hex(body.cast("long")))
        # a number that is no character stays
        value = F.when(F.length(F.ltrim(code, F.lit("0"))) <= 5, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        # an ampersand waits for the end as its own reference
        return F.replace(acc, ref, F.coalesce(F.when(value == "&", "&amp;").otherwise(value), ref))

    out = F.aggregate(refs, c, one)
    for ref, value in ENTITIES.items():
        out = F.replace(out, F.lit(ref), F.lit(value))
    return out


def strip_markdown(c: Column) -> Column:
    """Six patterns in order, each replaced by its first group."""
    return reduce(lambda x, p: F.regexp_replace(x, _DOT + p, "$1"), MARKDOWN, c)


def strip_headers(c: Column) -> Column:
    """Section headings of lowered abstracts, in list order, anywhere."""
    return reduce(lambda x, p: F.regexp_replace(x, _DOT + p, ""), HEADERS, c)


def strip_copyright(c: Column) -> Column:
    """T4: notices and the rest of their line."""
    return reduce(lambda x, p: F.regexp_replace(x, "(?iud)" + p, ""), COPYRIGHT, c)


def clean_abstract(c: Column, markdown: bool = False, html: bool = True) -> Column:
    """T5 for one value: tags, markdown if asked for, headings, notices."""
    c = strip_tags(c) if html else c
    c = strip_markdown(c) if markdown else c
    return strip_copyright(strip_headers(c))


def joined_runs(toks: Column, size: int) -> Column:
    """Each ``size`` consecutive elements joined by spaces; linear, as shifted copies are zipped."""
    out = toks
    for k in range(1, size):
        out = F.zip_with(out, F.slice(toks, F.lit(k + 1), F.greatest(F.size(toks), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    last = F.size(toks) - (size - 1)
    return F.when(last >= 1, F.slice(out, F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def windows(c: Column, size: int = 5) -> Column:
    """The runs of ``size`` white-space tokens of a text, as strings."""
    return joined_runs(tokens(c), size)


def remove_all(c: Column, found: Column) -> Column:
    """T6's removal: each literal in turn, in the order of the array."""
    return F.aggregate(found, c, lambda acc, s: F.replace(acc, s, F.lit("")))


def remove_punctuation(c: Column) -> Column:
    """Marks but ``-`` and ``.`` become spaces, non-ASCII goes, a dot between two non-digits goes."""
    c = F.translate(c, PUNCTUATION, " " * len(PUNCTUATION))
    c = F.regexp_replace(c, r"[^\x00-\x7f]", "")
    return F.regexp_replace(c, r"([^0-9])\.([^0-9])", "$1$2")


def remove_numbers(c: Column) -> Column:
    """Whole numbers that stand alone, non-overlapping."""
    return F.regexp_replace(c, r"(^|\s)[0-9]+(\s|$)", " ")


def fold_ascii(c: Column) -> Column:
    """Line ends, tabs and the Unicode hyphen to spaces, squeezed, ASCII only (keeps the last character, D13)."""
    c = F.regexp_replace(c, "[\n\t‐]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7f]", ""), " +", " "))


def tokens(c: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


#: Fixed values, in order: the Penn Treebank's public splitting rules as pattern and replacement. Quotes that open, marks,
#: brackets and dashes (``OPENING``); between two spaces then, quotes that close and endings after an apostrophe (``CLOSING``).
OPENING = (
    ('\\A"', "`` "),
    ("(``)", " $1 "),
    ("([ (\\[{<])(\"|'')", "$1 `` "),
    ("([:,])([^0-9])", " $1 $2"),
    ("([:,])\\z", " $1 "),
    ("\\.\\.\\.", " ... "),
    ("([;@#$%&])", " $1 "),
    ("([^.])(\\.)([\\])}>\"']*)[ \\t\\n\\r\\f\\x0B]*\\z", "$1 $2$3 "),
    ("([?!])", " $1 "),
    ("([^'])' ", "$1 ' "),
    ("([\\]\\[(){}<>])", " $1 "),
    ("--", " -- "),
)
CLOSING = (
    ('"', " '' "),
    ("([^ \\t\\n\\r\\f\\x0B])('')", "$1 $2 "),
    ("([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
)
#: Words that are two, and where they part.
CONTRACTIONS = {"cannot": 3, "d'ye": 2, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3, "more'n": 4, "'tis": 2, "'twas": 2, "wanna": 3}


def words(c: Column) -> Column:
    """Words and marks by the Treebank's rules. A text counts as one sentence: a full stop inside it stays with its word.

    Null gives null; blank text gives no words. Contracted words part where the whole token is one.
    """
    c = reduce(lambda x, rule: F.regexp_replace(x, *rule), OPENING, c)
    c = reduce(lambda x, rule: F.regexp_replace(x, *rule), CLOSING, F.concat(F.lit(" "), c, F.lit(" ")))
    found = F.filter(F.split(c, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    at = F.create_map(*[F.lit(x) for kv in CONTRACTIONS.items() for x in kv])

    def parted(t: Column) -> Column:
        k = F.element_at(at, F.lower(t))
        return F.when(k.isNull(), F.array(t)).otherwise(F.array(F.substring(t, F.lit(1), k), F.substring(t, k + 1, F.length(t))))

    return F.flatten(F.transform(found, parted))


def clean_column(c: Column) -> Column:
    """Lowered, without marks and numbers, each token once in its first place."""
    return F.array_join(F.array_distinct(tokens(remove_numbers(remove_punctuation(F.lower(c))))), " ")


def document(*cols: str) -> Column:
    """The text fields as one lowered, cleaned string."""
    return remove_numbers(remove_punctuation(F.lower(F.concat_ws(" ", *[text(c) for c in cols]))))


def stopwords(languages: str = "english", custom: str = "") -> list[str]:
    """Spark's list of each language (names are trimmed, D14; unknown ones give English once) and custom words."""
    from pyspark.ml.feature import StopWordsRemover

    known = {"danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish"}
    names = [x.strip().lower() for x in languages.split(",") if x.strip()]
    use = dict.fromkeys(x if x in known else "english" for x in names or ["english"])
    words = [w for n in use for w in StopWordsRemover.loadDefaultStopWords(n)] + [w.strip() for w in custom.split(",") if w.strip()]
    return sorted({*words, *(lemma_of(w) for w in words)})


#: T14's exceptions: nouns whose plural no rule reaches.
IRREGULAR = {"children": "child", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "mice": "mouse", "people": "people", "analyses": "analysis", "hypotheses": "hypothesis", "theses": "thesis", "criteria": "criterion", "phenomena": "phenomenon", "indices": "index", "matrices": "matrix"}


def lemma_of(word: str) -> str:
    """The rules of ``lemma`` for one Python string."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if re.search("(ss|us|is)$", word) or len(word) < 4:
        return word
    for end, to in (("ies$", "y"), ("(ches|shes|sses|xes|zes)$", None), ("s$", "")):
        if re.search(end, word):
            return word[:-2] if to is None else re.sub(end, to, word)
    return word


def lemma(c: Column) -> Column:
    """Plural nouns to singular by rule; an approximation, as no word net is at hand."""
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return (
        F.when(F.element_at(table, c).isNotNull(), F.element_at(table, c))
        .when(c.rlike("(ss|us|is)$") | (F.length(c) < 4), c)
        .when(c.rlike("ies$"), F.regexp_replace(c, "ies$", "y"))
        .when(c.rlike("(ches|shes|sses|xes|zes)$"), F.regexp_replace(c, "es$", ""))
        .otherwise(F.regexp_replace(c, "s$", ""))
    )


def content_tokens(c: Column, stop: list[str], cut: Callable[[Column], Column] = tokens) -> Column:
    """Tokens without stop words, lemmatised, longer than one letter; ``cut=words`` takes the Treebank's."""
    words = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    kept = F.filter(cut(c), lambda t: ~F.array_contains(words, t))
    return F.filter(F.transform(kept, lemma), lambda t: (F.length(t) > 1) & ~F.array_contains(words, t))


def ngrams(toks: Column, low: int = 1, high: int = 4) -> Column:
    """N-grams of the tokens that hold a letter; stop words went before."""
    t = F.filter(toks, lambda x: x.rlike("[a-zA-Z]"))
    return F.concat(*[joined_runs(t, n) for n in range(low, high + 1)])


def combined(*cols: str) -> Column:
    """Fields in order, joined by spaces."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def format_crossref_authors(authors: Column) -> Column:
    """``family, INITIALS`` of an array of given/family/name structs, joined by ``; ``."""

    def one(a: Column) -> Column:
        initials = F.array_join(F.transform(F.filter(F.split(F.replace(a["given"], F.lit("."), F.lit(" ")), r"[\s-]+"), lambda x: x != ""), lambda x: F.upper(F.substring(x, 1, 1))), "")
        return F.when(F.coalesce(a["given"], F.lit("")) != "", F.concat(F.coalesce(a["family"], F.lit("")), F.lit(", "), initials)).otherwise(F.coalesce(a["name"], a["family"], F.lit("Unknown")))

    return F.array_join(F.transform(authors, one), "; ")


def format_citation_authors(c: Column) -> Column:
    """Drop a trailing numeric id; ``last, F``; without a comma the first space parts the names."""

    def one(a: Column) -> Column:
        a = F.trim(F.regexp_replace(a, r"[\s,]*[0-9][0-9X-]*$", ""))
        last = F.when(a.contains(","), F.trim(F.regexp_extract(a, r"^([^,]*),", 1))).otherwise(F.regexp_extract(a, r"^(\S+)", 1))
        first = F.when(a.contains(","), F.trim(F.regexp_extract(a, r",\s*(.*)$", 1))).otherwise(F.regexp_extract(a, r"^\S+\s+(.*)$", 1))
        return F.when(first == "", last).otherwise(F.concat(last, F.lit(", "), F.upper(F.substring(first, 1, 1))))

    return F.array_join(F.transform(F.filter(F.split(c, r";\s*"), lambda x: F.trim(x) != ""), one), "; ")


def first_or_null(c: Column) -> Column:
    """the first element of a list."""
    return F.try_element_at(c, F.lit(1))


def cluster_members(c: Column) -> Column:
    """``merged_a_b`` to its ids, a plain id to itself."""
    return F.when(c.startswith("merged_"), F.slice(F.split(c, "_"), F.lit(2), F.greatest(F.size(F.split(c, "_")) - 1, F.lit(1)))).otherwise(F.array(c))


def split_list(c: Column) -> Column:
    """``;``-lists to trimmed, non-blank entries."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
