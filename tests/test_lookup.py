"""Lookups: one request for a query, patience with busy services, answers kept between runs."""

import json
from collections import Counter

from litsieve.operators import enrich
from litsieve.sources import lookup


def stub(folder, answers, busy=()):
    """Answers by query from a dict; each request is a file in ``folder``; a query in ``busy`` fails that often first."""
    busy = dict(busy)

    def transport(url):
        import os
        import uuid

        q = url.rsplit("/", 1)[1]
        seen = sum(n.startswith(q + "~") for n in os.listdir(folder))
        open(f"{folder}/{q}~{uuid.uuid4().hex}", "w").close()
        if seen < busy.get(q, 0):
            return (429, "") if seen % 2 else (0, "")
        return (200, answers[q]) if q in answers else (404, "")

    return transport


def requests(folder):
    return Counter(p.name.split("~")[0] for p in folder.iterdir())


def ask(spark, rows, transport, **kw):
    df = spark.createDataFrame(rows, "id long, doi string, response string, q string").repartition(5)
    return Counter(map(tuple, lookup.lookup(df, "id", "doi", "crossref_doi", transport, wait=0.001, **kw).collect()))


def test_each_query_is_asked_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = [(i, ("a", "b", "none", None, "")[i % 5], "own", "own") for i in range(400)] + [(0, "a", "", ""), (None, "b", "", "")]
    got = ask(spark, rows, stub(str(seen), {"a": "A", "b": "B"}, {"b": 3}))
    assert got == Counter((i, {"a": "A", "b": "B"}.get(q)) for i, q, *_ in rows)
    assert requests(seen) == {"a": 1, "b": 4, "none": 1}


def test_answers_are_kept_but_not_busy_ones(spark, tmp_path):
    seen, store = tmp_path / "seen", str(tmp_path / "answers")
    seen.mkdir()
    rows = [(1, "a", "", ""), (2, "none", "", ""), (3, "b", "", "")]
    first = stub(str(seen), {"a": "A", "b": "B"}, {"b": 6})
    assert ask(spark, rows, first, store=store) == Counter({(1, "A"): 1, (2, None): 1, (3, None): 1})
    assert requests(seen) == {"a": 1, "none": 1, "b": 4}
    again = ask(spark, [*rows, (4, "a", "", ""), (5, "c", "", "")], stub(str(seen), {"a": "changed", "b": "B", "c": "C"}, {"b": 6}), store=store)
    assert again == Counter({(1, "A"): 1, (4, "A"): 1, (2, None): 1, (3, "B"): 1, (5, "C"): 1})
    assert requests(seen) == {"a": 1, "none": 1, "b": 7, "c": 1}
    assert ask(spark, rows, stub(str(seen), {}), store=store) == Counter({(1, "A"): 1, (2, None): 1, (3, "B"): 1})
    assert ask(spark, [], stub(str(seen), {}), store=store) == Counter()
    assert sum(requests(seen).values()) == 10


def test_articles_with_one_doi_share_an_answer(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    body = json.dumps({"message": {"title": ["T"], "abstract": "words of it", "DOI": "10.1/a"}})
    plain = stub(str(tmp_path / "seen"), {"10.1%2Fa": body})
    cols = "orig_index long, title string, authors string, year string, journal string, abstract string, keywords string, volume string, issue string, pages string, doi string"
    rows = [(i, "", "", "", "", "", "", "", "", "", "10.1/a") for i in range(3)]
    out = enrich.retrieve_missing(spark.createDataFrame(rows, cols), lambda u: plain(u) if "crossref" in u else (404, ""), str(tmp_path / "answers"))
    assert [r.title for r in out.orderBy("orig_index").collect()] == ["T"] * 3
    assert requests(tmp_path / "seen") == {"10.1%2Fa": 1}
