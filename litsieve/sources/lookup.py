"""Bibliographic lookups (S15-S18) as a Python data source with an injected transport.

``spark.read.format("biblio").option("service", "crossref_title")...`` reads the answers to a few queries; a whole
table goes through ``lookup``, which asks each distinct query once and keeps the answers. The transport is any function
``url -> (status, body)``; tests use stubs, so nothing here needs a network.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from litsieve.storage import materialize

Transport = Callable[[str], tuple[int, str]]
#: The services' addresses.
SERVICES = {
    "crossref_title": "https://api.crossref.org/works?query.title={q}&rows=5",
    "crossref_doi": "https://api.crossref.org/works/{q}",
    "pubmed_search": "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&retmode=json&term={q}",
    "pubmed_fetch": "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pubmed&retmode=xml&id={q}",
    "opencitations": "https://opencitations.net/index/coci/api/v1/metadata/{q}",
}
#: Answers after which a service is asked again: no connection, too many requests, its own faults.
BUSY = frozenset({0, 429, 500, 502, 503, 504})
_KEPT = "service string, query string, response string"


def http(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=30) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except OSError as e:
        return getattr(e, "code", 0) or 0, ""


def ask(service: str, query: str, transport: Transport) -> str | None:
    """The body of a good answer (status 200, D3); PubMed takes two steps."""
    if not query:
        return None
    q = urllib.parse.quote(query, safe="")
    if service == "pubmed":
        found = ask("pubmed_search", query, transport)
        try:
            ids = json.loads(found or "{}").get("esearchresult", {}).get("idlist", [])
        except ValueError:
            ids = []
        return ask("pubmed_fetch", ids[0], transport) if ids else None
    status, body = transport(SERVICES[service].format(q=q))
    if status != 200 and service == "crossref_title":  # the second encoding
        status, body = transport(SERVICES[service].format(q=urllib.parse.quote_plus(query)))
    return body if status == 200 else None


class Patient:
    """A transport that asks again after a busy or lost answer, waiting twice as long each time."""

    def __init__(self, transport: Transport, attempts: int = 4, wait: float = 1.0):
        self.transport, self.attempts, self.wait = transport, attempts, wait
        self.sure = True  # no request since this was set ended in a busy answer

    def __call__(self, url: str) -> tuple[int, str]:
        for k in range(self.attempts):
            status, body = self.transport(url)
            if status not in BUSY:
                return status, body
            if k + 1 < self.attempts:
                time.sleep(self.wait * 2**k)
        self.sure = False
        return status, body


def lookup(df: DataFrame, key: str, query: str, service: str, transport: Transport = http, store: str | None = None, connections: int = 8, attempts: int = 4, wait: float = 1.0) -> DataFrame:
    """``key, response`` for every row; each distinct query is asked once, by at most ``connections`` tasks at a time.

    ``store`` is a folder of answers kept between runs: what it holds is not asked again, and final answers ("not
    found" as null) are added; answers that were still busy after all attempts are not, so a later run asks again. Null and blank
    queries are not asked and have a null response; rows that repeat a key or a query each get the answer.
    """
    spark = df.sparkSession
    asked = df.select(F.col(key).alias("k"), F.col(query).cast("string").alias("q"))
    todo = asked.where("q <> ''").select("q").distinct()
    kept = None
    if store and _holds_tables(spark, store):
        kept = spark.read.schema(_KEPT).parquet(store).where(F.col("service") == service).groupBy(F.col("query").alias("q")).agg(F.max("response").alias("response"))
        todo = todo.join(kept, "q", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patient = Patient(transport, attempts, wait)
        for pdf in parts:
            out = []
            for q in pdf["q"]:
                patient.sure = True
                out.append((q, ask(service, q, patient), patient.sure))
            yield pd.DataFrame(out, columns=["q", "response", "sure"]).astype({"response": object})

    # written out, so that no later failure or second reader repeats a request
    new = materialize(todo.repartition(connections, "q").mapInPandas(run, "q string, response string, sure boolean"), "answers")
    answers = new.select("q", "response")
    if store:
        if kept is not None:  # before the store grows
            answers = answers.unionByName(materialize(asked.select("q").distinct().join(kept, "q"), "kept-answers"))
        new.where("sure").select(F.lit(service).alias("service"), F.col("q").alias("query"), "response").write.mode("append").parquet(store)
    return asked.join(answers, "q", "left").select(F.col("k").alias(key), "response")


def _holds_tables(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class BiblioSource(DataSource):
    """Options: ``service``, ``queries`` (line feeds part them), ``fixture`` (JSON of url to body, for offline use)."""

    @classmethod
    def name(cls) -> str:
        return "biblio"

    def schema(self) -> str:
        return "query string, response string"

    def reader(self, schema) -> DataSourceReader:
        return BiblioReader(self.options)


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class BiblioReader(DataSourceReader):
    def __init__(self, options: dict):
        self.service, self.queries = options.get("service", "crossref_doi"), [q for q in options.get("queries", "").split("\n") if q]
        self.fixture = json.loads(options["fixture"]) if "fixture" in options else None

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries]

    def read(self, partition):
        stub = self.fixture
        transport = http if stub is None else lambda url: (200, stub[url]) if url in stub else (404, "")
        yield partition.query, ask(self.service, partition.query, transport)
