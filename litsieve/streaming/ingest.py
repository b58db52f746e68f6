"""Incremental ingest: exact duplicates within a watermark, and near duplicates of each micro-batch against what is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import text


def dedup_stream(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A1 on a stream: the first row of each key within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts by event-time window; late rows count until the watermark passes."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), by).count()


def against_store(store: Callable[[], DataFrame | None], sink: Callable[[DataFrame], None], key: str, column: str, threshold: float = 0.8) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows of the batch that are no near duplicate of the store or of an earlier row go to the sink."""
    from litsieve.operators.neardup import near_duplicates

    def run(batch: DataFrame, _: int) -> None:
        kept = store()
        fresh = batch.where(F.trim(text(column)) != "")
        both = fresh.select(key, column) if kept is None else fresh.select(key, column).unionByName(kept.select(key, column))
        comp = near_duplicates(both, key, column, threshold)
        old = comp if kept is None else comp.join(kept.select(key), key, "left_semi")
        least = comp.groupBy("component").agg(F.min(key).alias("first"))
        taken = old.select("component").distinct().withColumn("old", F.lit(True)) if kept is not None else None
        j = fresh.join(comp, key, "left").join(least, "component", "left")
        keep = F.col("component").isNull() | (F.col(key) == F.col("first"))
        if taken is not None:
            j = j.join(taken, "component", "left")
            keep = F.col("component").isNull() | (F.col("old").isNull() & (F.col(key) == F.col("first")))
        sink(j.where(keep).select(*batch.columns))

    return run


class BandIndex:
    """V5 on a stream: a store of kept rows with a versioned index of their MinHash bands, in a folder that all executors share.

    The index has one row for each band of each kept row: ``band, key``, dealt by a prefix of the band so that a batch reads
    only the parts that its own bands fall into. The store holds the rows' token sets, dealt likewise by key, and is read for the keys
    that share a band with the batch and for no others; a batch without a collision reads none of it. Batches are written
    to folders of their own under the batch's number, so one that runs twice replaces itself.
    """

    #: Parts of the index and of the store.
    PARTS = 64

    def __init__(self, root: str, key: str, column: str, threshold: float = 0.8, bands: int = 33, rows: int = 6):
        self.root, self.key, self.column, self.threshold, self.bands, self.rows = root.rstrip("/"), key, column, threshold, bands, rows
        #: Keys whose token sets the last batch read from the store.
        self.read_keys = 0

    def _earlier(self, spark, name: str, batch: int, columns: str) -> DataFrame | None:
        """What batches before this one have written."""
        jvm = spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        own = [f"{self.root}/{name}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < batch]
        schema = f"{columns}, part int, batch int"
        return spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*own) if own else None

    def near(self, batch: DataFrame, number: int) -> DataFrame:
        """``a, b, jaccard`` of the batch's rows with each other and with the store's that reach the threshold; a copy with its text's first row."""
        from litsieve.operators.neardup import band_keys, candidate_pairs, copies, jaccard_of_pairs, token_sets
        from litsieve.storage import materialize

        spark = batch.sparkSession
        members, sets = token_sets(batch, self.key, self.column)
        inside = candidate_pairs(sets, self.bands, self.rows)
        own = materialize(band_keys(sets, self.bands, self.rows).withColumn("part", F.pmod("band", F.lit(self.PARTS)).cast("int")), "stream-bands")
        kind = batch.schema[self.key].dataType.simpleString()
        index = self._earlier(spark, "bands", number, f"band long, key {kind}")
        store = self._earlier(spark, "sets", number, f"set_id {kind}, t array<string>")
        pairs, every, self.read_keys = inside, sets, 0
        if index is not None and store is not None:
            parts = [r[0] for r in own.select("part").distinct().collect()]  # PARTS numbers at most
            met = own.join(index.where(F.col("part").isin(parts)).select("band", F.col("key").alias("a")), "band")
            hits = materialize(met.select("a", F.col("set_id").alias("b")).distinct(), "stream-hits")
            keys = materialize(hits.select(F.col("a").alias("set_id")).distinct().withColumn("part", F.pmod(F.xxhash64("set_id"), F.lit(self.PARTS)).cast("int")), "stream-keys")
            self.read_keys = keys.count()
            if self.read_keys:
                parts = [r[0] for r in keys.select("part").distinct().collect()]
                held = store.where(F.col("part").isin(parts)).join(keys.select("set_id"), "set_id", "left_semi").select("set_id", "t")
                pairs, every = inside.unionByName(hits.where("a <> b")), sets.unionByName(held)
        found = jaccard_of_pairs(every, pairs).where(F.col("jaccard") >= self.threshold - 1e-12)
        return found.unionByName(copies(members, self.key))

    def __call__(self, batch: DataFrame, number: int, sink: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Keep the batch's rows that are no near duplicate of the store or of a row with a smaller key, index them, and pass them on.

        Of rows that are linked among themselves only, transitively, the smallest key stays; a row linked with the store goes, and
        with it what it is linked with. Rows without tokens are dropped, as they can't be compared; null keys too. Rows that
        repeat a key within a batch are one row.
        """
        from litsieve.operators.graph import connected_components
        from litsieve.operators.neardup import band_keys, token_sets
        from litsieve.storage import materialize

        rows = materialize(batch.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]), "stream-batch")
        links = materialize(self.near(rows, number), "stream-links")
        mine = rows.select(F.col(self.key).alias("node"))
        comp = materialize(connected_components(links, "a", "b"), "stream-components")
        inner = comp.join(mine, "node", "left_semi")
        old = comp.join(mine, "node", "left_anti").select("component").distinct().withColumn("old", F.lit(True))
        first = inner.groupBy("component").agg(F.min("node").alias("first")).join(old, "component", "left")
        gone = inner.join(first, "component").where((F.col("node") != F.col("first")) | F.col("old").isNotNull()).select(F.col("node").alias(self.key))
        told = F.size(F.filter(F.split(F.lower(text(self.column)), "[^a-z0-9]+"), lambda t: t != "")) > 0
        kept = materialize(rows.where(told).join(gone, self.key, "left_anti"), "stream-kept")
        _, sets = token_sets(kept, self.key, self.column)
        band_keys(sets, self.bands, self.rows).select("band", F.col("set_id").alias("key"), F.pmod("band", F.lit(self.PARTS)).cast("int").alias("part")).write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/bands/batch={number}")
        sets.withColumn("part", F.pmod(F.xxhash64("set_id"), F.lit(self.PARTS)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/sets/batch={number}")
        if sink is not None:
            sink(kept.select(*batch.columns))
        return kept.select(*batch.columns)
