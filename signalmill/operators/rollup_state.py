"""Roll-up of items that are delivered batch by batch, with items taken back by their id.

Counters are kept per cell, that is per signature and batch of delivery, in the
form of `facet_counts`, `tag_counts` and `first_items`. Cells of a signature
merge: numbers add up, the first position is the least one, the first items are
the first of all. So a batch adds its own cells, and only the signatures that
it touches are put together again from their cells.

An item that is taken back leaves its cell, and a minimum cannot be subtracted.
The cell alone is counted anew from its stored items. Where an item lies is
looked up in an index by item id.

Everything is Parquet below one folder, in partitions by batch and by bucket of
the signature (or of the item id, in the index), so a batch reads the buckets
that it touches. A version of a cell replaces older ones of the same cell, and a
repeated batch replaces itself. Nothing is changed in place.

| table | holds, by batch |
|---|---|
| `items` | delivered items, by bucket of the signature |
| `ids` | item_id, signature_id, cell, by bucket of the id |
| `gone` | item_id of items taken back |
| `cells` | the cells with a new version: cell, signature_id |
| `facets`, `tags`, `firsts` | the versions, by bucket of the signature |
| `clusters` | the clusters that were put together again |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators import rollup
from signalmill.operators.ordered import first_per_key
from signalmill.operators.stable import stable

BUCKETS = 64


def _bucket(of: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, table: str, batch: int, by: str | None = None) -> None:
    """One batch of a table; a bucket goes to few files, a large one to several tasks."""
    target = f"{path}/{table}/batch_id={batch}"
    if by:
        rows.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).parquet(target)
    else:
        rows.write.mode("overwrite").parquet(target)


def _touched_buckets(rows: DataFrame) -> list[int]:
    """At most `BUCKETS` numbers, for partition pruning."""
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())


class RollupState:
    """The stored state below a folder. `buckets` must not change over its life."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, max_samples: int = rollup.MAX_SAMPLES):
        self.spark, self.path, self.buckets, self.max_samples = spark, path, buckets, max_samples

    def _read(self, table: str, schema, below: int, buckets: list[int] | None = None) -> DataFrame:
        """Batches before `below` of a table, only the given buckets of it."""
        partitions = "batch_id bigint" if buckets is None else "batch_id bigint, bucket int"
        empty = self.spark.createDataFrame([], schema)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema)
        if below == 0:
            return self.spark.createDataFrame([], f"{fields}, {partitions}")
        rows = self.spark.read.schema(f"{fields}, {partitions}").parquet(f"{self.path}/{table}").filter(F.col("batch_id") < below)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def add(self, items: DataFrame, gone: DataFrame | None, batch: int) -> DataFrame:
        """Deliver the items of a batch, take back those with an item_id in `gone`, return the touched signatures.

        Batches are numbered from 0 without a gap. Items are those of `rollups`;
        an id in `gone` that was never delivered before, or is gone, does nothing.
        """
        plain = items.schema
        marked = rollup.with_signature(items).withColumn("bucket", _bucket("signature_id", self.buckets))
        _write(marked, self.path, "items", batch, "bucket")
        delivered = self._read("items", marked.drop("bucket").schema, batch + 1, list(range(self.buckets)))
        own = delivered.filter(F.col("batch_id") == batch).withColumnRenamed("batch_id", "cell")
        ids = own.select("item_id", "signature_id", "cell", _bucket("item_id", self.buckets).alias("id_bucket")).distinct()
        _write(ids.withColumnRenamed("id_bucket", "bucket"), self.path, "ids", batch, "bucket")

        lost = self._taken_back(gone, batch)
        # Cells that lose items are counted again from what is left of them.
        old = lost.select("cell", "signature_id", "bucket").distinct()
        left = (
            delivered.filter(F.col("bucket").isin(_touched_buckets(old)) & (F.col("batch_id") < batch))
            .withColumnRenamed("batch_id", "cell")
            .join(old.select("cell", "signature_id"), ["cell", "signature_id"], "left_semi")
            .join(self._gone(batch + 1), ["item_id", "cell"], "left_anti")
        )
        # The signatures of the delivery were worked out when it was written.
        columns = ["cell", "bucket", *plain.names]
        signed = own.select(*dict.fromkeys([*columns, "signature_text", "signature_id"]))
        counted = stable(signed.unionByName(rollup.with_signature(left.select(*columns))))
        cells = own.select("cell", "signature_id", "bucket").distinct().unionByName(old)
        _write(cells, self.path, "cells", batch)
        keys = ["cell", "bucket"]
        versions = {
            "facets": rollup.facet_counts(counted, *keys),
            "tags": rollup.tag_counts(counted, *keys),
            "firsts": rollup.first_items(counted, self.max_samples, *keys).drop("_rank"),
        }
        for table, rows in versions.items():
            _write(rows, self.path, table, batch, "bucket")

        touched = stable(cells.select("signature_id", "bucket").distinct())
        schemas = {table: rows.drop("bucket").schema for table, rows in versions.items()}
        self._rebuilt(touched, schemas, batch).write.mode("overwrite").parquet(f"{self.path}/clusters/batch_id={batch}")
        return touched.select("signature_id")

    def _gone(self, below: int) -> DataFrame:
        return self._read("gone", "item_id string, cell bigint", below).select("item_id", "cell").distinct()

    def _taken_back(self, gone: DataFrame | None, batch: int) -> DataFrame:
        """(item_id, cell, signature_id, bucket) of stored items that leave, written as `gone`."""
        empty = self.spark.createDataFrame([], "item_id string, cell bigint, signature_id string, bucket int")
        if gone is None or batch == 0:
            _write(empty.select("item_id", "cell"), self.path, "gone", batch)
            return empty
        asked = stable(gone.select("item_id").distinct().withColumn("bucket", _bucket("item_id", self.buckets)))
        known = self._read("ids", "item_id string, signature_id string, cell bigint", batch, _touched_buckets(asked))
        found = stable(
            known.join(asked.select("item_id"), "item_id", "left_semi")
            .join(self._gone(batch), ["item_id", "cell"], "left_anti")
            .select("item_id", "cell", "signature_id", _bucket("signature_id", self.buckets).alias("bucket"))
        )
        _write(found.select("item_id", "cell"), self.path, "gone", batch)
        return found

    def _rebuilt(self, touched: DataFrame, schemas: dict, batch: int) -> DataFrame:
        """The clusters of the touched signatures, from the newest versions of their cells."""
        buckets = _touched_buckets(touched)
        cells = self._read("cells", "cell bigint, signature_id string", batch + 1)
        newest = (
            cells.join(touched.select("signature_id"), "signature_id", "left_semi")
            .groupBy("cell", "signature_id")
            .agg(F.max("batch_id").alias("batch_id"))
        )

        def merged(table: str) -> DataFrame:
            rows = self._read(table, schemas[table], batch + 1, buckets)
            return rows.join(newest, ["cell", "signature_id", "batch_id"], "left_semi")

        facets, tags, firsts = merged("facets"), merged("tags"), merged("firsts")
        total = [F.sum("n").alias("n"), F.min("first_pos").alias("first_pos")]
        return rollup.from_counts(
            facets.groupBy("signature_id", "facet", "value").agg(*total),
            tags.groupBy("signature_id", "value").agg(*total),
            first_per_key(firsts.select("signature_id", "pos", "ref"), ["signature_id"], [F.col("pos")], self.max_samples),
        )

    def clusters(self, batches: int) -> DataFrame:
        """The clusters after that many batches: of each signature the version of the last batch that touched it."""
        cells = self._read("cells", "cell bigint, signature_id string", batches)
        newest = cells.groupBy("signature_id").agg(F.max("batch_id").alias("batch_id"))
        rows = self.spark.read.parquet(f"{self.path}/clusters").filter(F.col("batch_id") < batches)
        return rows.join(newest, ["signature_id", "batch_id"], "left_semi").drop("batch_id")
