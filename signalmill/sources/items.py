"""Item and cluster files: JSON lines, cluster JSON, Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalmill.operators.ordered import first_per_key
from signalmill.operators.rollup import rank_order, rollup_summary

ITEM = (
    "schema_version int, item_id string, session_id string, "
    "source struct<file_hint:string,chunk_id:string>, kind string, summary string, severity string, "
    "confidence double, tags array<string>, span struct<start_i:bigint,end_i:bigint>, "
    "evidence array<struct<event_i:bigint,role:string,field_path:string,quote:string>>, "
    "proposed_fix struct<fix_type:string,description:string>"
)
CLUSTER = (
    "signature_id string, signature_text string, count_items bigint, count_sessions bigint, "
    "kind_counts map<string,bigint>, kind_v2_counts map<string,bigint>, max_severity string, tier int, "
    "tier_reasons array<string>, score double, tags_top array<array<string>>, canonical_summary string, "
    "fingerprint_id string, fingerprint_text string, sentiment string"
)

# Columns of cluster lines that merging, tickets and reports read.
CLUSTER_LINE = CLUSTER.replace("tags_top array<array<string>>", "tags_top array<struct<value:string,n:bigint>>") + (
    ", kind_v2_primary string, first_pos struct<session_id:string,chunk_idx:bigint,rank:bigint>"
)


def read_items(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Items with their file order as `pos`. A bad line fails the read, or is dropped when not strict."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = spark.read.schema(ITEM).json(path, mode=mode)
    pos = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select("*", pos.alias("pos"))


def first_per_summary(items: DataFrame, limit: int) -> DataFrame:
    """The first items of every summary."""
    return first_per_key(items, ["summary"], [F.col("pos")], limit)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Clusters of a cluster JSON file: the list `rollups`, else `clusters`, with `first_pos`."""
    schema = f"rollups array<struct<{_colons(CLUSTER)}>>, clusters array<struct<{_colons(CLUSTER)}>>"
    files = spark.read.schema(schema).json(path, multiLine=True)
    rows = files.select(F.posexplode(F.coalesce("rollups", "clusters")).alias("first_pos", "c"))
    tags = F.transform(
        "tags_top", lambda t: F.struct(t[0].alias("value"), t[1].cast("bigint").alias("n"))
    )
    entries = F.map_entries("kind_v2_counts")
    # The first key with the largest count; the map keeps the order of the file.
    primary = F.array_max(
        F.transform(entries, lambda e, k: F.struct(e["value"], -k, e["key"].alias("key")))
    )["key"]
    return (
        rows.select("first_pos", "c.*")
        .withColumn("tags_top", tags)
        .withColumn("kind_v2_primary", F.coalesce(primary, F.lit("unknown")))
    )


def write_clusters(clusters: DataFrame, path: str) -> None:
    """One JSON cluster per line, with all columns, so that any number of tasks can write and read."""
    clusters.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_cluster_lines(spark: SparkSession, path: str, schema: StructType | str = CLUSTER_LINE) -> DataFrame:
    """Clusters of `write_clusters`. With the schema of the written clusters, all their columns come back."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def _colons(ddl: str) -> str:
    """DDL columns as struct fields."""
    out = []
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        out.append(f"{name}:{kind}")
    return ",".join(out)


def write_items(items: DataFrame, path: str) -> None:
    """One JSON item per line. Helper columns stay out."""
    helpers = [c for c in ("pos", "chunk_idx", "rank") if c in items.columns]
    items.drop(*helpers).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def cluster_report(clusters: DataFrame, limit: int = 50) -> DataFrame:
    """(place, line): report lines of the best clusters. Only the top rows are numbered."""
    best = clusters.orderBy(*rank_order()).limit(limit)
    place = F.row_number().over(Window.orderBy(*rank_order()))

    def listed(column: str) -> Column:
        return F.array_join(
            F.transform(column, lambda t: F.concat(t["value"], F.lit(":"), t["n"].cast("string"))), ", "
        )

    kinds = F.array_join(
        F.transform(F.map_entries("kind_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))),
        ", ",
    )
    line = F.concat(
        F.lit("## Tier "), F.col("tier").cast("string"), F.lit(" score="), F.format_string("%.2f", "score"),
        F.lit("\n\n- summary: "), "canonical_summary",
        F.lit("\n- kinds: "), kinds,
        F.lit("\n- max_severity: "), "max_severity",
        F.lit("\n- tags_top: "), listed("tags_top"),
        F.lit("\n- samples: "), F.size("sample_refs").cast("string"), F.lit("\n"),
    )
    return best.withColumn("place", place).select("place", line.alias("line"))


def report_header(clusters: DataFrame) -> DataFrame:
    """(place, line): the head of a report, with items, groups and groups per tier, before place 1."""
    line = F.format_string(
        "# Signals\n\n- items: %d\n- groups: %d\n- tier 1: %d\n- tier 2: %d\n- tier 3: %d\n",
        "items", "groups", "tier1", "tier2", "tier3",
    )
    return rollup_summary(clusters).select(F.lit(0).alias("place"), line.alias("line"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as one text file; it holds at most a page of top rows."""
    report.orderBy("place").select("line").coalesce(1).write.text(path)
