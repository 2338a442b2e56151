"""The registered queries of these operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm import decontaminate, exact_dedup, jaccard_join, license_scan, line_dedup, merkle_manifest, packing, periodic_runs, pii_crf, quality, secret_scan, token_counts, top_k
from signalmill.llm.common import listed, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.answers(token_counts.lengths(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.RULES if r.base]
    found = found.selectExpr("doc_id", "spans", f"filter(spans, x -> x.rank < {len(base)}) AS base")
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS BIGINT) AS n_{kind}" for kind in base],
        f"sha2({listed('base')}, 256) AS base_sha256",
        f"{listed('spans')} AS spans",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removed_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_lines",
        F.size("lines").cast("bigint").alias("n_removed"),
        F.array_join(F.col("lines").cast("array<string>"), ",").alias("removed_lines"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(table(spark, sf_dir, "documents"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_crf.personal_data(docs, pii_crf.fit(docs))
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS BIGINT) AS n_{kind}" for kind in pii_crf.KINDS],
        f"sha2({listed('base')}, 256) AS base_sha256",
        f"{listed('spans')} AS spans",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`, and every row's proof after some texts lost their line feeds."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claimed = [*fields[:-1], F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))]
    rows = merkle_manifest.leaves(docs, "doc_id", "source", fields, claimed)
    found = merkle_manifest.proofs(merkle_manifest.manifest(rows), rows)
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top_k.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k.nearest(top_k.index(rows), rows.filter("id % 50 = 0"), 5).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score"
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of whole texts, some of which are first made periodic from one word on."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"), F.expr("crc32(CAST(doc_id AS STRING)) div 10").alias("g")
    )
    words = docs.withColumn("w", F.expr(r"IF(h % 10 = 0, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), array())"))
    words = words.withColumn("a", F.expr("IF(size(w) > 0, g % size(w), 0)")).withColumn(
        "p", F.expr("1 + (size(w) - a) div (3 + g % 8)")
    )
    made = F.expr("array_join(transform(w, (x, i) -> IF(i < a, x, w[CAST(a + (i - a) % p AS INT)])), ' ')")
    found = periodic_runs.runs(words.select("doc_id", F.when(F.col("h") % 10 == 0, made).otherwise(F.col("text")).alias("text")))
    longest = "array_max(transform(runs, x -> struct(x.length AS length, -x.start AS start, -x.period AS period)))"
    return found.withColumn("longest", F.expr(longest)).selectExpr(
        "doc_id",
        "CAST(size(runs) AS BIGINT) AS n_runs",
        "-longest.start AS start",
        "longest.length AS length",
        "-longest.period AS period",
        "(1000 * longest.length) div -longest.period AS exponent_milli",
        "sha2(array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [(k, f) for k, f in globals().items() if k.startswith("op")]
    return {k: f for k, f in sorted(named, key=lambda x: int(x[0][2:].split("_")[0]))}
