"""Evaluation of labels: sampling, confusion, precision and recall, validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import fixed
from signalmill.operators.ordered import first_per_key


def problem_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.filter(F.col("kind_v2_primary").isin(*fixed.PROBLEM_CLASSES))


def draw(seed: int, *keys: str) -> Column:
    """Repeatable random order: a hash of the seed and the key."""
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def random_sample(rows: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """`n` rows without replacement: the first by a random `order`, such as `draw`."""
    return rows.orderBy(*order).limit(n)


def class_quotas(rows: DataFrame, label: str, n: int, classes: Sequence[str] = fixed.EVAL_CLASSES) -> DataFrame:
    """(label, quota): a share per class in the given class order, at least one each.

    Classes that are not listed count in the total only. One row per listed class.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("size"))
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    total = F.sum("size").alias("total")
    listed = F.sort_array(
        F.collect_list(F.when(place > 0, F.struct(place.alias("place"), F.col(label).alias("label"), "size")))
    ).alias("listed")

    def take(state: Column, c: Column) -> Column:
        wanted = F.floor(F.lit(n) * (c["size"] / F.col("total"))) + 1
        quota = F.greatest(F.lit(1), F.least(c["size"], wanted, state["left"])).cast("bigint")
        quota = F.when(state["left"] > 0, quota).otherwise(F.lit(0).cast("bigint"))
        return F.struct(
            (state["left"] - quota).alias("left"),
            F.concat(state["quotas"], F.array(F.struct(c["label"].alias("label"), quota.alias("quota")))).alias("quotas"),
        )

    start = F.struct(
        F.lit(n).cast("bigint").alias("left"),
        F.array().cast("array<struct<label:string,quota:bigint>>").alias("quotas"),
    )
    # `sizes` has one row per class.
    return (
        sizes.agg(total, listed)
        .select(F.explode(F.aggregate("listed", start, take)["quotas"]).alias("q"))
        .select(F.col("q.label").alias(label), F.col("q.quota").alias("quota"))
    )


def stratified_sample(
    rows: DataFrame, label: str, n: int, order: Sequence[Column], classes: Sequence[str] = fixed.EVAL_CLASSES
) -> DataFrame:
    """Up to `n` rows with every listed class present, drawn by a random `order` inside the class."""
    quotas = class_quotas(rows, label, n, classes)
    drawn = first_per_key(rows, [label], order, n)
    return drawn.join(quotas, label).filter(F.col("_rank") <= F.col("quota")).drop("_rank", "quota")


def confusion(labels: DataFrame, truth: str, predicted: str) -> DataFrame:
    return labels.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(
    labels: DataFrame, truth: str, predicted: str, classes: Sequence[str] = fixed.EVAL_CLASSES
) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 per listed class, rounded to three places.

    Labels outside the list never count as errors of a listed class.
    """
    cells = confusion(labels, truth, predicted).filter(
        F.col("truth").isin(*classes) & F.col("predicted").isin(*classes)
    )
    # An empty cell per class, so that every class has a row.
    spark = labels.sparkSession
    empty = spark.createDataFrame([(c, c, 0) for c in classes], "truth string, predicted string, n bigint")
    rows = cells.unionByName(empty).select(
        "n", F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"), "truth", "predicted"
    )
    is_truth = F.col("truth") == F.col("label")
    is_predicted = F.col("predicted") == F.col("label")

    def total(hit: Column) -> Column:
        return F.sum(F.when(hit, F.col("n")).otherwise(0))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    counts = rows.groupBy("label").agg(
        total(is_truth & is_predicted).alias("tp"),
        total(~is_truth & is_predicted).alias("fp"),
        total(is_truth & ~is_predicted).alias("fn"),
    )
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return counts.withColumn("p", precision).withColumn("r", recall).select(
        "label",
        "tp",
        "fp",
        "fn",
        F.round("p", 3).alias("precision"),
        F.round("r", 3).alias("recall"),
        F.round(f1, 3).alias("f1"),
    )


def accuracy(labels: DataFrame, truth: str, predicted: str) -> DataFrame:
    correct = F.count_if(F.col(truth) == F.col(predicted))
    return labels.agg(
        F.count("*").alias("n_samples"),
        correct.alias("n_correct"),
        F.coalesce(F.round(correct / F.count("*"), 3), F.lit(0.0)).alias("accuracy"),
    )


def validity(judged: DataFrame) -> DataFrame:
    """(signal_class, total, real, false, precision), with the class `all` for the whole sample."""
    real = F.count_if("is_real_issue")
    counts = judged.groupingSets([["signal_class"], []], "signal_class").agg(
        F.count("*").alias("total"), real.alias("real")
    )
    return counts.select(
        F.coalesce("signal_class", F.lit("all")).alias("signal_class"),
        "total",
        "real",
        (F.col("total") - F.col("real")).alias("false"),
        F.when(F.col("total") > 0, F.col("real") / F.col("total")).otherwise(F.lit(0.0)).alias("precision"),
    )


def validity_severity(judged: DataFrame) -> DataFrame:
    return judged.filter("is_real_issue").groupBy("severity").agg(F.count("*").alias("n"))
