"""Latency statistics with exact order statistics, and mergeable sketches of quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.operators.ordered import first_per_key, ranked

POINTS = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
KEEP_LAST = 1000
# Size parameter of a quantile sketch; a sketch of fewer values is exact.
SKETCH_SIZE = 1000


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """p50, p95 and p99 per key: the value at 0-based position floor(n * p).

    Positions come from a range-partitioned rank, so a key of any size works.
    """
    keys = list(keys)
    # The rank is written out: counts and picks below read the same rows.
    order = ranked(rows.select(*keys, value, tie), keys, [value, tie], "_at")
    n = order.groupBy(*keys).agg((F.max("_at") + 1).alias("_n"))
    wanted = n.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), F.floor(F.col("_n") * F.lit(p)).alias("_at"))
                    for name, p in POINTS.items()
                ]
            )
        ).alias("w"),
    ).select(*keys, "w.name", "w._at")
    picked = order.join(wanted, [*keys, "_at"])
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in POINTS]
    )


def latency_stats(samples: DataFrame, key: str = "phase", tie: str = "call_id") -> DataFrame:
    """Calls, failures, timeouts and latency figures of successful calls per phase."""
    ok = F.col("success")
    value = F.when(ok, F.col("latency_ms"))
    base = samples.groupBy(key).agg(
        F.count("*").alias("n_calls"),
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_failures"),
        F.count_if(~ok & F.col("error").contains("TIMEOUT")).alias("timeouts"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
        F.avg(value).alias("mean_ms"),
    )
    points = order_statistics(samples.filter(ok), [key], "latency_ms", tie)
    return base.join(points, key, "left")


def last_samples(samples: DataFrame, key: str = "phase", limit: int = KEEP_LAST) -> DataFrame:
    """The newest `limit` latencies per phase."""
    newest = [F.desc("start_ts"), F.desc("call_id")]
    return first_per_key(samples, [key], newest, limit).drop("_rank")


def sample_counters(samples: DataFrame, key: str = "phase") -> DataFrame:
    return samples.groupBy(key).agg(
        F.count_if(F.col("success")).alias("success_count"), F.count_if(~F.col("success")).alias("failure_count")
    )


def sketch_rank_error(size: int = SKETCH_SIZE) -> float:
    """How far, as a share of the rows, a quantile of a sketch may be off, with 99 % confidence."""
    return 2.296 / size**0.9723


def latency_sketches(samples: DataFrame, key: str = "phase", at: str = "start_ts", size: int = SKETCH_SIZE) -> DataFrame:
    """(key, day, n, sketch): a KLL sketch of the latencies of successful calls per phase and day of the session's time zone.

    Sketches are bounded and built before the shuffle, so a phase of any size is
    one small row per task. Written as a table, they take days as they come; see
    `sketch_quantiles`. NULL latencies take no part, nor do rows without a time.
    """
    rows = samples.filter(F.col("success") & F.col("latency_ms").isNotNull() & F.col(at).isNotNull())
    return rows.groupBy(key, F.date_trunc("day", at).cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), size).alias("sketch")
    )


def sketch_quantiles(
    sketches: DataFrame, first: str | None = None, last: str | None = None, key: str = "phase", points: dict[str, float] = POINTS
) -> DataFrame:
    """(key, n, a column per point) from the sketches of the days `first` to `last`, both included.

    Reads one row per phase and day, no samples. Merging draws at random, so write the
    result out before using it twice. `order_statistics` is the exact route.
    """
    if first is not None:
        sketches = sketches.filter(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        sketches = sketches.filter(F.col("day") <= F.lit(last).cast("date"))
    merged = sketches.groupBy(key).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_sketch"))
    found = [F.kll_sketch_get_quantile_double("_sketch", F.lit(p)).alias(name) for name, p in points.items()]
    return merged.select(key, "n", *found)


def rank_errors(samples: DataFrame, quantiles: DataFrame, key: str = "phase", points: dict[str, float] = POINTS) -> DataFrame:
    """(key, n, point, rank_error): how far each quantile is from its share of the samples, 0 if between its neighbours.

    `quantiles` has one row per phase; the samples are counted in one pass.
    """
    value = F.col("latency_ms")
    rows = samples.filter(F.col("success") & value.isNotNull()).select(key, "latency_ms").join(quantiles.drop("n"), key)
    sides = [F.count_if(value < F.col(name)).alias(f"_under_{name}") for name in points]
    sides += [F.count_if(value <= F.col(name)).alias(f"_upto_{name}") for name in points]
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), *sides)
    errors = [
        F.struct(
            F.lit(name).alias("point"),
            F.greatest(
                F.lit(0.0), F.lit(p) - F.col(f"_upto_{name}") / F.col("n"), F.col(f"_under_{name}") / F.col("n") - F.lit(p)
            ).alias("rank_error"),
        )
        for name, p in points.items()
    ]
    return counted.select(key, "n", F.inline(F.array(*errors)))
