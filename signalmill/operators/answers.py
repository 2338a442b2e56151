"""A store of model answers, so that no question is asked twice over runs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators import requests
from signalmill.operators.stable import new_path, stable

# Requests between two writes: what a run that is stopped may have to ask again, at most.
PER_ROUND = 100_000
# Requests of a task: what a task that is retried asks again, at most.
PER_TASK = 200
ATTEMPTS = 3

_ROWS = "key string, answer string, error string"


class AnswerStore:
    """Answers below `path`, a folder that all executors share, by a digest of the system and the user text.

    Every request is asked once, however many rows repeat it and whichever run
    asks. Answers are written after each round, so a run that was stopped goes
    on where its last round ended. A request whose calls all failed has its
    errors kept and is asked again by the next run. NULL texts count as empty.
    Two runs at the same time may both ask what neither has written yet.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # The folder exists from the first use on, so that an empty store can be read.
        spark.createDataFrame([], _ROWS).write.mode("append").parquet(path)

    def told(self) -> DataFrame:
        """(key, answer, error): one row per request that was asked; the error is NULL where there is an answer."""
        rows = self.spark.read.schema(_ROWS).parquet(self.path)
        one = rows.groupBy("key").agg(F.max("answer").alias("answer"), F.max("error").alias("error"))
        return one.withColumn("error", F.when(F.col("answer").isNull(), F.col("error")))

    def missing(self, asked: DataFrame) -> DataFrame:
        """(key, system, user): the different requests that have no answer yet."""
        texts = _keyed(asked).groupBy("_key").agg(*[F.first(c).alias(c) for c in ("_system", "_user")])
        known = self.told().filter("answer IS NOT NULL").select(F.col("key").alias("_key"))
        return texts.join(known, "_key", "left_anti").select(
            F.col("_key").alias("key"), F.col("_system").alias("system"), F.col("_user").alias("user")
        )

    def ask(
        self,
        asked: DataFrame,
        complete: Callable[[str, str], str],
        attempts: int = ATTEMPTS,
        pause: float = 1.0,
        per_round: int = PER_ROUND,
        per_task: int = PER_TASK,
    ) -> DataFrame:
        """The rows of `asked` with `answer` and `error`, as `requests.ask` gives them; asks only what is missing."""
        asked = stable(asked)
        waiting = new_path(self.spark, "requests")
        missing = stable(self.missing(asked))
        n = missing.count()
        rounds = math.ceil(n / per_round)
        if rounds:
            # A round reads its own folder alone.
            missing.withColumn("round", F.pmod(F.xxhash64("key"), F.lit(rounds))).write.partitionBy("round").parquet(waiting)
        for k in range(rounds):
            rows = self.spark.read.parquet(waiting).filter(F.col("round") == k).drop("round")
            tasks = math.ceil(min(n, per_round) / per_task)
            answers = requests.ask(rows.repartition(tasks, "key"), complete, attempts, pause)
            answers.select("key", "answer", "error").write.mode("append").parquet(self.path)
        told = self.told().select(F.col("key").alias("_key"), "answer", "error")
        return _keyed(asked).join(told, "_key", "left").select(*asked.columns, "answer", "error")


def _keyed(asked: DataFrame) -> DataFrame:
    system = F.coalesce("system", F.lit("")) if "system" in asked.columns else F.lit("")
    texts = asked.withColumns({"_system": system, "_user": F.coalesce("user", F.lit(""))})
    # The length in front keeps the two texts apart.
    return texts.withColumn("_key", F.sha2(F.concat(F.length("_system"), F.lit(":"), "_system", "_user"), 256))
