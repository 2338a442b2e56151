"""Request and answer tables for a model that the user supplies.

This module writes the questions and reads the answers. The call in between is
user code: any function from (system, user) to text, run over partitions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import fixed
from signalmill.operators.chunks import chunk_views
from signalmill.operators.signals import MAX_EVIDENCE, MAX_ITEMS, MAX_QUOTE, MAX_SUMMARY

_CONSTRAINTS = {
    "max_items_per_chunk": MAX_ITEMS,
    "max_evidence_per_item": MAX_EVIDENCE,
    "max_summary_chars": MAX_SUMMARY,
    "max_quote_chars": MAX_QUOTE,
}
# The answer that `signals.answers_to_candidates` reads, with a hint for each field.
_ANSWER_FORMAT = json.dumps(
    {
        "items": [
            {
                "kind": "one of allowed_kinds",
                "summary": f"up to {MAX_SUMMARY} characters on one line",
                "severity": "one of allowed_severities",
                "confidence": "number from 0 to 1",
                "tags": ["short lower-case words"],
                "evidence": [
                    {"event_i": "i of the event", "role": "its role", "field_path": "text", "quote": "part of its text, verbatim"}
                ],
                "proposed_fix": {"fix_type": "area of the change", "description": "what to change"},
            }
        ]
    }
)


def chunk_requests(views: DataFrame, bounds: DataFrame) -> DataFrame:
    """(session_id, chunk_idx, system, user): one mining request per chunk.

    A chunk holds a bounded number of views, so its events fit one row.
    """
    shown = [c for c in ("i", "ts", "role", "tool", "status", "error_code", "text", "text_truncated", "raw_shape") if c in views.columns]
    events = (
        chunk_views(views, bounds)
        .groupBy("session_id", "chunk_idx")
        .agg(F.sort_array(F.collect_list(F.struct("v", F.struct(*shown).alias("e")))).alias("rows"))
    )
    limits = F.struct(
        *[F.lit(v).alias(k) for k, v in _CONSTRAINTS.items()],
        F.array(*[F.lit(k) for k in sorted(fixed.KINDS)]).alias("allowed_kinds"),
        F.array(*[F.lit(s) for s in sorted(fixed.SEVERITY_RANK)]).alias("allowed_severities"),
    )
    chunk_id = F.concat(F.lit("chunk:"), F.col("chunk_idx").cast("string"))
    user = F.concat(
        F.lit('{"chunk_id":"'), chunk_id, F.lit('","constraints":'), F.to_json(limits),
        F.lit(f',"schema":{_ANSWER_FORMAT},"events":'),
        F.to_json(F.col("rows.e"), {"ignoreNullFields": "false"}), F.lit("}"),
    )
    return events.select("session_id", "chunk_idx", F.lit(fixed.MINE_SYSTEM_PROMPT).alias("system"), user.alias("user"))


def classify_requests(clusters: DataFrame, context: DataFrame) -> DataFrame:
    """(signature_id, user): ask for the class of a cluster, with its evidence."""
    classes = "\n".join(f"- **{name}**: {text}" for name, text in fixed.CLASS_DESCRIPTIONS)
    user = F.concat(
        F.lit(
            "Assign the finding below, taken from the logs of an agent, to the class that fits it best.\n\n"
            f"Classes:\n{classes}\n\nFinding: "
        ),
        "canonical_summary",
        F.lit("\n\nWhat was said in its sessions:\n"),
        "context",
        F.lit(
            "\n\nWhere the finding and the sessions disagree, go by the sessions. Reply with one JSON object: "
            "class (" + ", ".join(fixed.EVAL_CLASSES) + "), confidence (high, medium, low), reasoning (a sentence or two)."
        ),
    )
    return clusters.join(context, "signature_id").select("signature_id", "kind_v2_primary", user.alias("user"))


def validity_requests(clusters: DataFrame, context: DataFrame) -> DataFrame:
    """(signature_id, user): ask whether a cluster is a real problem."""
    user = F.concat(
        F.lit("Review a finding that was mined from the logs of an agent.\n\nClass: "),
        "kind_v2_primary",
        F.lit("\nFinding: "),
        "canonical_summary",
        F.lit("\n\nWhat was said in its sessions:\n"),
        "context",
        F.lit(
            "\n\nDo the sessions show a problem that someone should fix? Reply with one JSON object: "
            "is_real_issue (true, false), confidence (high, medium, low), reasoning (a sentence or two), "
            "severity (none, low, medium, high)."
        ),
    )
    return clusters.join(context, "signature_id").select("signature_id", "kind_v2_primary", user.alias("user"))


def ask(requests: DataFrame, complete: Callable[[str, str], str], attempts: int = 1, pause: float = 1.0) -> DataFrame:
    """Add `answer` and `error` by calling `complete(system, user)` on the executors.

    A failing call is made up to `attempts` times, after `pause` seconds and twice
    as long each time. Then it gives a NULL answer and the kind and text of its last
    exception, so one bad request does not end the job and does not get lost; see
    `failed_requests`. Write the result out before using it twice: calls are not
    repeatable. `answers.AnswerStore` keeps answers over runs.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)

    def call(batches):
        for batch in batches:
            systems = batch["system"] if "system" in batch else [""] * len(batch)
            answers, errors = [], []
            for system, user in zip(systems, batch["user"], strict=True):
                answer, error = None, None
                for turn in range(attempts):
                    if turn:
                        time.sleep(pause * 2 ** (turn - 1))
                    try:
                        answer, error = complete(system, user), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            as_column = lambda values: pd.Series(values, index=batch.index, dtype="object")
            yield batch.assign(answer=as_column(answers), error=as_column(errors))

    return requests.mapInPandas(call, f"{fields}, answer string, error string")


def failed_requests(answers: DataFrame) -> DataFrame:
    """(requests, failed_requests): how many requests were made, and how many of them gave no answer."""
    return answers.agg(F.count("*").alias("requests"), F.count_if(F.col("answer").isNull()).alias("failed_requests"))


def fenced_json(answer: Column) -> Column:
    """The text inside the first code fence, or the whole text when there is none."""
    tagged = F.regexp_extract(answer, r"(?s)```json(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(answer, r"(?s)```(.*?)(?:```|\z)", 1)
    return (
        F.when(F.contains(answer, F.lit("```json")), tagged)
        .when(F.contains(answer, F.lit("```")), plain)
        .otherwise(answer)
    )


def class_answers(answers: DataFrame) -> DataFrame:
    """Add class, confidence, reasoning; an unreadable answer reads `unknown`."""
    parsed = F.from_json(fenced_json(F.trim("answer")), "class string, confidence string, reasoning string")
    bad = F.col("p.class").isNull()
    return answers.withColumn("p", parsed).select(
        *answers.columns,
        F.coalesce("p.class", F.lit("unknown")).alias("class"),
        F.when(bad, "none").otherwise(F.coalesce("p.confidence", F.lit(""))).alias("confidence"),
        F.when(bad, "unreadable answer").otherwise(F.coalesce("p.reasoning", F.lit(""))).alias("reasoning"),
    )


def validity_answers(answers: DataFrame) -> DataFrame:
    """Add is_real_issue, confidence, reasoning, severity; an unreadable answer counts as not real."""
    parsed = F.from_json(
        fenced_json(F.trim("answer")), "is_real_issue boolean, confidence string, reasoning string, severity string"
    )
    found = F.coalesce(F.col("p.is_real_issue").cast("string"), "p.confidence", "p.reasoning", "p.severity").isNotNull()
    return answers.withColumn("p", parsed).select(
        *answers.columns,
        F.coalesce("p.is_real_issue", F.lit(False)).alias("is_real_issue"),
        F.when(found, F.coalesce("p.confidence", F.lit("low"))).otherwise("none").alias("confidence"),
        F.when(found, F.coalesce("p.reasoning", F.lit(""))).otherwise("unreadable answer").alias("reasoning"),
        F.coalesce("p.severity", F.lit("none")).alias("severity"),
    )
