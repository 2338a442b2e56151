"""Session traces derived from the `events` table, and other driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.ordered import ranked
from signalmill.operators.stable import stable

# Text of an event by (event_id * 7 + k) % 20; anything else reads 'ok'.
_TEXTS = """CASE (event_id * 7 + k) % 20
  WHEN 0 THEN 'traceback: step ' || CAST(k % 5 AS STRING) || ' failed with exit code 1'
  WHEN 1 THEN 'this is confusing and not what i meant'
  WHEN 2 THEN 'we should add a retry to the gateway'
  WHEN 3 THEN 'run an ablation benchmark before release ' || CAST(k % 3 AS STRING)
  WHEN 4 THEN 'share the demo with the community'
  WHEN 5 THEN 'wow that was a lovely surprise'
  WHEN 6 THEN 'Cron (error): got it, here is the draft'
  WHEN 7 THEN 'Cron (ok): nothing to report'
  WHEN 8 THEN 'Cron (error): gateway timed out'
  WHEN 9 THEN 'contact ops@example.com from 10.0.0.1'
  WHEN 10 THEN 'see https://example.com/a?b=1 and /home/user/x.log'
  WHEN 11 THEN 'token sk-abcdef123456 was rotated'
  WHEN 12 THEN 'fix it: call 555-123-4567 about card 41111111111111'
  WHEN 13 THEN 'suggest an incident report: session lost its key'
  WHEN 14 THEN 'avoid this: request timed out due to rate limit'
  WHEN 15 THEN 'read HEARTBEAT.md and follow it strictly'
  WHEN 16 THEN 'change the prompt format and explain the tool ' || CAST(k % 4 AS STRING)
  WHEN 17 THEN 'improve privacy of the logs'
  WHEN 18 THEN ''
  ELSE 'ok' END"""

_ROLE = """CASE event_type WHEN 'error' THEN 'toolResult' WHEN 'click' THEN 'toolCall'
  WHEN 'view' THEN 'assistant' ELSE 'user' END"""

_TOOL = """CASE WHEN event_type IN ('error', 'click') THEN
  CASE event_id % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'exec' WHEN 2 THEN 'read'
    WHEN 3 THEN 'edit' WHEN 4 THEN 'memory_search' ELSE 'cron' END END"""

_numbered: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_columns(events: DataFrame, *carry: str) -> DataFrame:
    """Trace columns of `events` rows. Row-local; `carry` names columns to keep."""
    return events.withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    ).selectExpr(
        "'s' || CAST(user_id AS STRING) AS session_id",
        *carry,
        "event_id AS pos",
        "CAST(ts AS TIMESTAMP) AS ts",
        f"{_ROLE} AS role",
        f"{_TOOL} AS tool",
        "CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN 'error' ELSE 'ok' END END AS status",
        "CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN 'EXIT_' || CAST(k % 4 AS STRING) END AS error_code",
        f"{_TEXTS} AS text",
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace view: one session per user, `i` by (ts, event_id).

    The trace is written once per application to the shared folder; all queries
    of the application start from there.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _numbered:
        events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
        _numbered[key] = stable(trace_columns(ranked(events, ["user_id"], ["ts", "event_id"], "i"), "i"))
    return _numbered[key]


# Old and nested shapes, a bad line and a heartbeat line, by event id.
_JSON = """CASE
  WHEN pos % 29 = 0 THEN '{"type": "message", "broken'
  WHEN pos % 23 = 0 THEN to_json(named_struct('type', 'heartbeat', 'timestamp', stamp))
  WHEN pos % 11 = 0 THEN to_json(named_struct(
    'role', role, 'tool', tool, 'status', status, 'error_code', error_code, 'content', text, 'timestamp', stamp))
  WHEN role = 'toolResult' THEN to_json(named_struct('type', 'message', 'timestamp', stamp, 'message',
    named_struct('role', role, 'toolName', tool, 'toolCallId', 'c' || CAST(pos AS STRING),
      'details', named_struct('status', status, 'exitCode', CAST(substr(error_code, 6) AS INT)),
      'content', array(named_struct('type', 'text', 'text', text)))))
  WHEN role = 'toolCall' THEN to_json(named_struct('type', 'message', 'timestamp', stamp, 'message',
    named_struct('role', role, 'toolName', tool, 'input', named_struct('action', tool, 'text', text))))
  WHEN pos % 2 = 0 THEN to_json(named_struct('type', 'message', 'timestamp', stamp, 'message',
    named_struct('role', role, 'content', text)))
  ELSE to_json(named_struct('type', 'message', 'timestamp', stamp, 'message',
    named_struct('role', role, 'content', array(named_struct('type', 'text', 'text', text)))))
  END"""


def trace_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace as raw JSON lines of every shape: session_id, line_no, i, pos, value."""
    rows = trace(spark, sf_dir).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return rows.selectExpr("session_id", "i + 1 AS line_no", "i", "pos", f"{_JSON} AS value")


# Documents as events of five shapes, with long texts, line breaks, quotes and every field of a tool result.
_DOCUMENT_JSON = """CASE doc_id % 5
  WHEN 0 THEN to_json(named_struct('role', 'assistant', 'tool', 'exec', 'input', named_struct('action', lang),
    'error', concat('bad "quote" ', lang), 'stderr', lang, 'stdout', source, 'content', text))
  WHEN 1 THEN to_json(named_struct('type', 'message', 'message', named_struct('role', 'toolResult', 'toolName', 'exec',
    'details', named_struct('status', 'error', 'exitCode', 2, 'error', concat('it\\'s "', lang, '"\n', source),
      'stderr', text, 'stdout', source, 'aggregated', lang),
    'content', array(named_struct('type', 'text', 'text', text)))))
  WHEN 2 THEN to_json(named_struct('type', 'message', 'message', named_struct('role', 'toolCall', 'toolName', 'read',
    'input', named_struct('action', lang, 'text', text))))
  WHEN 3 THEN to_json(named_struct('type', 'message', 'message', named_struct('role', 'user',
    'content', named_struct('k', 1, 'stdout', text))))
  ELSE to_json(named_struct('type', 'message', 'message', named_struct('role', 'user',
    'content', concat('"quoted" \\\\ ', text, '\t| end'))))
  END"""


def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as raw JSON lines: session_id (source), line_no, i (doc_id), value."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS session_id", "doc_id + 1 AS line_no", "doc_id AS i", f"{_DOCUMENT_JSON} AS value"
    )


def forget() -> None:
    _numbered.clear()
