"""Session logs: one JSONL file per session, one JSON event per line."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.functions import ragged
from signalmill.functions.sql import Sql, keep, let
from signalmill.functions.text import session_key, strip
from signalmill.operators.events import MAX_TEXT, event_view, numbered_views, rows_of
from signalmill.operators.ordered import renumbered
from signalmill.operators.stable import stable


def glob_regex(pattern: str) -> str:
    """Anchored regex of a shell pattern whose `*` also crosses folder borders."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        close = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[k + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            k = close
        else:
            out.append(re.escape(c))
        k += 1
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def _any_glob(path: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | path.rlike(glob_regex(pattern))
    return hit


def rel_path(path: Column, root: str) -> Column:
    """A file's path below `root`, from its URI. Batch and stream name sessions by it."""
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    # File paths come back URI-encoded.
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, rf"\A.*?{re.escape(base)}/+", "")


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_LISTINGS_KEPT = "spark.sql.hive.filesourcePartitionFileCacheSize"


@contextmanager
def listing_in_parts(spark: SparkSession) -> Iterator[None]:
    """Files are listed in a few tasks per core; by default there is a task per folder, so one per session.

    Nothing asks for a listing again, so the driver does not keep them beside the
    readers either; by default they fill up to 250 MB of its memory.
    """
    wanted = {_LISTING: str(8 * spark.sparkContext.defaultParallelism), _LISTINGS_KEPT: "0"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def read_lines(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    max_sessions: int | None = None,
    name_glob: str = "*.jsonl",
) -> DataFrame:
    """Raw lines of all session files below `root`: rel_path, block_start, seq, value.

    The path filters work on the listing, before a file is opened. `seq` orders
    the lines of a file block, which one task reads from start to end.
    """

    def chosen(files: DataFrame, uri: str) -> DataFrame:
        path = rel_path(F.col(uri), root)
        files = files.filter(_any_glob(path, include)) if include else files
        return files.filter(~_any_glob(path, exclude)) if exclude else files

    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name_glob)
    # Below the numbering, where the filters reach the scan.
    with listing_in_parts(spark):
        lines = chosen(reader.text(root), "_metadata.file_path")
    if max_sessions is not None:
        # The first names by the listing; the last one of them bounds the scan.
        with listing_in_parts(spark):
            listed = reader.format("binaryFile").load(root)
        names = chosen(listed, "path").select(rel_path(F.col("path"), root).alias("name"))
        last = names.orderBy("name").limit(max_sessions).agg(F.max("name")).first()[0]
        lines = lines.filter(rel_path(F.col("_metadata.file_path"), root) <= F.lit(last))
    return lines.select(
        rel_path(F.col("_metadata.file_path"), root).alias("rel_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def _parsed(max_raw: int | None = None) -> Sql:
    """struct<event, parse_error, raw> of the line in `value`, NULL for a blank one."""
    kept = "{line}" if max_raw is None else f"left({{line}}, {int(max_raw)})"

    def parsed(line: Sql, value: Sql) -> Sql:
        return (
            f"named_struct('event', IF({ragged.is_object(value)}, {value}, NULL), "
            f"'parse_error', IF({value} IS NULL, 'malformed JSON', NULL), "
            f"'raw', IF({value} IS NULL, {kept.format(line=line)}, NULL))"
        )

    return let(
        strip("value"),
        lambda line: f"IF({line} = '', NULL, {let(f'try_parse_json({line})', lambda value: parsed(line, value))})",
    )


def parse_events(rows: DataFrame, max_raw: int | None = None) -> DataFrame:
    """Parse non-blank lines: adds event (VARIANT), parse_error and raw. Bad lines stay as rows.

    `max_raw` cuts the text of bad lines.
    """
    others = [c for c in rows.columns if c != "value"]
    return rows.select(*others, F.expr(f"inline(array_compact(array({_parsed(max_raw)})))"))


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add `line_no`, the 1-based line of a file, to lines as the scan gives them.

    `seq` counts up by one inside a file block, so a line's number follows from
    the first `seq` of its block and the lines of the blocks before: one row per
    block, counted in a scan of its own. Texts are neither written nor sorted.
    A file may grow meanwhile, which only adds lines behind its last block; a
    file that changes otherwise ends in an error.
    """
    by_block = Window.partitionBy("rel_path").orderBy("block_start")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("rel_path", "block_start")
        .agg(F.count("*").alias("rows"), F.min("seq").alias("first"))
        .withColumn("shift", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .withColumn("limit", F.when(F.lead("rows").over(by_block).isNotNull(), F.col("rows")))
        .drop("rows")
    )
    placed = lines.join(blocks, ["rel_path", "block_start"], "left")
    # A block without a count, or with other lines than were counted.
    changed = "first IS NULL OR seq < first OR seq - first >= limit"
    line_no = F.expr(
        f"IF(coalesce({changed}, false), raise_error(concat(rel_path, ' changed while it was read')), seq - first + shift + 1)"
    ).cast("bigint")
    return placed.withColumn("line_no", line_no).drop("first", "shift", "limit", "block_start", "seq")


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Add `out`: the 1-based place of a row in its file. Needs rel_path, block_start, seq.

    Rows are numbered per (file, block) and shifted by the rows of the blocks
    before, so a very large file is spread over its blocks. The rows are written
    once first: both uses below must see the same file splits.
    """
    rows = stable(rows)
    in_block = Window.partitionBy("rel_path", "block_start").orderBy("seq")
    earlier = (
        Window.partitionBy("rel_path")
        .orderBy("block_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        rows.groupBy("rel_path", "block_start")
        .agg(F.count("*").alias("rows"))
        .withColumn("shift", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .drop("rows")
    )
    return (
        rows.withColumn("in_block", F.row_number().over(in_block))
        .join(shifts, ["rel_path", "block_start"])
        .withColumn(out, F.col("shift") + F.col("in_block"))
        .drop("shift", "in_block", "block_start", "seq")
    )


def read_sessions(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    max_sessions: int | None = None,
    max_events: int | None = None,
    name_glob: str = "*.jsonl",
) -> DataFrame:
    """Events of all sessions: session_id, rel_path, line_no, i, event, parse_error, raw.

    A file is opened once: the parsed lines are written, and both counts read them there.
    """
    lines = read_lines(spark, root, include, exclude, max_sessions, name_glob)
    parsed = stable(lines.select("rel_path", "block_start", "seq", F.expr(_parsed()).alias("_parsed")))
    # A blank line counts as a line, but is no event.
    placed = with_line_numbers(parsed).filter("_parsed IS NOT NULL")
    placed = placed.select("rel_path", "line_no", F.expr(session_key("rel_path")).alias("session_id"), "_parsed.*")
    events = renumbered(placed, ["session_id"], "line_no", "i")
    return events if max_events is None else events.filter(F.col("i") < max_events)


def read_views(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    max_sessions: int | None = None,
    max_text: int = MAX_TEXT,
    redactor: Callable[[Sql], Sql] | None = None,
    name_glob: str = "*.jsonl",
) -> DataFrame:
    """Normalised events of all sessions with `i` and `v`, ready for chunking.

    Lines are parsed and shortened inside the scan. Only the views are written
    and shuffled, never the raw lines; an event that is no view keeps an empty
    row until it has been counted.
    """
    lines = read_lines(spark, root, include, exclude, max_sessions, name_glob)
    view = event_view(max_text, redactor)
    views = rows_of(parse_events(lines), ["rel_path", "block_start", "seq"], f"named_struct('view', {view})")
    placed = numbered(views, "place").filter("view IS NOT NULL")
    rows = placed.select(
        F.expr(session_key("rel_path")).alias("session_id"), "rel_path", (F.col("place") - 1).alias("i"), "view.*"
    )
    return numbered_views(rows)


def read_messages(spark: SparkSession, root: str, include: Sequence[str] = (), name_glob: str = "*.jsonl") -> DataFrame:
    """Message events only, with the text of their first text block.

    `idx` is the 0-based line number, blank and bad lines included.
    """
    events = read_sessions(spark, root, include, name_glob=name_glob)
    blocks = ragged.get("event", "$.message.content", "array<variant>")
    first = keep(blocks, lambda b: f"{ragged.text_at(b, '$.type')} = 'text'")

    def at(path: str) -> Column:
        return F.expr(ragged.text_at("event", path))

    return events.filter(at("$.type") == "message").select(
        "session_id",
        "rel_path",
        (F.col("line_no") - 1).alias("idx"),
        at("$.timestamp").alias("timestamp"),
        at("$.message.role").alias("role"),
        F.expr(f"coalesce({ragged.text_at(f'get({first}, 0)', '$.text')}, '')").alias("text"),
        at("$.message.model").alias("model"),
    )
