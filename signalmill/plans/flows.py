"""The three batch steps end to end, from session files to tickets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions import fixed
from signalmill.operators import chunks, merge, requests, rollup, signals, tickets
from signalmill.operators.answers import AnswerStore
from signalmill.operators.stable import stable
from signalmill.sources import items as item_files
from signalmill.sources import sessions


def mine_sessions(
    spark: SparkSession,
    root: str,
    out: str | None = None,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    max_sessions: int | None = None,
    chunk_events: int = chunks.CHUNK_EVENTS,
    chunk_overlap: int = chunks.CHUNK_OVERLAP,
    max_text_chars: int = 800,
    max_items_per_chunk: int = signals.MAX_ITEMS,
    complete: Callable[[str, str], str] | None = None,
    compat: bool = False,
    answers_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(items, summary) of the session files below `root`; items also go to `out` as JSON lines.

    By rule, or with the answers of a model when `complete(system, user)` is
    given; the summary then counts the requests and those that failed. With
    `answers_path`, answers are kept there and a later run asks only what is new.
    """
    views = stable(sessions.read_views(spark, root, include, exclude, max_sessions, max_text_chars))
    bounds = stable(chunks.chunk_bounds(views, chunk_events, chunk_overlap, compat=compat))
    if complete is None:
        items = signals.mine(views, bounds, max_items_per_chunk, compat)
    else:
        answers = stable(_asked(requests.chunk_requests(views, bounds), complete, answers_path))
        items = signals.validated(signals.answers_to_candidates(answers), views, bounds, max_items_per_chunk)
        items = items if compat else signals.without_overlap(items)
    items = stable(items)
    if out is not None:
        item_files.write_items(items, out)
    settings = {
        "mode": "mine-signals",
        "sessions_dir": root,
        "include": ",".join(include),
        "exclude": ",".join(exclude),
        "chunk_events": chunk_events,
        "chunk_overlap": chunk_overlap,
        "max_text_chars": max_text_chars,
        "max_items_per_chunk": max_items_per_chunk,
        "model": complete is not None,
    }
    summary = signals.mine_summary(views, items)
    made = {"requests": 0, "failed_requests": 0} if complete is None else requests.failed_requests(answers).first().asDict()
    settings |= {k: F.lit(v).cast("bigint") for k, v in made.items()}
    named = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in settings.items()]
    return items, summary.select(*named, "*")


def _asked(asked: DataFrame, complete: Callable[[str, str], str], answers_path: str | None) -> DataFrame:
    if answers_path is None:
        return requests.ask(asked, complete)
    return AnswerStore(asked.sparkSession, answers_path).ask(asked, complete)


def roll_up(
    items: DataFrame,
    merge_similar: bool = False,
    complete: Callable[[str, str], str] | None = None,
    max_samples: int = rollup.MAX_SAMPLES,
    max_tags: int = rollup.MAX_TAGS,
    auto_jaccard: float = merge.AUTO_JACCARD,
    ask_jaccard: float = merge.ASK_JACCARD,
    answers_path: str | None = None,
) -> DataFrame:
    """Ranked clusters of items, similar ones merged on request.

    With `complete`, a model decides on pairs a little below the merge threshold,
    until none between two clusters is left; its answers are kept below `answers_path`, if given.
    """
    clusters = rollup.rollups(items, max_samples, max_tags)
    if not merge_similar:
        return rollup.in_rank_order(clusters)
    clusters = stable(clusters)
    extra = None
    if complete is not None:
        system = F.lit(fixed.MERGE_SYSTEM_PROMPT).alias("system")

        def ask(asked: DataFrame) -> DataFrame:
            return _asked(asked.select("a", "b", system, "user"), complete, answers_path)

        extra = merge.asked_edges(clusters, ask, ask_jaccard, auto_jaccard)
    members = merge.merge_components(clusters, extra, threshold=auto_jaccard)
    named = rollup.with_signature(items).select("signature_id", "session_id")
    return rollup.in_rank_order(merge.merged_rollups(clusters, members, named, max_tags))


def plan_tickets(clusters: DataFrame, existing: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(updates, creates) of a ticket table (id, phid, name, description, pos)."""
    known = tickets.existing_fingerprints(existing)
    return tickets.ticket_updates(clusters, known), tickets.ticket_ir(tickets.ticket_creates(clusters, known, **limits))
