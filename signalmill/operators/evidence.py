"""Evidence for a cluster: fuzzy matches, session context, related documents."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.text import keywords, white_words
from signalmill.operators.ordered import first_per_key
from signalmill.operators.pairing import deal_out, groups_of, shared_counts, sort_by_group, starts_of
from signalmill.operators.stable import stable

SHARED_WORDS = 3
SIGNALS_PER_SUMMARY = 3
SNIPPETS = 15
BLOCK = 400
# Positions that one row of a span looks up.
SPAN = 64
# Tickets per scan of the documents.
TICKETS = 10_000


def matched_summaries(
    clusters: DataFrame, items: DataFrame, limit: int = SNIPPETS, shared: int = SHARED_WORDS, block: int = BLOCK
) -> DataFrame:
    """(signature_id, summary, first_pos): the first `limit` item summaries that share
    three words with the cluster's summary.

    Both sides are listed under all their words but the two most frequent ones,
    so two texts with three words in common meet. The texts under a word are
    compared inside tasks, which keep the first matches of each cluster: the
    first ones of all are among the first ones under some word.
    """
    summaries = (
        items.select(F.coalesce("summary", F.lit("")).alias("summary"), "pos")
        .groupBy("summary")
        .agg(F.min("pos").alias("first_pos"))
    )
    place = dict(summaries.dtypes)["first_pos"]
    key = dict(clusters.dtypes)["signature_id"]
    both = summaries.select(
        F.lit(None).cast(key).alias("signature_id"), "summary", "first_pos", F.expr(white_words("summary")).alias("words")
    ).unionByName(
        clusters.select(
            "signature_id",
            F.lit(None).cast("string").alias("summary"),
            F.lit(None).cast(place).alias("first_pos"),
            F.expr(white_words("canonical_summary")).alias("words"),
        )
    )
    both = both.filter(F.size("words") >= shared).withColumn("row", F.xxhash64("signature_id", "summary"))
    often = both.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ordered = (
        both.select("row", F.explode("words").alias("word"))
        .join(often, "word")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
        .select("row", F.col("w.word").alias("rare_first"))
    )
    listed = both.join(ordered, "row").select(
        "row",
        "signature_id",
        "summary",
        "first_pos",
        F.transform("words", lambda w: F.xxhash64(w)).alias("words"),
        F.explode(F.slice("rare_first", F.lit(1), F.size("rare_first") - (shared - 1))).alias("word"),
    )
    listed = listed.withColumn("key", F.xxhash64("word")).drop("word")
    sizes = listed.groupBy("key").agg(F.count("*").alias("members"), F.count("signature_id").alias("clusters"))
    useful = sizes.filter("clusters > 0 AND clusters < members").drop("clusters")
    dealt = sort_by_group(deal_out(listed.join(useful, "key"), "key", "row", block), "key", "first_pos")
    group_keys = ["key", "first", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, group_keys):
            starts = [*starts_of(rows, group_keys), rows.num_rows]
            for at, end in zip(starts, starts[1:], strict=False):
                group = rows.slice(at, end - at)
                common = shared_counts([np.sort(x.values.to_numpy()) for x in group.column("words").combine_chunks()])
                is_cluster = group.column("signature_id").is_valid().to_numpy()
                mine, theirs = np.flatnonzero(is_cluster), np.flatnonzero(~is_cluster)
                hit = common[np.ix_(mine, theirs)] >= shared
                if not group.column("first")[0].equals(group.column("second")[0]):
                    side = group.column("side").to_numpy()
                    hit &= side[mine][:, None] != side[theirs][None, :]
                # Rows come in the order of their first place.
                hit &= np.cumsum(hit, axis=1) <= limit
                a, b = np.nonzero(hit)
                found = group.select(["summary", "first_pos"]).take(pa.array(theirs[b]))
                found = found.add_column(0, "signature_id", group.column("signature_id").take(pa.array(mine[a])))
                yield from found.to_batches()

    schema = dealt.select("signature_id", "summary", "first_pos").schema
    pairs = dealt.mapInArrow(run, schema).distinct()
    return first_per_key(pairs, ["signature_id"], [F.col("first_pos")], limit).drop("_rank")


def fuzzy_evidence(clusters: DataFrame, items: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(signature_id, context): quotes and summaries of matching items, in order, without repeats.

    Every matched summary adds at least its own line, so 15 of them fill the 15 snippets.
    """
    matches = matched_summaries(clusters, items)
    per_summary = first_per_key(
        items.withColumn("summary", F.coalesce("summary", F.lit(""))).select("summary", "pos", "evidence"),
        ["summary"],
        [F.col("pos")],
        SIGNALS_PER_SUMMARY,
    )
    quotes = F.filter(
        F.transform(
            "evidence",
            lambda e: F.when(
                e["quote"] != "", F.concat(F.lit("["), F.coalesce(e["role"], F.lit("")), F.lit("]: "), e["quote"])
            ),
        ),
        lambda s: s.isNotNull(),
    )
    own = F.array(F.concat(F.lit("[signal]: "), "summary"))
    lines = per_summary.select(
        "summary", F.col("_rank").alias("item_no"), F.concat(F.coalesce(quotes, F.array().cast("array<string>")), own).alias("lines")
    )
    # At most 15 summaries x 3 items per cluster from here on.
    context = (
        matches.join(lines, "summary")
        .groupBy("signature_id")
        .agg(F.sort_array(F.collect_list(F.struct("first_pos", "item_no", "lines"))).alias("parts"))
        .select(
            "signature_id",
            F.slice(F.array_distinct(F.flatten("parts.lines")), 1, SNIPPETS).alias("snippets"),
        )
    )
    joined = F.substring(F.array_join("snippets", "\n---\n"), 1, max_chars)
    fallback = F.concat(F.lit("[canonical]: "), "canonical_summary")
    return (
        clusters.select("signature_id", "canonical_summary")
        .join(context, "signature_id", "left")
        .select("signature_id", F.coalesce(joined, fallback).alias("context"))
    )


def session_context(
    clusters: DataFrame,
    items: DataFrame,
    views: DataFrame,
    events: int = 50,
    snippets: int = 10,
    snippet_chars: int = 500,
    max_chars: int = 3000,
) -> DataFrame:
    """(signature_id, context): what was said early in the sessions of a cluster.

    Texts come from the first `events` events of a session, `snippet_chars`
    characters each; the first `snippets` by session and position are kept, cut
    to `max_chars` characters. `items` has signature_id and session_id.
    """
    opening = first_per_key(
        views.filter((F.col("i") < events) & F.col("role").isin("user", "assistant", "system") & (F.col("text") != "")),
        ["session_id"],
        [F.col("i")],
        snippets,
    ).select(
        "session_id",
        "i",
        F.concat(F.lit("["), "role", F.lit("]: "), F.substring("text", 1, snippet_chars)).alias("line"),
    )
    # The first ten snippets of a cluster come from its first ten sessions that have any.
    talking = opening.select("session_id").distinct()
    in_sessions = items.select("signature_id", "session_id").distinct().join(talking, "session_id", "left_semi")
    first_sessions = first_per_key(in_sessions, ["signature_id"], [F.col("session_id")], snippets).drop("_rank")
    first = first_per_key(
        first_sessions.join(opening, "session_id"), ["signature_id"], [F.col("session_id"), F.col("i")], snippets
    )
    found = first.groupBy("signature_id").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "line"))).alias("parts")
    )
    text = F.substring(F.array_join("parts.line", "\n---\n"), 1, max_chars)
    return clusters.select("signature_id", "canonical_summary").join(found, "signature_id", "left").select(
        "signature_id", F.coalesce(text, "canonical_summary").alias("context")
    )


def span_context(refs: DataFrame, views: DataFrame, before: int = 2, after: int = 1, limit: int = 12) -> DataFrame:
    """Events around a sample: session_id, item_id, i, role, text, at most 12 per sample.

    `refs` has session_id, item_id, start_i, end_i. The range is looked up in
    blocks of 64 positions, so it becomes an equality join that splits long
    sessions, and a long range is a few rows.
    """
    rows = refs.select(
        "session_id",
        "item_id",
        "start_i",
        F.greatest(F.col("start_i") - before, F.lit(0)).alias("_from"),
        (F.col("end_i") + after).alias("_to"),
    )
    spots = rows.withColumn("_block", F.explode(F.expr(f"sequence(_from div {SPAN}, _to div {SPAN})")))
    blocks = views.select("session_id", "i", "role", "text").withColumn("_block", F.expr(f"i div {SPAN}"))
    found = spots.join(blocks, ["session_id", "_block"]).filter("i >= _from AND i <= _to")
    first = first_per_key(found, ["session_id", "item_id", "start_i"], [F.col("i")], limit)
    ends = refs.select("session_id", "item_id", "start_i", "end_i").distinct()
    return first.join(ends, ["session_id", "item_id", "start_i"]).select(
        "session_id", "item_id", "start_i", "end_i", "i", "role", "text"
    )


def ticket_words(tickets: DataFrame, limit: int = 12) -> DataFrame:
    """(ticket_id, words): the search words of tickets (ticket_id, title, description)."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return tickets.select("ticket_id", text.alias("t")).select("ticket_id", F.expr(keywords("t", limit)).alias("words"))


def related_documents(
    documents: DataFrame, tickets: DataFrame, limit: int = 3, path: str = "path", text: str = "text", block: int = TICKETS
) -> DataFrame:
    """(ticket_id, path, score, place): the documents that hold most of each ticket's search words.

    The tickets are a query set: they go to the tasks in blocks of about `block`
    tickets, and each block is one scan of the documents. A task looks for all
    words of a block at once, as parts of the lower-cased text, and hands on the
    best documents of each ticket. Ties go by path; a document without any of
    the words is not related. NULL texts and ids match nothing.
    """
    words = stable(ticket_words(tickets).filter("ticket_id IS NOT NULL AND size(words) > 0"))
    blocks = max(1, -(-words.count() // block))
    rows = documents.filter(F.col(path).isNotNull() & F.col(text).isNotNull()).select(F.col(path).alias("path"), F.lower(text).alias("text"))
    kinds = dict(tickets.dtypes)["ticket_id"], dict(rows.dtypes)["path"]
    out = None
    for k in range(blocks):
        own = words.filter(F.pmod(F.xxhash64("ticket_id"), F.lit(blocks)) == k).collect()
        found = rows.mapInArrow(_best_documents([(r[0], list(r[1])) for r in own], limit), "ticket_id string, path string, score int")
        out = found if out is None else out.unionByName(found)
    out = out.select(F.col("ticket_id").cast(kinds[0]), F.col("path").cast(kinds[1]), "score")
    best = first_per_key(out, ["ticket_id"], [F.desc("score"), F.col("path")], limit)
    return best.withColumnRenamed("_rank", "place").withColumnRenamed("path", path)


def _best_documents(tickets: list[tuple], limit: int):
    """Task function: the best documents of each ticket among the rows (path, text) of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, owners = ahocorasick.Automaton(), {}
        for k, (_, words) in enumerate(tickets):
            for word in words:
                owners.setdefault(word, []).append(k)
        for word, own in owners.items():
            machine.add_word(word, np.array(own))
        if tickets:
            machine.make_automaton()
        best: list[list] = [[] for _ in tickets]
        for batch in batches if tickets else ():
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = {id(own): own for _, own in machine.iter(text)}
                if not hits:
                    continue
                score = np.bincount(np.concatenate(list(hits.values())), minlength=len(tickets))
                for k in np.flatnonzero(score):
                    if len(best[k]) < limit or (-score[k], path) < best[k][-1]:
                        bisect.insort(best[k], (-int(score[k]), path))
                        del best[k][limit:]
        rows = [(str(tickets[k][0]), str(path), -score) for k, own in enumerate(best) for score, path in own]
        columns = list(zip(*rows, strict=True))
        if columns:
            arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["ticket_id", "path", "score"])

    return run


def related_context(
    related: DataFrame, documents: DataFrame, path: str = "path", text: str = "text", max_chars: int = 6000
) -> DataFrame:
    """(ticket_id, context): the related documents of each ticket under a heading each, best first.

    Every document is cut to its share of `max_chars`.
    """
    share = F.floor(F.lit(max_chars) / F.count("*").over(Window.partitionBy("ticket_id"))).cast("int")
    parts = related.withColumn("_share", share).join(documents.select(path, text), path)
    body = F.concat(F.lit("## "), F.col(path).cast("string"), F.lit("\n\n"), F.left(F.col(text), F.col("_share")))
    listed = F.sort_array(F.collect_list(F.struct("place", body.alias("part"))))
    return parts.groupBy("ticket_id").agg(listed.alias("parts")).select("ticket_id", F.array_join("parts.part", "\n\n").alias("context"))
