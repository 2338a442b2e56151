"""Markdown documents: reading, splitting into sections, packing into a character budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions.text import rstrip, split_lines, strip
from signalmill.operators.ordered import running_total

CUT_MARK = "\n...[truncated]\n"


def read_documents(spark: SparkSession, root: str, name_glob: str = "*.md") -> DataFrame:
    """(path, text) of every Markdown file below `root`."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", name_glob)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def sections(documents: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, section, heading, body): section 0 is the preamble, without a heading.

    Row-local: a section starts at every line that begins with `## `.
    """
    # A line break mark that no heading contains joins the lines again.
    joined = F.array_join(F.expr(split_lines(f"`{text}`")), "\n")
    parts = F.split(F.concat(F.lit("\n"), joined), r"\n(?=## )")
    rows = documents.select(key, F.posexplode(parts).alias("section", "part"))
    is_preamble = F.col("section") == 0
    lines = F.split("part", "\n")
    heading = F.when(~is_preamble, F.expr(strip("split(part, '\\n')[0]")))
    rest = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")
    # The preamble starts behind the break put in front of the text.
    parts = rows.select(key, "section", heading.alias("heading"), rest.alias("rest"))
    return parts.select(key, "section", "heading", F.expr(rstrip("rest")).alias("body")).filter(
        ~((F.col("section") == 0) & (F.col("body") == ""))
    )


def packed(documents: DataFrame, max_chars: int, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """Documents of each key in order until the budget is used up; the last one is cut and marked.

    The running total splits a key with many documents over several tasks, and
    carries lengths only: texts that stay outside the budget are dropped early.
    """
    sized = running_total(
        documents.select(*keys, *order, F.length(text).alias("_length")), keys, order, F.col("_length"), "used"
    ).filter(F.col("used") < max_chars)
    inside = documents.join(sized.drop("_length"), [*keys, *order])
    left = F.lit(max_chars) - F.col("used")
    cut = F.concat(F.left(F.col(text), left.cast("int")), F.lit(CUT_MARK))
    return inside.withColumn(text, F.when(F.length(text) > left, cut).otherwise(F.col(text)))
