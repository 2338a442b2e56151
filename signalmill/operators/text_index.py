"""A stored index for texts that are asked for parts of words, instead of a scan per set of questions.

A search word of lower-case letters, digits and underscores occurs in a text
exactly if it is a part of one of the text's terms, its longest runs of these
characters. So the index has two tables, both sorted Parquet with `buckets`
folders per delivery, of which a question reads the folders it needs:

* postings (term, path), in the bucket of the term;
* grams (gram, term), the three-character parts of each different term, in the
  bucket of the gram.

The terms that hold a word are looked up under the word's rarest gram and
verified; their postings are the texts that hold the word. No text is read. New
documents are appended to both tables.

The best documents of a ticket come from its rarer words first. A document that
has none of them can only score the number of words left; where the best so far
score more, the words left are looked up for the documents already found alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from signalmill.operators.evidence import ticket_words
from signalmill.operators.ordered import first_per_key
from signalmill.operators.stable import stable

BUCKETS = 64
# Shortest term of the index, and the length of a gram.
GRAM = 3
_GRAMS = StructType().add("gram", StringType()).add("term", StringType())
_TERM = "[a-z0-9_]{%d,}"
# Tasks that the texts with one word are dealt to, when it is asked for and when it is written.
SALTS = 16
SPREAD = 8
# Bytes of text whose postings a task sorts, and rows that it joins; both bound its memory at any size.
TEXT_PER_TASK = 1 << 22
ROWS_PER_TASK = 1 << 19


def _terms(text: str) -> str:
    return f"array_distinct(regexp_extract_all(lower({text}), '{_TERM % GRAM}', 0))"


def _grams(term: str) -> str:
    return f"array_distinct(transform(sequence(1, length({term}) - {GRAM - 1}), k -> substr({term}, k, {GRAM})))"


def _bucket(name: str, buckets: int):
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("bucket")


def _tasks(spark: SparkSession, amount: int, each: int) -> int:
    """Tasks for some amount of work: those of a shuffle, or as many more as keep a task at `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def _write(rows: DataFrame, path: str, order: list[str], tasks: int, buckets: int) -> None:
    # A term that a third of the texts have is dealt to several tasks by their paths; there are four parts a task.
    spread = max(SPREAD, -(-4 * tasks // buckets))
    dealt = rows.repartition(tasks, F.col("bucket"), F.pmod(F.xxhash64(order[-1]), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)


def add_documents(documents: DataFrame, root: str, path: str = "path", text: str = "text", buckets: int = BUCKETS) -> None:
    """Append documents to the index at `root`. Rows without a path or a text are left out.

    `buckets` must stay the same over the life of an index. Rows that repeat a
    path are one document that has the terms of all of them.
    """
    spark = documents.sparkSession
    rows = documents.filter(F.col(path).isNotNull() & F.col(text).isNotNull())
    tasks = _tasks(spark, rows.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0, TEXT_PER_TASK)
    found = rows.select(F.col(path).alias("path"), F.explode(F.expr(_terms(f"`{text}`"))).alias("term"))
    # An index without a term yet still knows the type of its paths.
    found.select("term", "path").filter("false").write.mode("append").parquet(f"{root}/columns")
    delivery = f"delivery={uuid.uuid4().hex}"
    _write(found.select(_bucket("term", buckets), "term", "path"), f"{root}/postings/{delivery}", ["term", "path"], tasks, buckets)
    # The terms are read back from what was written, so the texts are cut once.
    written = spark.read.schema(StructType(_GRAMS.fields[1:])).parquet(f"{root}/postings/{delivery}").select("term")
    grams = written.distinct().select(F.explode(F.expr(_grams("term"))).alias("gram"), "term")
    _write(grams.select(_bucket("gram", buckets), "gram", "term"), f"{root}/grams/{delivery}", ["gram", "term"], tasks, buckets)


def _read(spark: SparkSession, path: str, schema: StructType, wanted: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows of the buckets that the values of `wanted` are in; there are `buckets` numbers at most."""
    numbers = [r[0] for r in wanted.select(_bucket(key, buckets)).distinct().collect()]
    return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path).filter(F.col("bucket").isin(numbers)).select(*schema.names)


def _dealt_join(few: DataFrame, many: DataFrame, key: str, tasks: int) -> DataFrame:
    """The join on `key`; the rows of `many` (key, path) under a frequent key are dealt by their paths, SALTS ways."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    parts = many.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    return salted.repartition(tasks, key, "salt").join(parts.repartition(tasks, key, "salt"), [key, "salt"])


def matches(spark: SparkSession, root: str, words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(word, path), once each: the documents that hold each word of `words` (word).

    Words have three or more of the characters a-z, 0-9 and _; others match nothing.
    """
    words = words.select("word").filter(F.col("word").rlike(f"^{_TERM % GRAM}$")).distinct()
    parts = stable(words.select("word", F.explode(F.expr(_grams("word"))).alias("gram")))
    columns = spark.read.parquet(f"{root}/columns").schema
    grams = _read(spark, f"{root}/grams", _GRAMS, parts, "gram", buckets)
    sizes = grams.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("terms"))
    # A gram that no term has rules its word out.
    sized = parts.join(sizes, "gram", "left").groupBy("word").agg(
        F.min_by("gram", F.struct(F.coalesce("terms", F.lit(0)), "gram")).alias("gram")
    )
    terms = stable(sized.join(grams, "gram").filter(F.contains("term", F.col("word"))).select("word", "term").distinct())
    postings = _read(spark, f"{root}/postings", columns, terms, "term", buckets)
    # The footers of the files tell how many postings there are.
    tasks = _tasks(spark, postings.count(), ROWS_PER_TASK)
    return _dealt_join(terms, postings, "term", tasks).select("word", "path").repartition(tasks, "word", "path").distinct()


def _asked(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(ticket_id, path) per word of a ticket that a document has; a frequent word is dealt by its documents."""
    tasks = _tasks(found.sparkSession, found.count(), ROWS_PER_TASK)
    return _dealt_join(asked, found, "word", tasks).select("ticket_id", "path")


def related_documents(
    spark: SparkSession, root: str, tickets: DataFrame, limit: int = 3, path: str = "path", buckets: int = BUCKETS
) -> DataFrame:
    """(ticket_id, path, score, place), as the scan of `evidence.related_documents` gives them."""
    words = ticket_words(tickets).filter("ticket_id IS NOT NULL AND size(words) > 0")
    words = words.dropDuplicates(["ticket_id"]).select("ticket_id", F.explode("words").alias("word"))
    words = stable(words.filter(F.length("word") >= GRAM))
    found = stable(matches(spark, root, words, buckets))
    # Words that no document has count for nothing. The rarer half of the others goes first.
    often = found.groupBy("word").agg(F.count("*").alias("documents"))
    known = words.join(often, "word")
    total = known.groupBy("ticket_id").agg(F.count("*").alias("total"))
    placed = first_per_key(known, ["ticket_id"], [F.col("documents"), F.col("word")], 1 << 30).join(total, "ticket_id")
    placed = stable(placed.select("ticket_id", "word", (F.col("_rank") <= F.ceil(F.col("total") / 2)).alias("early"), "total"))
    early, late = placed.filter("early"), placed.filter("NOT early").select("ticket_id", "word")
    counted = _asked(early.select("ticket_id", "word"), found).groupBy("ticket_id", "path").agg(F.count("*").alias("score"))
    counted = stable(counted)
    left = placed.groupBy("ticket_id").agg(F.count_if(~F.col("early")).alias("left"))
    best = first_per_key(counted, ["ticket_id"], [F.desc("score"), F.col("path")], limit)
    least = best.filter(F.col("_rank") == limit).select("ticket_id", F.col("score").alias("least"))
    state = stable(left.join(least, "ticket_id", "left").withColumn("closed", F.coalesce(F.col("least") > F.col("left"), F.lit(False))))
    closed, still_open = state.filter("closed"), state.filter("NOT closed").select("ticket_id")
    # Of a closed ticket only documents that can still reach its best are looked at again, by word and path.
    able = counted.join(closed, "ticket_id").filter(F.col("score") + F.col("left") >= F.col("least")).select("ticket_id", "path", "score")
    again = able.select("ticket_id", "path").join(late, "ticket_id").join(found, ["word", "path"]).select("ticket_id", "path")
    more = _asked(late.join(still_open, "ticket_id"), found)
    rest = again.unionByName(more).withColumn("score", F.lit(1).cast("bigint"))
    first = able.unionByName(counted.join(still_open, "ticket_id", "left_semi").select("ticket_id", "path", "score"))
    scores = first.unionByName(rest).groupBy("ticket_id", "path").agg(F.sum("score").cast("int").alias("score"))
    out = first_per_key(scores, ["ticket_id"], [F.desc("score"), F.col("path")], limit)
    return out.withColumnRenamed("_rank", "place").withColumnRenamed("path", path)


def search(spark: SparkSession, root: str, documents: DataFrame, query: str, path: str = "path", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The documents whose text holds `query`, in any case, with all their columns.

    Every run of the query must be a part of a term; only the texts of documents
    with all these parts are read and verified. A query without a run of three
    characters is a scan.
    """
    lowered = F.lower(F.lit(query))
    found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(_TERM % GRAM), F.lit(0)))
    runs = spark.range(1).select(F.explode(found).alias("word"))
    runs = stable(runs)
    n = runs.count()
    rows = documents
    if n:
        held = matches(spark, root, runs, buckets).groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") == n)
        held = held.select(F.col("path").alias("_path"))
        rows = rows.join(held, rows[path] == held["_path"], "left_semi")
    return rows.filter(F.contains(F.lower(F.col(text)), lowered))
