"""The pipeline against a brute-force version, stage by stage and as a whole."""

import ast
import re
from collections import Counter

import corpus_pipeline
import pytest

from signalmill.llm import quality

from . import test_decontaminate as decontaminate_brute
from . import test_jaccard_join as jaccard_brute
from .cases import ODD, table
from .test_quality import made
from .test_tokens_packing import ids_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    good, bad = made(120, False, 11), made(60, True, 12)
    items = list(enumerate(x[:120] for x in made(5, False, 13)))
    rows = list(enumerate([*good, *bad]))
    rows += [(1000 + i, t + (" extra words" if i % 4 == 0 else "")) for i, t in rows[:40]]
    rows += [(2000 + i, f"{t} {items[i][1]}") for i, t in enumerate(made(5, False, 14))]
    rows += [(3000 + i if i is not None else None, t) for i, t in ODD]
    table(spark, rows).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i < len(good)), 0) for i in range(len(good) + len(bad)) if i % 3]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, items


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def without_copies(rows):
    best, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in best:
            best[key] = i
            out.append((i, t))
    return Counter(out + [r for r in rows if r[0] is None])


def test_stages(spark, folder):
    root, rows, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing",
    ]

    kept = stages["quality classifier"](spark, docs, root).cache()
    model = quality.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))
    score = quality.scores(model)([t or "" for _, t in rows])
    assert pairs(kept) == Counter(r for r, s in zip(rows, score, strict=True) if s >= 0.3)
    assert kept.columns == columns and kept.count() < docs.count()

    left = list(pairs(kept).elements())
    kept = stages["exact dedup"](spark, kept, root).cache()
    assert pairs(kept) == without_copies(left) and kept.columns == columns

    left = list(pairs(kept).elements())
    kept = stages["n-gram Jaccard join"](spark, kept, root).cache()
    told = [ast.literal_eval(x) for x in jaccard_brute.brute(left)]
    first = {x[0] for x in told if x[0] == x[1]} - {None}
    assert pairs(kept) == Counter(r for r in left if r[0] in first or r[0] is None) and kept.columns == columns
    assert kept.count() < len(left)

    left = list(pairs(kept).elements())
    kept = stages["benchmark decontamination"](spark, kept, root).cache()
    clean = [r for r in left if not ast.literal_eval(decontaminate_brute.brute([r], items)[0])[4]]
    assert pairs(kept) == Counter(clean) and kept.columns == columns and len(clean) < len(left)

    done = corpus_pipeline.run(spark, root).collect()
    tokens = Counter()
    for r in done:
        tokens[r["doc_id"]] += r["length"]
    wanted = Counter()
    for i, t in clean:
        wanted[i] += len(ids_of(t)) + 1
    assert tokens == wanted
    used = Counter()
    for r in done:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024


def test_empty_documents(spark, folder, tmp_path):
    root, _, _ = folder
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{root}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
