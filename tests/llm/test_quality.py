import random
import zlib

import numpy as np

from signalmill.llm import quality

from .cases import ODD, table


def made(n, bad, seed):
    rng = random.Random(seed)
    words = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "near", "river"]
    junk = ["###", "&&&", "BUY!!", "NOW!!", "|", "$$$"]
    return [" ".join(rng.choice(junk if bad and rng.random() < 0.6 else words) for _ in range(rng.randint(20, 300))) for _ in range(n)]


def test_held_out_accuracy_and_interface(spark):
    good, bad = made(250, False, 1), made(120, True, 2)
    rows = list(enumerate([*good, *bad]))
    labels = [(i, int(i < len(good)), 0) for i, _ in rows]
    labels += [(0, 1, 0), (1, 0, 0), (None, 1, 0), (9999, 1, 0), (5, None, 0)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, text int")
    docs = table(spark, rows + [(1000 + (i or 0), t) for i, t in ODD])
    model = quality.fit(docs, known)
    found = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert found.keys() == {r["doc_id"] for r in docs.collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (i in held) for i, _ in rows)
    right = [found[i]["predicted"] == (i < len(good)) for i in held]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    left = quality.accepted(docs, model)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in found.items() if r["predicted"]}


def test_scores_equal_a_plain_version(spark):
    """Pieces of 128 bytes, each compressed with either dictionary on its own."""
    import math

    import zstandard

    good, bad = made(80, False, 5), made(80, True, 6)
    rows = [*enumerate([*good, *bad]), *((1000 + (i or 0), t) for i, t in ODD)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)

    def size(piece, dictionary):
        own = zstandard.ZstdCompressionDict(dictionary)
        options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return len(zstandard.ZstdCompressor(dict_data=own, **options).compress(piece))

    def score(text):
        raw = (text or "").encode()
        pieces = [raw[i : i + 128] for i in range(0, len(raw), 128)]
        gain = sum(size(p, model.bad) - size(p, model.good) for p in pieces)
        return 1 / (1 + math.exp(-(model.a + model.b * gain / max(1, len(raw)))))

    small = [(i, t) for i, t in rows if len(t or "") < 5_000]
    got = sorted((r["doc_id"], r["score"]) for r in quality.scored(table(spark, small), model).collect())
    assert np.allclose([s for _, s in got], [s for _, s in sorted((i, score(t)) for i, t in small)], atol=1e-9)
    # The dictionaries come from folds 1 to 3 alone: other texts of fold 4 do not change them.
    others = [(i, t if zlib.crc32(str(i).encode()) % 5 != 4 else t[::-1]) for i, t in rows if t is not None]
    again = quality.fit(table(spark, others), labels)
    assert (again.good, again.bad) == (model.good, model.bad)


def test_repeats_of_a_labelled_id_do_not_grow_the_sample(spark):
    good, bad = made(30, False, 7), made(30, True, 8)
    rows = [*enumerate([*good, *bad]), *((1, f"{t} again") for t in good * 20), *((1, None) for _ in range(50))]
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id bigint, quality int")
    sample = quality._sample(table(spark, rows), labels, "doc_id", "text", "quality", 10).collect()
    assert len(sample) == len({r["_id"] for r in sample}) <= 40
    fitted = quality.fit(table(spark, rows), labels)
    assert 0 < len(fitted.good) <= quality.DICTIONARY_BYTES


def test_held_out_labels_are_not_learnt(spark):
    good, bad = made(60, False, 3), made(60, True, 4)
    rows = list(enumerate([*good, *bad]))
    labels = [(i, int(i < 60)) for i, _ in rows]
    turned = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in labels]
    docs = table(spark, rows)
    a, b = (quality.fit(docs, spark.createDataFrame(x, "doc_id bigint, quality int")) for x in (labels, turned))
    assert (a.good, a.bad, round(a.a, 9), round(a.b, 9)) == (b.good, b.bad, round(b.a, 9), round(b.b, 9))


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = table(spark, [*ODD])
    assert {r["score"] for r in quality.scored(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int")
    assert all(r["predicted"] for r in quality.scored(docs, quality.fit(docs, one)).collect())
    empty = table(spark, [])
    assert quality.scored(empty, quality.fit(empty, none)).count() == 0
