import hashlib

import pytest
from pyspark.sql import functions as F

from signalmill.llm import merkle_manifest as mm

from .cases import ODD, table


def h(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(*fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves):
    """Root and, per leaf, the siblings left and right of its way up."""
    level, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, own in enumerate(at):
            first = own - own % 3
            ways[k] += ["".join(level[first:own]), "".join(level[own + 1 : first + 3])]
            at[k] = own // 3
        level = [h("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], ways


def brute(rows, claims):
    """rows of (id, group, text), claims their other texts: the expected proofs as sorted reprs."""
    groups = {}
    for (i, group, text), claim in zip(rows, claims, strict=True):
        groups.setdefault(group, []).append(((i is not None, i or 0), leaf(i, text), i, leaf(i, claim)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    told = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in names}
    root, upper = tree([told[g][0] for g in names]) if names else ("", [])
    out = []
    for g, above in zip(names, upper, strict=True):
        subroot, ways = told[g]
        for number, ((_, own, i, claim), way) in enumerate(zip(sorted(groups[g], key=lambda x: x[:2]), ways, strict=True)):
            digest = claim
            for left, right in zip((way + above)[::2], (way + above)[1::2], strict=True):
                digest = h(left + digest + right)
            out.append((i, number, own, subroot, root, way + above, digest))
    return sorted(map(repr, out))


def check(spark, rows, levels, parts=3, change=lambda t: t and t.replace("\n", "")):
    kind = "doc_id bigint, place string, text string, i int, tree string, block int, leaf string, path string"
    df = spark.createDataFrame([(i, g, t, 1, "x", 2, "y", "z") for i, g, t in rows], kind)
    df = df.repartition(parts) if rows else df
    claimed = [F.col("doc_id"), F.regexp_replace("text", "\n", "")]
    leaves = mm.leaves(df, "doc_id", "place", [F.col("doc_id"), F.col("text")], claimed)
    made = mm.manifest(leaves, levels)
    expected = brute(rows, [change(t) for _, _, t in rows])
    got = mm.proofs(made, leaves)
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected
    return leaves, made, expected


def test_odd_rows(spark):
    rows = [(i, ("a", None, "", "ü")[k % 4], t) for k, (i, t) in enumerate(ODD)]
    check(spark, rows, 3)
    check(spark, rows, mm.LEVELS)


def test_a_hot_group_in_many_small_subtrees(spark):
    rows = [(i * 7 % 1000, "hot" if i % 3 else f"g{i % 50}", f"line {i}\nmore") for i in range(1000)]
    check(spark, rows, 3)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 81, 82])
def test_sizes_around_powers(spark, n):
    check(spark, [(i, "one", f"{i}\n") for i in range(n)], 3, 2)


def test_empty(spark):
    check(spark, [], 3)


def test_documents_with_clashing_columns(spark):
    docs = table(spark, ODD)
    leaves = mm.leaves(docs, "doc_id", "_id", [F.col("doc_id"), F.col("text")])
    found = mm.proofs(mm.manifest(leaves), leaves).collect()
    assert len(found) == len(ODD) and all(r["folded_root"] == r["root"] for r in found)


def test_stored_manifest_proves_some_leaves(spark, tmp_path):
    rows = [(i, f"g{i % 3}", f"{i}") for i in range(60)]
    leaves, made, expected = check(spark, rows, 3)
    mm.as_table(made).write.parquet(f"{tmp_path}/manifest")
    again = mm.from_table(spark.read.parquet(f"{tmp_path}/manifest"))
    some = mm.proofs(again, leaves.filter("id % 10 = 4")).collect()
    assert len(some) == 6 and {repr(tuple(r)) for r in some} <= set(expected)
    strange = leaves.filter("id = 4").withColumn("i", F.lit(10_000).cast("bigint"))
    told = mm.proofs(again, strange).collect()
    assert [(r["doc_id"], r["siblings"], r["folded_root"]) for r in told] == [(4, None, None)]


@pytest.mark.parametrize("levels", range(1, 9))
def test_layout(levels):
    places = [mm.address(levels, d, k) for d in range(levels) for k in range(3**d)]
    assert sorted(places) == list(range(mm.nodes_in(levels)))
    if levels > 1:
        # Each lower part of the split at half height is one stretch.
        top = levels // 2
        size = mm.nodes_in(levels - top)
        for part in range(3**top):
            inside = [mm.address(levels, top + d, part * 3**d + k) for d in range(levels - top) for k in range(3**d)]
            assert sorted(inside) == list(range(mm.nodes_in(top) + part * size, mm.nodes_in(top) + (part + 1) * size))
