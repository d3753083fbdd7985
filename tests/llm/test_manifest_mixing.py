"""The manifest and the mix against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webstrata.llm import merkle, mixing
from webstrata.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    fields = [row[0], row[3], row[2], row[4], row[1]]
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def grow(nodes):
    """Root and, per node, its (position, siblings) from the bottom up."""
    paths, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, members = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for k in range(len(run)):
                for i in held[at + k]:
                    paths[i].append((k, run[:k] + run[k + 1:]))
            above.append(digest(*run))
            members.append([i for k in range(len(run)) for i in held[at + k]])
        nodes, held = above, members
    return nodes[0], paths


def by_hand(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[3]].append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    found = []
    for name in names:
        ordered = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        found.append((ordered, *grow([leaf_of(r) for r in ordered])))
    root, tops = grow([subroot for _, subroot, _ in found])
    out = Counter()
    for (ordered, subroot, paths), top in zip(found, tops):
        for row, path in zip(ordered, paths):
            siblings = "".join(s for _, level in path + top for s in level)
            odd = row[0] is None or zlib.crc32(str(row[0]).encode()) % 2
            shown = row if odd or row[1] is None else (row[0], row[1].replace("\n", ""), *row[2:])
            fold = leaf_of(shown)
            for k, level in path + top:
                fold = digest(*level[:k], fold, *level[k:])
            out[(row[0], leaf_of(row), subroot, root, digest(siblings), fold, fold == root)] += 1
    return out


def some_rows():
    rows = [(i, f"text\n{i}" if i % 3 else "é 日\n", "en", "big", i) for i in range(100)]
    rows += [(i, None if i % 2 else "", None, f"s{i % 9}", None) for i in range(40)]
    rows += [(5, "same\n", "en", "big", 1)] * 30 + [(None, "no id\n", "x", None, 0)] * 2
    return rows + [(7, "alone", "de", "\U0001d11e", 3), (8, "alone", "de", "￮", 3), (9, "e", "", "", 3)]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "old") for r in rows], DOCS + ", digest string")
    bare = [F.col(c) for c in merkle.COLUMNS[:-1]] + [F.replace("text", F.lit("\n"), F.lit(""))]
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                   merkle.leaf_digest(bare))
    manifest = merkle.build_manifest(df.repartition(7), carry={"shown": shown}, levels=levels)
    got = merkle.prove(manifest, shown="shown", with_siblings=True)
    assert Counter((r["order"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"],
                    r["folded_root"], r["verified"]) for r in got.collect()) == by_hand(rows)
    # A request for some leaves of one tree gives the same proofs.
    some = manifest.leaves.where("tree = '=s3'").withColumn("items", F.slice("items", 2, 2))
    asked = {r["leaf"]: r["siblings"] for r in merkle.prove(manifest, some, with_siblings=True).collect()}
    every = {r["leaf"]: r["siblings"] for r in got.collect()}
    assert asked and all(every[leaf] == path for leaf, path in asked.items())
    assert all(digest(*path) in {r["proof_sha256"] for r in got.collect()} for path in asked.values())


def test_manifest_query(spark, folder):
    rows = some_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, folder)
    assert Counter(map(tuple, got.collect())) == by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(1, "one", "en", "a", 3)], [(1, None, None, None, None)] * 4])
def test_manifest_of_few_rows(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, folder).collect()
    assert Counter(map(tuple, got)) == (by_hand(rows) if rows else Counter())


def shares_by_hand(sizes, share, weights, most):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_ = {}, list(names)
    left = share * sum(sizes.values())
    while open_:
        total = sum(weight[n] for n in open_)
        above = [n for n in open_ if left * weight[n] / total >= most * sizes[n]]
        if not above:
            target.update({n: left * weight[n] / total for n in open_})
            break
        for name in above:
            target[name] = float(most * sizes[name])
        left -= sum(target[n] for n in above)
        open_ = [n for n in open_ if n not in above]
    return target


def test_mix(spark):
    random = np.random.default_rng(3)
    rows = [(i, " ".join("w%d" % k for k in random.integers(0, 99, random.integers(1, 60))),
             "en", f"s{i % 7}" if i % 3 else "hot", 0) for i in range(600)]
    rows += [(1000, None, "en", "empty", 0), (1001, " \t\n", None, "empty", 0), (1002, "", "e", None, 0)]
    rows += [(1003, "word " * 5000, "en", "one", 0), (1004, "a b", "en", None, 1), (5, "x y\n" * 9, "", "hot", 2)]
    rows += [(1005, "same words here", "en", "hot", 0)] * 20 + [(None, "no id", "en", "hot", 0)] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", size int, row string")
    got = mixing.mix(df.repartition(9)).collect()
    again = mixing.mix(df.repartition(3)).collect()
    pick = lambda rs: Counter((r["doc_id"], r["source"], r["size"], r["source_size"],
                               r["target"], r["taken"]) for r in rs)
    assert pick(got) == pick(again) and len(got) == len(rows)
    assert {"doc_id", "lang", "source", "n_chars", "row"} < set(got[0].asDict())
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len((row[1] or "").split())
    target = shares_by_hand(sizes, 1.5, (5, 2, 1), 2)
    taken = Counter()
    for row in got:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(target[row["source"]])
        epochs = int(row["target"] // row["source_size"]) if row["source_size"] else 0
        assert epochs * row["size"] <= row["taken"] <= min(2, epochs + 1) * row["size"]
        taken[row["source"]] += row["taken"]
    for source in sizes:
        assert target[source] - 1 <= taken[source] <= target[source] + 1e-6
    # At most one document of a source is cut.
    cut = Counter(r["source"] for r in got if r["size"] and r["taken"] % r["size"])
    assert all(n <= 1 for n in cut.values())


def test_mix_prefers_quality(spark):
    rows = [(i, "word " * 10, "en", "a", 0, 9.0 if i % 2 else 1.0) for i in range(2000)]
    rows += [(i, "word " * 10, "en", "b", 0, 1.0) for i in range(2000, 9000)]
    df = spark.createDataFrame(rows, DOCS + ", worth double")
    few = mixing.mix(df, share=0.1, weights=(1,), quality="worth").where("source = 'a'")
    good = few.where("worth = 9").agg(F.sum("taken")).first()[0]
    poor = few.where("worth = 1").agg(F.sum("taken")).first()[0]
    assert good + poor == 4500 and good > 2 * poor


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)]
