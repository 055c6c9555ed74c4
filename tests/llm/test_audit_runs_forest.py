"""Filter audit, periodic runs and the projection forest against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from landprice.llm import filter_audit, forest, runs
from landprice.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS, documents

WORDS = re.compile("[^\x20\x09-\x0d]+")


# Periodic runs


def brute_runs(words):
    """Every run, from the definition."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(
                all(words[t] == words[t + d] for t in range(i, i + length - d)) for d in range(1, q)
            )
            if length >= max(6, 4 * q) and not smaller:
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def brute_row(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            letters = rng.choice([1, 2, 3, 5])
            words = [bytes([97 + rng.randrange(letters)]) for _ in range(rng.randint(0, 80))]
            if words and rng.random() < 0.5:
                a = rng.randrange(len(words))
                p = min(rng.randint(1, 6), len(words) - a)
                words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
            texts.append(words)
        assert runs.runs_of_texts(texts) == [brute_runs(words) for words in texts]


def test_nested_and_overlapping_runs():
    words = (b"a a a a a a b " * 5 + b"c d c d c d c d").split()
    assert runs.runs_of_texts([words]) == [brute_runs(words)]
    assert (0, 35, 7) in brute_runs(words) and (35, 8, 2) in brute_runs(words)


def test_runs_of_odd_rows(spark, odd, none):
    found = [tuple(r) for r in runs.run_digests(odd).collect()]
    short = [(i, t) for i, t in ODD_TEXTS if len(t or "") < 1000]
    assert len(found) == len(ODD_TEXTS) == len(short) + 1
    assert Counter(r for r in found if r[0] != 7) == Counter(brute_row(i, t) for i, t in short)
    assert [r[1:6] for r in found if r[0] == 7] == [(1, 0, 12_000, 3, 4_000_000)]
    assert runs.run_digests(none).count() == 0 == runs.find_runs(none).count()


def test_runs_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.length("text") < 1500)
    found = {r.doc_id: tuple(r) for r in runs.run_digests(docs).collect()}
    expected = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs.collect()}
    assert found == expected and any(row[1] for row in found.values())
    whole = QUERIES["op11_runs"](spark, sf_dir)
    assert whole.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_a_long_text_of_one_word_and_a_long_period(spark):
    text = "x " * 200_000
    period = " ".join(f"w{i}" for i in range(5_000)) + " "
    rows = spark.createDataFrame([(1, text), (2, period * 5)], "doc_id long, text string")
    found = {r.doc_id: r for r in runs.find_runs(rows).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 200_000, 1)] and found[1].collapsed == "x"
    assert [tuple(x) for x in found[2].runs] == [(0, 25_000, 5_000)]
    assert found[2].collapsed == period.strip()


# Filter audit


def brute_audit(docs, labels):
    """Applies the filters one after another to lists of documents."""
    first, good, toxic = {}, set(), set()
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, quality, is_toxic in labels:
        if doc_id is not None:
            good |= {doc_id} if quality == 1 else set()
            toxic |= {doc_id} if is_toxic == 1 else set()
    parts = defaultdict(list)
    for doc_id, text, source in docs:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text],
        }
        parts[source or ""].append((fails, doc_id in good, doc_id in toxic))
    rows = {}
    for part, members in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left, gone = members, []
            for step, own in enumerate(order, 1):
                out = [x for x in left if x[0][own]]
                redundant = sum(x[0][own] for x in gone)
                left, gone = [x for x in left if not x[0][own]], gone + out
                alone = sum(x[0][own] and sum(x[0].values()) == 1 for x in members)
                shapley[own] += len(out)
                rows[part, "".join(order), step] = [
                    len(left), len(out), redundant, alone, sum(x[1] for x in out), sum(x[2] for x in out), own,
                ]
        for key, row in rows.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {(*key, *row) for key, row in rows.items()}


def audited(docs, labels):
    found = filter_audit.audit(docs, labels)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) == 600 * len({r[0] for r in rows})
    return set(rows)


def test_audit_of_odd_rows(spark):
    text = "Some # Text " * 80
    extra = [
        (20, text, "s9"), (21, text, None), (21, text, "s9"), (20, text, "s8"), (None, text, "s9"),
        (30, " ".join(f"w{i}" for i in range(300)), ""), (31, "a b " * 200, ""), (32, "É" * 50 + "A", "s9"),
        (None, None, "s9"), (33, None, "s9"), (34, "", "s8"),
    ]
    base = documents(spark)
    docs = base.unionByName(
        spark.createDataFrame(extra, "doc_id long, text string, source string"), True
    ).withColumns({"part": F.lit("x"), "digest": F.lit(1), "bits": F.lit(2), "good": F.lit(3)})
    labels = [(20, 1, 0), (20, None, 1), (21, 0, None), (31, 1, 1), (None, 1, 1), (99, 1, 1), (33, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(5))
    given = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert audited(docs, table) == brute_audit(given, labels)
    assert filter_audit.audit(docs.limit(0), table).count() == 0
    unlabelled = audited(docs, table.limit(0))
    assert unlabelled == brute_audit(given, [])


def test_audit_of_one_text_in_most_rows(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 > 0, "The same text").otherwise(F.concat(F.lit("own "), "id")).alias("text"),
        F.lit("one").alias("source"),
    )
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    step = filter_audit.audit(docs, labels).filter("filter_order = 'EABCD' and step = 1").first()
    assert (step.kept, step.removed, step.good_lost) == (1001, 1999, 999)


# Projection forest


def recall(found, ids, vectors, asking, k=20):
    by_query = defaultdict(list)
    for r in found:
        by_query[r.query_id].append((r.rank, r.vec_id, r.score))
    share = []
    for q in asking:
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
        rows = sorted(by_query[ids[q]])
        assert [r[0] for r in rows] == list(range(1, len(order) + 1))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        names = {r[1] for r in rows}
        assert len(names) == len(rows) and ids[q] not in names
        share.append(len(names & {ids[i] for i in order}) / max(1, len(order)))
    return float(np.mean(share))


def plain_sum(left, right):
    total = 0.0
    for a, b in zip(left, right):
        total += a * b
    return total


def test_forest_finds_most_neighbours_of_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in table])
    vectors = np.array([r.embedding for r in table], float)
    found = QUERIES["op12_forest"](spark, sf_dir).collect()
    assert recall(found, ids, vectors, np.flatnonzero(ids % 20 == 0)) >= 0.9


@pytest.mark.parametrize("clusters", [0, 30])
def test_forest_with_deep_trees_and_small_shards(spark, monkeypatch, clusters):
    monkeypatch.setattr(forest, "LEAF_ROWS", 64)
    monkeypatch.setattr(forest, "SHARD_ROWS", 40)  # leaves are larger and cut into blocks
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(4000, 24))
    if clusters:
        vectors = 0.3 * vectors + 3 * rng.normal(size=(clusters, 24))[rng.integers(clusters, size=4000)]
    ids = np.arange(4000)
    rows = spark.createDataFrame(list(zip(ids.tolist(), vectors.tolist())), "vec_id long, e array<double>")
    found = forest.nearest(rows, F.col("vec_id") % 20 == 0, "vec_id", "e").collect()
    assert recall(found, ids, vectors, np.flatnonzero(ids % 20 == 0)) >= 0.9


def test_forest_reads_fewer_leaves_of_clustered_vectors():
    rng = np.random.default_rng(5)
    centres = 3 * rng.normal(size=(200, 24))
    vectors = 0.2 * rng.normal(size=(20_000, 24)) + centres[rng.integers(200, size=20_000)]
    trees = forest.fit(vectors[:16_000], 200_000)
    wanted = forest.wanted_leaves(trees, vectors[:40], 20, forest.TARGET)
    assert np.mean([len(x) for x in wanted]) < 0.25 * forest.TREES * trees.leaves


def test_forest_of_odd_vectors(spark):
    rng = random.Random(10)
    vectors = [(i, [rng.uniform(-2, 2) for _ in range(9)]) for i in range(1, 130)]
    same = [(200 + i, [1.0] * 9) for i in range(90)] + [(160, [1.0] * 9), (500, [1.0] * 9)]
    few = [(600, [3.0]), (601, [3.0, 0.0])]
    bad = [
        (60, None), (400, [None] * 9), (401, [float("nan")] * 9), (420, [float("inf")] * 9),
        (None, [1.0] * 9), (440, []), (460, [0.0, -0.0]),
    ]
    rows = spark.createDataFrame(
        vectors + same + few + bad + vectors[:5] + same[:3], "vec_id long, embedding array<float>"
    ).withColumns({"id": F.lit("x"), "ids": F.lit("y"), "shard": F.lit(1), "asks": F.lit(0)})
    found = forest.nearest(rows, F.col("vec_id") % 20 == 0, "vec_id", "embedding").collect()
    whole = {i: [float(np.float32(x)) for x in v] + [0.0] * (9 - len(v)) for i, v in vectors + same + few}
    expected = set()
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-plain_sum(whole[q], whole[c]), c) for c in whole if c != q)
            expected |= {(q, n, c, -s) for n, (s, c) in enumerate(scored[:20], 1)}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert forest.nearest(rows.limit(0), F.lit(True), "vec_id", "embedding").count() == 0
    two = forest.nearest(rows.filter("vec_id in (20, 21)"), F.lit(True), "vec_id", "embedding")
    assert sorted((r.query_id, r.vec_id) for r in two.collect()) == [(20, 21), (21, 20)]
