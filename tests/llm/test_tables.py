"""Operators over whole tables: SimHash, mixing, URLs, lattice, top-k, and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import __spark_entry__ as contract
import corpus_pipeline
from landprice.llm import components, lattice, mixing, simhash, stages, topk, urls
from landprice.llm.queries import ORACLE_SQL, QUERIES, tokenizer
from landprice.session import materialised
from tests.llm.conftest import ODD_TEXTS, documents
from tests.test_catalog import bag

PIECES = tokenizer("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = QUERIES[name](spark, sf_dir)
    expected = connection.execute(ORACLE_SQL[name])
    columns = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(columns)
    assert bag(result.columns, result.collect()) == bag(columns, expected.fetchall())


def test_every_operator_is_registered():
    names = [x for x in contract.queries() if x.startswith("op")]
    assert sorted(int(x[2:].split("_")[0]) for x in names) == list(range(1, 14))
    assert contract.queries()["pipeline"] is corpus_pipeline.run


# SimHash


def classes(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", lower)]
    if not words:
        return 0
    count = max(1, len(words) - 2)
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(count)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > count)


def check_components(rows, texts):
    prints = [fingerprint(t) for _, t in texts]
    near = [(i, j) for i in range(len(prints)) for j in range(i)
            if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = classes(near, len(prints))
    smallest = {}
    for (i, _), root in zip(texts, roots):
        if i is not None:
            smallest[root] = min(i, smallest.get(root, i))
    expected = Counter(
        (i, f"{p:016x}", smallest.get(root)) for (i, _), p, root in zip(texts, prints, roots)
    )
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == expected


def test_simhash_of_odd_rows(odd, none):
    check_components(simhash.near_duplicates(odd).collect(), ODD_TEXTS)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_of_given_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_components(QUERIES["op3_simhash"](spark, sf_dir).collect(), [tuple(r) for r in docs])


def test_bit_sliced_links_are_all_links():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 120))
        run = np.sort(rng.integers(0, max(1, n // int(rng.integers(1, 12))), n))
        values = rng.integers(0, 1 << 63, 3).astype(np.uint64)[rng.integers(0, 3, n)]
        for _ in range(int(rng.integers(0, 4))):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        pairs = [(i, j) for i in range(n) for j in range(i)
                 if run[i] == run[j] and int(values[i] ^ values[j]).bit_count() <= 2]
        assert classes(pairs, n) == list(simhash.linked_roots(values, run))


@pytest.mark.parametrize("most", [4, 1024])
def test_large_buckets_are_split_without_losing_links(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", most)
    rng = random.Random(8)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.fp: r.root for r in simhash.class_roots(materialised(table, "t")).collect()}
    pairs = [(i, j) for i in range(len(values)) for j in range(i)
             if ((values[i] ^ values[j]) & ((1 << 64) - 1)).bit_count() <= 2]
    assert [roots[v] for v in values] == [values[i] for i in classes(pairs, len(values))]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    rng = random.Random(9)
    rng.shuffle(pairs)
    links = spark.createDataFrame([(b, a) for a, b in pairs], "a long, b long")
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


# lattice


def test_lattice_sums_all_spellings():
    model = lattice.vocabulary(PIECES)
    numbers = model._numbers

    def total(word, at=0):
        if at == len(word):
            return 1.0
        return sum(
            math.exp(model.weights[numbers[word[at:end]]]) * total(word, end)
            for end in range(at + 1, len(word) + 1) if word[at:end] in numbers
        )

    words = [b"the", b"x", b"onthe", "é漢".encode(), b"\xff", b"the"]
    got = model.forward(words)
    for word, value in zip(words, got):
        assert value == pytest.approx(math.log(total(b" " + word)))
    assert np.exp(model.weights).sum() == pytest.approx(1)
    long = [b"ab" * 31, b"ab" * 32, b"ab" * 40]  # both ways to sum meet
    assert np.diff(model.forward(long)).max() < 0
    for part in (words, long):
        times = np.arange(1.0, len(part) + 1)
        uses = model.expected(part, times)
        spelled = sum(uses[i] * len(x) for i, x in enumerate(model.pieces))
        assert spelled == pytest.approx(sum(n * (len(w) + 1) for n, w in zip(times, part)))


def small_model():
    pieces = [b" ", b" a", b"a", b"ab", b"b"]
    return lattice.Lattice(pieces, np.log([0.2, 0.25, 0.15, 0.1, 0.2, 0.1]))


def test_words_and_texts_are_distributions():
    """Over all words of two letters the sums approach one; so they do over texts."""
    model = small_model()
    words = [bytes(x) for size in range(9) for x in itertools.product(b"ab", repeat=size)]
    found = np.exp(model.forward(words) + model.boundary - model.opening)
    assert 0.9 < found.sum() < 1  # the rest lies in longer words
    begun = math.exp(model.opening - model.boundary)
    assert sum(begun**n for n in range(200)) * math.exp(model.weights[-1] - model.boundary) == pytest.approx(1)


def test_score_is_the_marginal_over_all_spellings(spark):
    """Of whole texts, by recursion over every way to cut them into pieces."""
    texts = [(1, "the cat the end"), (3, "a  Cat\tsat"), (4, "unseen zebra"), (5, None), (6, "the cat")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df = df.withColumn("held_out", F.col("doc_id").isin(4, 6))
    counts = lattice.count_words(df.withColumn("learn", ~F.col("held_out")))
    model = lattice.estimate(counts, lattice.vocabulary(PIECES))
    weight = dict(zip(model.pieces, np.exp(model.weights[:-1])))

    def total(text):
        sums = [1.0] + [0.0] * len(text)
        for end in range(1, len(text) + 1):
            sums[end] = sum(sums[start] * weight.get(text[start:end], 0.0) for start in range(end))
        return sums[-1]

    opening = sum(x for piece, x in weight.items() if piece.startswith(b" "))
    end = math.exp(model.weights[-1])
    assert sum(weight.values()) + end == pytest.approx(1)
    found = {r.doc_id: r for r in lattice.score_texts(df, PIECES).collect()}
    for key, text in texts:
        spelled = b"".join(b" " + w for w in (text or "").encode().lower().split())
        expected = math.log10(total(spelled) * end / (opening + end))
        assert found[key].score == pytest.approx(expected)
        assert found[key].mixture_score < 0


def test_a_doubled_corpus_leaves_the_scores(spark, sf_dir):
    """The vocabulary's own scores weigh the same at every size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(200)
    docs = docs.withColumn("held_out", F.col("doc_id") % 5 == 1)
    once = {r.doc_id: r.score for r in lattice.score_texts(docs, PIECES).collect()}
    for r in lattice.score_texts(docs.union(docs), PIECES).collect():
        assert r.score == pytest.approx(once[r.doc_id])


@pytest.mark.parametrize("common", [3, 1 << 16])
def test_scores_are_those_of_counts_and_lattice(spark, odd, monkeypatch, common):
    monkeypatch.setattr(lattice, "COMMON_WORDS", common)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    rows = lattice.score_texts(odd.withColumn("held_out", held), PIECES).collect()
    assert len(rows) == len(ODD_TEXTS)
    counts = Counter()
    for i, t in ODD_TEXTS:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*(t or "").encode().lower().split(), b" "])
    n, v = counts.total(), len(counts)
    expected = Counter()
    for i, t in ODD_TEXTS:
        words = [*(t or "").encode().lower().split(), b" "]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        expected[i, len(words), sum(counts[w] > 0 for w in words), round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == expected
    assert {r.train_tokens for r in rows} == {n}
    assert all(x < 0 and math.isfinite(x) for r in rows for x in (r.score, r.mixture_score))


def test_scores_do_not_depend_on_the_number_of_common_words(spark, sf_dir, monkeypatch):
    whole = {r.doc_id: r for r in QUERIES["op8_lattice"](spark, sf_dir).collect()}
    monkeypatch.setattr(lattice, "COMMON_WORDS", 50)
    for r in QUERIES["op8_lattice"](spark, sf_dir).collect():
        assert r.n_known == whole[r.doc_id].n_known
        assert r.score == pytest.approx(whole[r.doc_id].score)
        assert r.mixture_score == pytest.approx(whole[r.doc_id].mixture_score)
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score)


def test_lattice_of_empty_tables(none):
    assert lattice.score_texts(none.withColumn("held_out", F.lit(True)), PIECES).count() == 0


def test_lattice_without_training_texts(odd):
    rows = lattice.score_texts(odd.withColumn("held_out", F.lit(True)), PIECES).collect()
    assert len(rows) == len(ODD_TEXTS) and all(math.isfinite(r.score) for r in rows)
    assert {(r.n_known, r.train_tokens) for r in rows} == {(0, 0)}


# top-k


def test_topk_of_odd_vectors(spark):
    rng = random.Random(10)
    vectors = [(i, [rng.uniform(-2, 2) for _ in range(20)]) for i in range(1, 130)]
    vectors += [(200 + i, [1.0] * 20) for i in range(40)] + [(150, [1.0] * 20), (300, [])]
    bad = [(50, None), (400, [None] * 20), (401, [float("nan")] * 20), (450, [float("inf")] * 20), (None, [1.0])]
    rows = spark.createDataFrame(
        vectors + bad + vectors[:5], "vec_id long, embedding array<float>"
    ).withColumn("id", F.lit("x"))
    found = topk.nearest(rows, F.col("vec_id") % 50 == 0, "vec_id", "embedding").collect()
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors}
    expected = set()
    for q in whole:
        if q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q]
            expected |= {(q, n, c, -s) for n, (s, c) in enumerate(sorted(scores)[:5], 1)}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_topk_with_few_and_large_vectors(spark):
    rows = spark.createDataFrame([(0, [1e9, 3.0]), (50, [2e3, 1.0]), (51, [0.0, 1.0])], "vec_id long, e array<double>")
    found = {(r.query_id, r.rank): (r.vec_id, r.score)
             for r in topk.nearest(rows, F.col("vec_id") % 50 == 0, "vec_id", "e").collect()}
    assert found[0, 1] == (50, int(256e9) * 512000 + 768 * 256) and len(found) == 4
    assert topk.nearest(rows.limit(0), F.lit(True), "vec_id", "e").count() == 0


# URLs


def test_rules_and_odd_urls(spark):
    given = {
        "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://net/": ("net", "/", "net/", "block"),
        "https://x.net": ("x.net", "", None, None),
        "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
        "http://badexample.com/de/1": ("badexample.com", "/de/1", None, None),
        "a://b.org/fr/?://z.net/": ("b.org", "/fr/", "org/fr/", "allow"),
        "no separator": ("", "", None, None),
        "x://": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://é.org/FR/#": ("é.org", "/FR/", None, None),
        "http://long.org/" + "ab" * 3000: ("long.org", "/" + "ab" * 3000, None, None),
    }
    rows = spark.createDataFrame([(n, u) for n, u in enumerate(given)] * 2 + [(None, "http://q.net/")],
                                 "page_id long, url string").withColumn("gram", F.lit("x"))
    found = urls.judge(rows).collect()
    assert len(found) == 2 * len(given) + 1
    for r in found:
        if r.page_id is not None:
            host, path, rule, verdict = list(given.values())[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict in ((verdict,) if verdict else ("allow", "block"))
    assert urls.judge(rows.limit(0)).count() == 0
    untaught = urls.judge(rows.filter("page_id = 6")).collect()
    assert {r.verdict for r in untaught} == {"allow"}


def test_url_models_learn(spark):
    good = [(i, f"http://site{i}.example.net/en/article-{i}") for i in range(40)]
    bad = [(100 + i, f"http://pills{i}.net/buy-cheap-pills-{i}") for i in range(40)]
    ask = [(1000, "http://other.com/article-77"), (1001, "http://other.com/buy-cheap-pills")]
    rows = urls.judge(spark.createDataFrame(good + bad + ask, "page_id long, url string"))
    assert {r.page_id: r.verdict for r in rows.filter("page_id >= 1000").collect()} == {
        1000: "allow", 1001: "block"}


# mixing


def test_raking_meets_its_targets(spark):
    rng = random.Random(11)
    rows = [(f"s{a}", f"l{b}", f"t{c}", rng.randrange(500, 2000))
            for a in range(4) for b in range(3) for c in range(3)]
    table = materialised(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), "t")
    targets = mixing.flattened_targets(table)
    out = mixing.fitted(table, targets, 0.3, 12).withColumn("kept", F.expr("tokens * probability"))
    total = out.agg(F.sum("kept")).first()[0]
    assert total == pytest.approx(0.3 * sum(r[3] for r in rows))
    for name in mixing.DIMENSIONS:
        got = {r[name]: r["n"] / total for r in out.groupBy(name).agg(F.sum("kept").alias("n")).collect()}
        assert got == pytest.approx({r[name]: r["target"] for r in targets[name].collect()}, rel=1e-3)


def _filled(holds, wanted, budget):
    """Water-filling by bisection over the common multiple."""
    low, high = 0.0, 1e9
    for _ in range(200):
        at = (low + high) / 2
        if sum(min(holds[x], at * wanted[x]) for x in wanted) < budget:
            low = at
        else:
            high = at
    return {x: min(holds[x], high * wanted[x]) for x in wanted}


def test_groups_that_hold_too_little_give_all_and_the_rest_is_spread(spark):
    rows = [("big", "en", "prose", 90_000), ("big", "de", "prose", 6_000), ("big", "en", "table", 500),
            ("rare", "en", "prose", 200), ("rare", "fr", "table", 100), ("mid", "de", "prose", 3_000),
            ("mid", "fr", "legal", 200), ("mid", "en", "prose", 0)]
    table = materialised(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), "t")
    targets = mixing.flattened_targets(table)
    total = sum(r[3] for r in rows)
    chances = materialised(mixing.fitted(table, targets, 0.5), "c")
    kept = chances.agg(F.sum(F.expr("tokens * probability"))).first()[0]
    assert kept == pytest.approx(0.5 * total, rel=1e-3)
    report = mixing.margin_report(table, chances, targets, 0.5).collect()
    short = 0
    for i, name in enumerate(mixing.DIMENSIONS):
        holds = Counter()
        for r in rows:
            holds[r[i]] += r[3] / (0.5 * total)
        wanted = {r["group"]: r.wanted for r in report if r.dimension == name}
        could = {r["group"]: r.reachable for r in report if r.dimension == name}
        assert could == pytest.approx(_filled(holds, wanted, 1.0), rel=1e-9)
        assert sum(could.values()) == pytest.approx(1)
        short += sum(could[x] < 0.99 * wanted[x] for x in wanted)
        expected = {r["group"]: r.expected for r in report if r.dimension == name}
        assert sum(expected.values()) == pytest.approx(1, rel=1e-3)
    assert short >= 3


def test_mixing_of_odd_rows(odd, none):
    report = mixing.sample_report(odd)
    rows = report.collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r.probability <= 1 for r in rows)
    kept = mixing.sample(odd)
    assert kept.columns == odd.columns
    assert kept.count() == report.filter("kept").count()
    assert mixing.sample(none).count() == 0 == mixing.sample_report(none).count()


# pipeline


def test_pipeline_stages_of_odd_rows(spark, odd, none):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialised(stage(spark, docs, ""), name)
        if name != "tokens":
            assert docs.columns == odd.columns and docs.dtypes == odd.dtypes
        assert materialised(stage(spark, none, ""), name).count() == 0
        if name == "language":
            assert {r.doc_id for r in docs.collect()} == {5, 6, 7, 8, 9, 11, 12, None}
            assert docs.filter("lang is null").count() == 0
        if name == "near_dedup":
            left = Counter(r.text for r in docs.collect())
            assert max(left.values()) == 1 and set(left) == {r.text for r in before.collect()}
        if name == "personal_data":
            assert docs.count() == before.count()
            assert docs.filter("text like '%a.b@site.org%'").count() == 0


def test_pipeline_on_given_data(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < len(rows) < docs.count()
    assert len({r.doc_id for r in rows}) == len(rows)


def test_dedup_keeps_one_of_each_class(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)["near_dedup"] is stages.one_of_each_group
    kept = sorted(r.doc_id for r in stages.one_of_each_group(spark, docs, sf_dir).select("doc_id").collect())
    groups = QUERIES["op3_simhash"](spark, sf_dir).select("component_id").distinct().collect()
    assert kept == sorted(r.component_id for r in groups)


def test_repeated_rows_leave_one(spark):
    rows = documents(spark, [(1, "same text of a document here")] * 3 + [(1, "quite other words in this one")])
    kept = simhash.one_of_each(rows).collect()
    assert len(kept) == 2 and len({r.text for r in kept}) == 2
