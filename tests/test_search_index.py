"""Stored indexes against dense matrices."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plotwise.operators import search_index as I
from plotwise.operators import similarity as R
from plotwise.session import shared_path

DOCS = "doc_id long, text string"


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[:10] if rng.random() < 0.5 else words) for _ in range(rng.choice([1, 3, 8, 40, 90]))))
            for i in range(n)]
    rows += [(n + i, rows[i % 5][1]) for i in range(20)]  # copies: ties by id
    return rows + [(500, ""), (501, None), (502, "the and of"), (503, "unheard solitary words")]


def dense(rows, stops):
    """Cosines of the smoothed 1-2-gram tf-idf, as a matrix over the sorted ids."""
    ids = sorted({i for i, _ in rows})
    counts = {i: Counter() for i in ids}
    for i, t in rows:
        toks = [w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in stops]
        counts[i].update(toks + [" ".join(p) for p in zip(toks, toks[1:])])
    df = Counter(t for c in counts.values() for t in c)
    at = {t: k for k, t in enumerate(sorted(df))}
    m = np.zeros((len(ids), len(at)))
    for r, i in enumerate(ids):
        for t, n in counts[i].items():
            m[r, at[t]] = n * (math.log((1 + len(rows)) / (1 + df[t])) + 1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(norm > 0, norm, 1)
    return ids, m @ m.T


def best(ids, scores, q, n, skip_self):
    order = sorted((i for i in ids if not (skip_self and i == q)), key=lambda i: (-round(scores[i], 10), i))
    return [(k + 1, i, round(scores[i], 6)) for k, i in enumerate(order[:n])]


@pytest.fixture(scope="module")
def built(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    index = I.build_index(df, "doc_id", "text", shared_path(spark, "test-index"), buckets=8)
    ids, matrix = dense(rows, set(R.default_stop_words()))
    return rows, I.SearchIndex(spark, index.path), ids, matrix


def test_all_neighbours_equal_the_dense_matrix(spark, built, monkeypatch):
    rows, index, ids, matrix = built
    asked = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for n, seeds, plain in ((6, 1000, 0), (3, 4, 0), (6, 1000, 10 ** 9)):
        monkeypatch.setattr(I, "PLAIN_ROWS", plain)
        got = {}
        for r in index.top(asked, n, seed_rows=seeds).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 6)))
        assert {q: sorted(v) for q, v in got.items()} == {
            q: best(ids, dict(zip(ids, matrix[k])), q, n, False) for k, q in enumerate(ids)}
    without = {}
    for r in index.recommend(asked, 4, exclude_self=True, digits=6).collect():
        without.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert {q: sorted(v) for q, v in without.items()} == {
        q: best(ids, dict(zip(ids, matrix[k])), q, 4, True) for k, q in enumerate(ids)}


@pytest.mark.parametrize("plain", [0, 10 ** 9])
def test_single_requests(spark, built, monkeypatch, plain):
    monkeypatch.setattr(I, "PLAIN_ROWS", plain)
    rows, index, ids, matrix = built
    scores = {(r.query_id, r.id): r.score for r in index.scores([3, 7]).collect()}
    for (q, i), s in scores.items():
        assert s == pytest.approx(matrix[ids.index(q), ids.index(i)], abs=1e-9)
    assert len(scores) == int((matrix[[ids.index(3), ids.index(7)]] > 0).sum())
    assert index.scores([10 ** 9]).count() == 0 and index.top([10 ** 9], 3).count() == 0
    # a known row without terms: everything has score 0, in the order of the ids
    assert [(r["rank"], r.id, r.score) for r in index.top([500], 3).orderBy("rank").collect()] == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]
    assert [r.id for r in index.recommend([503], 2).orderBy("rank").collect()] == [0, 1]


def test_weights_and_terms(spark, built):
    rows, index, ids, _ = built
    df = spark.createDataFrame(rows, DOCS)
    old = {(r.doc_id, r.term): round(r.weight, 9) for r in R.tfidf(df, "doc_id", "text").collect()}
    assert {(r.id, r.term): round(r.weight, 9) for r in index.weights().collect()} == old
    terms = {r.term: (r.df, max(c.max_w for c in r.classes)) for r in index.terms.collect()}
    assert {t: n for t, (n, _) in terms.items()} == Counter(t for _, t in old)
    assert index.n_docs == len(rows)


def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, "red house"), (1, "red garden"), (2, "green garden"), (None, "red")]
    index = I.build_index(spark.createDataFrame(rows, DOCS), "doc_id", "text", shared_path(spark, "test-index"))
    old = {(r.doc_id, r.term): round(r.weight, 9) for r in R.tfidf(spark.createDataFrame(rows, DOCS), "doc_id", "text").collect()}
    assert {(r.id, r.term): round(r.weight, 9) for r in index.weights().collect()} == {k: v for k, v in old.items() if k[0]}
    empty = I.build_index(spark.createDataFrame([], DOCS), "doc_id", "text", shared_path(spark, "test-index"))
    assert empty.top([1], 3).collect() == [] and empty.weights().collect() == []


def test_frequent_terms_dealt_to_several_tasks_count_whole(spark, monkeypatch):
    monkeypatch.setattr(I, "FREQUENT", 3)
    rows = corpus(1, 30)
    index = I.build_index(spark.createDataFrame(rows, DOCS), "doc_id", "text", shared_path(spark, "test-index"), buckets=2)
    old = {(r.doc_id, r.term): round(r.weight, 9) for r in R.tfidf(spark.createDataFrame(rows, DOCS), "doc_id", "text").collect()}
    assert {(r.id, r.term): round(r.weight, 9) for r in index.weights().collect()} == old
    assert {r.term: r.df for r in index.terms.collect()} == Counter(t for _, t in old)
    # texts are stored as counts: the weights are in the postings alone
    assert index.forward.schema["terms"].dataType.elementType.names == ["term", "tf"]


def test_counting_terms_shuffles_nothing(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    assert "Exchange" not in I.counted_terms(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()


def test_standardised_index_equals_the_rebuilt_cosine(spark):
    rng = random.Random(2)
    rows = [(i, f"k{k}", float(rng.randrange(100, 9000))) for i in range(40) for k in rng.sample(range(9), 4)]
    long = spark.createDataFrame(rows, "id long, key string, value double")
    entities = spark.createDataFrame([(i,) for i in range(42)], "id long")
    index = I.build_standardised(long, entities, "id", "key", "value", 5000.0, shared_path(spark, "test-index"), buckets=4)
    got = {(r.query_id, r.id): r.score for r in I.StandardisedIndex(spark, index.path).scores([3, 41]).collect()}
    for q in (3, 41):
        for r in R.standardised_cosine(long, entities, "id", "key", "value", 5000.0, q).collect():
            assert got[q, r.id] == pytest.approx(r.score, abs=1e-9)
    assert len(got) == 84 and index.scores([77]).count() == 0


def test_deltas_are_stored_once_and_repeats_and_null_ids_count_as_before(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(I, "cut_lineage", lambda df, cut=I.cut_lineage: cuts.append(df.columns) or cut(df))
    rows = [(i, f"k{i % 4}", float(100 * i + 7)) for i in range(20)]
    rows += rows[3:6] + [(None, "k1", 60.0), (4, "k0", None), (99, "k2", 70.0)]
    long = spark.createDataFrame(rows, "id long, key string, value double")
    entities = spark.createDataFrame([(i,) for i in [*range(21), 5]] + [(None,)], "id long")
    index = I.build_standardised(long, entities, "id", "key", "value", 500.0, shared_path(spark, "test-index"), buckets=3)
    # an entry's delta is in the tables by entity and by key, and in no third one
    assert not [c for c in cuts if "d" in c]
    assert "z0" in spark.read.parquet(f"{index.path}/by_id").columns
    for q in (3, 20):
        got = sorted((r.id is None, r.id or 0, round(r.score, 9)) for r in index.scores([q]).collect())
        want = R.standardised_cosine(long, entities, "id", "key", "value", 500.0, q).collect()
        assert got == sorted((r.id is None, r.id or 0, round(r.score, 9)) for r in want)


def test_location_texts_are_built_and_parsed_once(spark, sf_small):
    """The filter of unparsable distances reads stored metres: above the grouping it would build each text again."""
    from plotwise.plans.q_similar import part_location_long
    plan = part_location_long(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter isnotnull(meters" in plan and "Contains" not in plan


def test_norms_in_parts_give_the_same_index_and_shuffle_no_postings(spark, monkeypatch):
    """With more norms than one broadcast takes, postings were joined to them by a shuffle of all their texts."""
    monkeypatch.setattr(I, "NORM_ROWS", 40)
    monkeypatch.setattr(I, "COMBINED_ROWS", 100)
    rows = corpus(3, 100) + [(7, "red house w1"), (None, "w1 w2")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    index = I.build_index(df, "doc_id", "text", shared_path(spark, "test-index"), buckets=4)
    old = {(r.doc_id, r.term): round(r.weight, 9) for r in R.tfidf(df, "doc_id", "text").collect() if r.doc_id is not None}
    got = [(r.id, r.term, round(r.weight, 9)) for r in index.weights().collect()]
    assert len(got) == len(old) and {(i, t): w for i, t, w in got} == old
    most = {}
    for (_, t), w in old.items():
        most[t] = max(w, most.get(t, 0.0))
    assert {r.term: (r.df, round(max(c.max_w for c in r.classes), 9)) for r in index.terms.collect()} == {
        t: (n, most[t]) for t, n in Counter(t for _, t in old).items()}
    plan = index.weights()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") >= 3


def test_a_build_leaves_no_shuffle_files_behind(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = held()
    I.build_index(spark.createDataFrame(corpus(4, 60), DOCS).repartition(3), "doc_id", "text", shared_path(spark, "test-index"), buckets=2)
    assert not {f for f in held() - before if f.endswith(".data")}
