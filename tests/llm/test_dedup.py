"""Exact, near, line and passage deduplication against brute force."""
import collections
import hashlib

from pyspark.sql import functions as F

from plotwise.llm import exact_dedup, graph, line_dedup, minhash, suffix_dedup
from tests.llm import helpers as H


def test_exact_dedup_equals_brute_force_even_with_clashing_chunk_hashes(spark):
    rows = H.corpus()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = sorted(((r[0], max((i for i in groups[r[1] or ""] if i is not None), default=None), len(groups[r[1] or ""]),
                    hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=repr)
    for h in (F.xxhash64, lambda c: F.length(c).cast("bigint") % 2):
        got = exact_dedup.exact_dedup(H.frame(spark, rows), pattern=r"(?s).{20,80}?[ .\n]|.{1,80}", chunk_hash=h)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=repr) == want
    kept = exact_dedup.deduplicated(H.frame(spark, rows))
    assert {r.text or "" for r in kept.collect()} == {r[1] or "" for r in rows}
    assert "keep_id" in kept.columns


def test_chunks_join_to_the_text_and_follow_content(spark):
    text = "".join(f"Sentence {i} has some words, and ends. " for i in range(400))
    df = spark.createDataFrame([(1, text), (2, "x" + text), (3, ""), (4, "y" * 10_000)], "doc_id int, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()}
    assert "".join(got[1]) == text and "".join(got[4]) == "y" * 10_000 and got[3] == []
    assert len(set(got[1]) & set(got[2])) > len(got[1]) / 2


def test_near_classes_equal_brute_force(spark):
    rows = H.corpus()
    sets = [H.shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and H.jaccard(a, sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    want = sorted(((r[0], min((x for x in members[find(i)] if x is not None), default=None), len(members[find(i)]))
                   for i, r in enumerate(rows)), key=repr)
    got = minhash.near_classes(H.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=repr) == want
    kept = {r.doc_id for r in got if r.kept}
    left = minhash.deduplicated(H.frame(spark, rows))
    assert {r.doc_id for r in left.collect()} == kept and "band" in left.columns


def test_dart_signatures_estimate_weighted_jaccard():
    import numpy as np
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    words = np.concatenate([a, a[:240], rng.integers(0, 2 ** 63, 60).astype(np.uint64), a[:3]])
    doc = np.repeat([0, 1, 2], [300, 300, 3])
    sig = minhash.dart_signatures(words, doc, 4)
    assert np.isfinite(sig[:3]).all() and np.isinf(sig[3]).all()
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.12
    assert (sig[0] == sig[2]).mean() < 0.08


def test_large_buckets_are_split_without_losing_links(spark):
    import random
    rng = random.Random(5)
    base = H.sentence(rng, 120, 9000).split()
    rows = []
    for i in range(80):
        v = list(base)
        v[rng.randrange(len(v))] = f"e{i}"
        rows.append((i, " ".join(v), "en", "s", 1))
    docs = H.frame(spark, rows, extra=False)
    signed = docs.select("doc_id", minhash.word_hashes(F.col("text")).alias("words")).mapInArrow(
        minhash._sign(5), "doc_id bigint, node bigint, bands array<bigint>, sketch binary").cache()
    found = minhash.buckets(signed, size=10).groupBy("key").count()
    assert found.agg(F.max("count")).first()[0] <= 40
    old, minhash.BUCKET = minhash.BUCKET, 10
    try:
        got = minhash.near_classes(docs).collect()
    finally:
        minhash.BUCKET = old
    assert {r.class_id for r in got} == {0}


def test_true_pairs_in_a_template_group_larger_than_a_bucket(spark, monkeypatch):
    import random
    monkeypatch.setattr(minhash, "BUCKET", 6)
    rng = random.Random(7)
    shared = H.sentence(rng, 100, 9000)
    # 96 shared shingles and 15 own: 0.76 to each other, but two by two 0.8 and more
    rows = []
    for i in range(40):
        own = [f"o{i}x{k}" for k in range(15)]
        twin = own[:11] + [f"t{i}x{k}" for k in range(4)]
        rows += [(2 * i, f"{shared} {' '.join(own)}", "en", "s", 1), (2 * i + 1, f"{shared} {' '.join(twin)}", "en", "s", 1)]
    sets = [H.shingles(r[1]) for r in rows]
    assert H.jaccard(sets[0], sets[1]) >= 0.8 > H.jaccard(sets[0], sets[2])
    got = {r.doc_id: (r.class_id, r.class_size) for r in minhash.near_classes(H.frame(spark, rows, extra=False)).collect()}
    assert got == {r[0]: (r[0] // 2 * 2, 2) for r in rows}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)] + [(200, x) for x in range(201, 240)]
    got = collections.defaultdict(set)
    for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect():
        got[r.component].add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(1, 41)), [100, 101], list(range(200, 240))]


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return max(len(a), len(b)) - p - s <= 1


def test_line_dedup_equals_brute_force(spark):
    import random
    rng = random.Random(2)
    base = [H.sentence(rng, n, 3000) for n in (9, 10, 11, 14, 30, 30, 12)]
    rows = []
    for i in range(30):
        out = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split()
            kind = rng.randrange(5)
            at = rng.randrange(len(w))
            if kind == 0:
                w[at] = f"x{rng.randrange(3)}"
            elif kind == 1:
                del w[at]
            elif kind == 2:
                w.insert(at, f"y{rng.randrange(3)}")
            elif kind == 3:
                w[at], w[0] = "z", "q"
            out.append(" ".join(w) if rng.random() < 0.9 else "")
        rows.append((i, "\n".join(out), "en", "s", 1))
    rows += [(50, None, None, None, None), (51, "", None, None, None), (52, rows[0][1], None, None, None)]
    first = {}
    for r in rows:
        for n, line in enumerate((r[1] or "").split("\n")):
            if w := tuple(H.words(line)):
                first.setdefault(w, (r[0], n))
    stay = collections.defaultdict(list)
    for w, at in first.items():
        if not any(p < at and min(len(w), len(v)) >= line_dedup.MIN_WORDS and edit_one(v, w) for v, p in first.items()):
            stay[at[0]].append(at[1])
    want = {r[0]: (sum(bool(H.words(x)) for x in (r[1] or "").split("\n")), sorted(stay[r[0]])) for r in rows}
    got = {r.doc_id: (r.n_lines, r.kept_lines) for r in line_dedup.line_dedup(H.frame(spark, rows)).collect()}
    assert got == want
    texts = {r.doc_id: r.text for r in line_dedup.deduplicated(H.frame(spark, rows)).collect()}
    assert texts[50] is None and texts[52].strip() == ""
    assert all(len([x for x in (t or "").split("\n") if H.words(x)]) == len(want[i][1]) for i, t in texts.items())


def test_repeated_spans_equal_brute_force(spark):
    import random
    rng = random.Random(3)
    shared = [H.sentence(rng, n, 9000) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(40):
        parts = [H.sentence(rng, rng.randrange(0, 60), 9000)]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), H.sentence(rng, rng.randrange(0, 30), 9000)]
        rows.append((i, " ".join(parts), "en", "s", 1))
    rows += [(60, None, None, None, None), (61, "", None, None, None), (62, rows[0][1], None, None, None),
             (63, "same " * 120, None, None, None), (64, H.sentence(rng, 20_000, 90_000), None, None, None)]
    count = collections.Counter()
    for r in rows:
        w = H.words(r[1])
        count.update(tuple(w[a:a + 50]) for a in range(len(w) - 49))
    want = set()
    for r in rows:
        w, spans = H.words(r[1]), []
        for a in range(len(w) - 49):
            if count[tuple(w[a:a + 50])] > 1:
                if spans and a <= spans[-1][1] + 1:
                    spans[-1][1] = a + 49
                else:
                    spans.append([a, a + 49])
        want |= {(r[0], a, b) for a, b in spans}
    got = suffix_dedup.repeated_spans(H.frame(spark, rows))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_empty_tables(spark):
    docs = H.frame(spark, [])
    for f in (exact_dedup.exact_dedup, exact_dedup.deduplicated, minhash.near_classes, minhash.deduplicated,
              line_dedup.line_dedup, line_dedup.deduplicated, suffix_dedup.repeated_spans):
        assert f(docs).count() == 0


def test_components_of_chains_stars_and_cycles(spark, monkeypatch):
    import random

    from plotwise.llm import graph
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    links += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)] + [(5, 5), (0, 1), (1, 0), (-7, 2 ** 62)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[find(a)] = find(b)
    want = {}
    for x in list(root):
        want.setdefault(find(x), set()).add(x)
    df = spark.createDataFrame(links, "a long, b long").repartition(9)
    for few, batch in ((500_000, 200_000), (0, 7)):  # shuffle joins, and tasks that contract a few links at a time
        monkeypatch.setattr(graph, "BROADCAST_ROWS", few)
        monkeypatch.setattr(graph, "BATCH_LINKS", batch)
        got = {}
        for r in graph.components(df).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}
        assert all(k in v for k, v in got.items())
    assert graph.components(df.limit(0)).collect() == []
