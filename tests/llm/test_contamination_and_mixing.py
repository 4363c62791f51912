"""Benchmark decontamination and source mixing."""
import collections
import random

from pyspark.sql import functions as F

from plotwise.llm import decontaminate, mixing
from tests.llm import helpers as H


def brute_matches(rows, items):
    want = {}
    for r in rows:
        w = H.words(r[1])
        for item, text in items:
            iw = H.words(text)
            k = min(5, len(iw))
            if not k or not w:
                continue
            hs = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
            ih = collections.Counter(tuple(iw[i:i + k]) for i in range(len(iw) - k + 1))
            m = min(sum(ih.values()), len(hs))
            best = None
            for s in range(len(hs) - m + 1 if m else 0):
                j = H.jaccard(collections.Counter(hs[s:s + m]), ih)
                if j >= 0.8 and (best is None or j > best[1]):
                    best = s, j
            if best:
                want[r[0], item] = best[0], round(best[1], 9)
    return want


def test_matches_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, H.sentence(rng, rng.randrange(14, 60), 5000)) for i in range(12)]
    items += [(20, "three short words"), (21, None), (22, ""), (23, "..."), (24, items[0][1]), (25, "same " * 30)]
    rows = []
    for i in range(60):
        w = H.sentence(rng, rng.randrange(0, 80), 5000).split()
        leak = rng.choice(items[:12])[1].split()
        kind = i % 5
        if kind == 1:
            leak[rng.randrange(len(leak))] = "changed"
        elif kind == 2:
            leak.insert(len(leak) // 2, "more")
        elif kind == 3:
            leak = leak[: len(leak) // 2]
        at = rng.randrange(len(w) + 1)
        rows.append((i, " ".join(w[:at] + (leak if kind != 4 else []) + w[at:]), "en", "s", 1))
    rows += [(70, None, None, None, None), (71, "", None, None, None), (72, "has Three  short words, too", None, None, None),
             (73, "same " * 100, None, None, None), (74, items[3][1], None, None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("h", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.first_word, round(r.similarity, 9))
           for r in decontaminate.matches(H.frame(spark, rows), bench).collect()}
    want = brute_matches(rows, items)
    assert got == want and len(want) > 15
    left = decontaminate.decontaminated(H.frame(spark, rows), bench)
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert "item_id" in left.columns
    nothing = bench.limit(0)
    assert decontaminate.matches(H.frame(spark, rows), nothing).count() == 0
    assert decontaminate.matches(H.frame(spark, []), bench).count() == 0
    assert decontaminate.decontaminated(H.frame(spark, rows), nothing).count() == len(rows)


def test_truncated_items_equal_brute_force(spark):
    rng = random.Random(14)
    items, rows = [], []
    for i in range(120):
        n = rng.choice([9, 10, 15, 19, 30])
        items.append((i, H.sentence(rng, n, 5000)))
        w = items[-1][1].split()
        for cut in (1, 2, 3):
            rows.append((len(rows), " ".join(w[:-cut]), "en", "s", 1))
            rows.append((len(rows), " ".join(w[cut:]), "en", "s", 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, round(r.similarity, 9))
           for r in decontaminate.matches(H.frame(spark, rows), bench).collect()}
    want = brute_matches(rows, items)
    assert got == want and len(want) > 300


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = random.Random(0)
    for _ in range(200):
        f = rng.getrandbits(63)
        g = f
        for b in rng.sample(range(63), decontaminate.RADIUS):
            g ^= 1 << b
        mask = (1 << decontaminate.BLOCK_BITS) - 1
        assert any((f >> (b * decontaminate.BLOCK_BITS)) & mask == (g >> (b * decontaminate.BLOCK_BITS)) & mask
                   for b in range(decontaminate.BLOCKS))


def test_pattern_deviates_by_less_than_a_block():
    for shares in ({"a": 1}, {"a": 3, "b": 1}, {"a": 20, **{f"s{i}": 4 for i in range(19)}, "other": 4},
                   {"a": 7, "b": 11, "c": 13, "d": 1}):
        total, done = sum(shares.values()), collections.Counter()
        slots = mixing.pattern(shares)
        assert [s[2] for s in slots] == list(range(total))
        for s, j, slot in slots:
            assert j == done[s]
            done[s] += 1
            assert all(abs(done[x] - (slot + 1) * n / total) < 1 for x, n in shares.items())
        assert done == shares


def test_mix_keeps_all_rows_and_numbers_blocks_in_order(spark):
    rows = [(i, None if i % 7 == 0 else f"t{i}", "en", [None, "a", "a", "a", "b", "rare"][i % 6], 1) for i in range(600)]
    rows += [(5, "again", "en", "a", 1), (None, "x", None, None, None)]
    shares = {"a": 5, "b": 2}
    small = mixing.mix(H.frame(spark, rows), shares, block=4, bucket_rows=20).cache()
    assert small.count() == len(rows) and "key" in small.columns
    got = sorted((r.mix_source, r.mix_block, r.mix_offset, r.doc_id or -1, r.mix_slot) for r in small.collect())
    one = sorted((r.mix_source, r.mix_block, r.mix_offset, r.doc_id or -1, r.mix_slot)
                 for r in mixing.mix(H.frame(spark, rows), shares, block=4).collect())
    assert got == one
    sources = collections.Counter(r[0] for r in got)
    for s, n in sources.items():
        assert [(r[1], r[2]) for r in got if r[0] == s] == [(i // 4, i % 4) for i in range(n)]
    slots = sorted({(r[4], r[0]) for r in got})
    assert len({x for x, _ in slots}) == len(slots)
    # until a source has run out
    end = min(max(r[4] for r in got if r[0] == s) for s in ("a", "b"))
    done = collections.Counter()
    for slot, s in slots:
        if slot > end:
            break
        done[s] += 1
        assert abs(done["a"] - (slot + 1) * 5 / 8) < 1 and abs(done["b"] - (slot + 1) * 2 / 8) < 1
    assert mixing.mix(H.frame(spark, []), shares).count() == 0
    ordered = mixing.mixed_order(H.frame(spark, rows).drop("mix_slot"), shares, block=4)
    assert ordered.count() == len(rows) and ordered.columns == H.frame(spark, rows).drop("mix_slot").columns
