"""Best-fit-decreasing packing against placing piece after piece."""
import random
import zlib

import numpy as np
import pytest

from plotwise.llm import packing, queries
from tests.llm import helpers as H


def one_by_one(lengths, capacity):
    """The room left in each sequence after best fit decreasing, one piece at a time."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= length]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= length
        else:
            bins.append(capacity - length)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_the_plan_equals_placing_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 30, 100])
    few = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 6))]
    lengths = [rng.choice(few) if seed % 2 else rng.randint(1, capacity) for _ in range(rng.randrange(400))]
    counts = {k: lengths.count(k) for k in set(lengths)}
    fills, opened = packing.plan(counts, capacity)
    assert fills == sorted(fills, key=lambda f: (-f.length, f.rank))
    used = {}
    for f, after in zip(fills, [*fills[1:], None]):
        end = after.rank if after and after.length == f.length else counts[f.length]
        for k in range(end - f.rank):
            used.setdefault(f.first + k // f.each, []).append((f.offset + k % f.each * f.length, f.length))
    assert sorted(used) == list(range(opened))
    rooms = []
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        rooms.append(capacity - at)
    assert sorted(rooms) == sorted(one_by_one(lengths, capacity))


def test_a_plan_does_not_grow_with_the_rows():
    rng = random.Random(4)
    counts = {k: rng.randrange(1, 1000) for k in range(1, 1025)}
    few, _ = packing.plan(counts)
    many, opened = packing.plan({k: n * 10 ** 9 for k, n in counts.items()})
    assert len(few) < 20_000 and len(many) < 20_000
    assert opened >= sum(k * n * 10 ** 9 for k, n in counts.items()) / 1024


def test_packed_documents_hold_all_ids(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = H.corpus()
    docs = H.frame(spark, rows).repartition(6)
    packed = packing.pack(docs, queries.tokenizer_path(), capacity=64).cache()
    got = packed.collect()
    texts = {}
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        texts.setdefault(r[0], []).append(ids)
    pieces = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 64
        pieces.setdefault((r.doc_id), []).append((r.piece, r.start, ids))
    for doc, found in pieces.items():
        whole = sorted(t for t in texts[doc])
        if len(whole) > 1:  # rows that repeat an id: the pieces together
            assert sorted(i for _, _, ids in found for i in ids) == sorted(i for t in whole for i in t)
            continue
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [i for _, _, ids in found for i in ids] == whole[0]
        assert all(len(ids) == 64 for _, _, ids in found[1:])
        assert [s for _, s, _ in found] == [sum(len(x[2]) for x in found[:k]) for k in range(len(found))]
    assert pieces.keys() == texts.keys()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]
        assert sum(n for _, n in p) <= 64
    assert len(places) == len(one_by_one([r.length for r in got], 64))
    whole = packing.sequences(packed).collect()
    assert sorted(r.sequence_id for r in whole) == sorted(places)
    assert all(len(r.ids) == 4 * r.n_tokens and r.n_pieces == len(places[r.sequence_id]) == len(r.doc_ids) for r in whole)
    packed.unpersist()


def test_the_query_reports_the_ids_of_each_piece(spark, sf_small):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = queries.QUERIES["op11_best_fit_packing"](spark, sf_small).collect()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        n = -(-len(ids) // 1024)
        cuts = [max(0, len(ids) - 1024 * (n - i)) for i in range(n)] + [len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert len({r.sequence_id for r in got}) == len(one_by_one([r.length for r in got], 1024))


def test_empty_tables(spark):
    packed = packing.pack(H.frame(spark, []), queries.tokenizer_path())
    assert packed.count() == 0 and packing.sequences(packed).count() == 0
    null = packing.pack(H.frame(spark, [(None, None, None, None, None), (1, "", None, None, None)]), queries.tokenizer_path())
    assert sorted(((r.doc_id, r.length, r.sequence_id, r.offset) for r in null.collect()), key=repr) in (
        [(1, 1, 0, 0), (None, 1, 0, 1)], [(1, 1, 0, 1), (None, 1, 0, 0)])
