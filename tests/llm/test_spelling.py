"""Spelling variants against comparing every two words."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.llm import queries, spelling
from tests.llm import helpers as H


def plain_words(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    close = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and near(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return out


def as_rows(df):
    got = df.collect()
    rows = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(rows) == len(got)
    return rows


def edited(rng, w, letters):
    kind, at = rng.randrange(3), rng.randrange(len(w))
    return w[:at] + w[at + 1:] if kind == 0 else w[:at] + rng.choice(letters) + w[at + (kind == 1):]


def test_words_of_awkward_texts():
    rng = random.Random(0)
    letters = "abcdefgXYZéÀ×÷ß ,1Ā中_"
    for i in range(300):
        text = "".join(rng.choice(letters) for _ in range(200)) + " repeated repeated repeatedd Repeated"
        assert {w.decode("latin-1"): n for w, n in spelling.words_of(text, str(i)).items() if n >= 2} == plain_words([(i, text)])
    assert spelling.words_of("", "1") == {}


@pytest.mark.parametrize("regions,tile", [(8, 4096), (2, 3), (1, 2)])
def test_variants_equal_comparing_all_pairs(spark, regions, tile):
    rng = random.Random(regions)
    letters = "abé"
    words = {}
    for size in (7, 8, 9, 14, 17, 40, 90):
        for _ in range(12):
            base = w = "".join(rng.choice(letters) for _ in range(size))
            words[base] = rng.choice([2, 30, 500, 9000])
            for _ in range(12):
                w = edited(rng, rng.choice([w, base]), letters)
                if len(w) >= 7:
                    words[w] = rng.choice([2, 3, 20, 300, 4000])
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert as_rows(spelling.group_variants(df, regions=regions, tile_words=tile)) == plain_variants(words)


def test_a_chain_of_forms_ends_in_one_root(spark):
    words = {"a" * k: 10 ** (k - 6) for k in range(7, 16)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = as_rows(spelling.group_variants(df))
    assert got == plain_variants(words) and {r[2] for r in got} == {"a" * 15}


def test_a_tile_that_goes_over_several_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(3)
    words = {"commonword" + a + b: rng.randrange(2, 500) for a in "abcdefghij" for b in "abcdefghij"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert as_rows(spelling.group_variants(df)) == plain_variants(words)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_variants_of_texts(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(base).capitalize() for _ in range(60)) + "_" + rng.choice(base), "en", "s", 1) for i in range(150)]
    rows += [(None, " ".join(base), None, None, None), (3, rows[3][1], None, None, None), (900, None, None, None, None),
             (901, "", None, None, None), (902, "z" * 30_000 + " " + "z" * 30_000 + " " + "z" * 30_001, None, None, None)]
    docs = H.frame(spark, rows).withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    words = plain_words([r[:2] for r in rows])
    got = as_rows(spelling.variants(docs))
    assert got == plain_variants(words) and any(r[1] for r in got) and "z" * 30_000 in words
    assert spelling.variants(H.frame(spark, [])).collect() == []


def test_the_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    words = plain_words([(r.doc_id, r.text) for r in docs])
    assert as_rows(queries.QUERIES["op12_spelling_variants"](spark, sf_small)) == plain_variants(words)
