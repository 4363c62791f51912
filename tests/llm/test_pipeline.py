"""The stages of the pipeline one after the other, against brute force on a small corpus."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotwise.llm import mixing, queries
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    stems = {"en": ["ba", "be", "do", "ka"], "de": ["ti", "tu", "shi", "no"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(n))

    rows = [(i, text(lang, rng.randrange(30, 90)), lang, f"src{i % 4}", 1)
            for i in range(80) for lang in [rng.choice(["en", "de"])]]
    items = [(1, text("en", 40)), (2, text("de", 25))]
    rows += [(80, rows[3][1], "en", "src1", 1), (81, rows[4][1] + " bado", rows[4][2], "src1", 1), (82, None, "en", "src0", 1),
             (83, "12345 !!", "en", "src0", 1), (84, "", None, None, None),
             (85, f"{text('en', 20)} {items[0][1]} {text('en', 10)}", "en", None, 1), (86, items[1][1], "de", "other", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, H.DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_pipeline_equals_brute_force(spark, folder):
    path, rows = folder
    stay = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    kept = []
    for r in stay:
        if not any(H.jaccard(H.shingles(r[1]), H.shingles(k[1])) >= 0.8 for k in kept):
            kept.append(r)
    kept = [r for r in kept if r[0] not in (85, 86)]
    assert len(kept) == 80
    docs = spark.createDataFrame(kept, H.DOCS)
    mixed = [r.doc_id for r in mixing.mix(docs, queries.MIX_SHARES, queries.MIX_BLOCK).orderBy(
        "mix_slot", "mix_offset").collect()]
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts, want, start = {r[0]: r[1] for r in kept}, [], 0
    for d in mixed:
        ids = np.array(tokenizer.encode(texts[d], add_special_tokens=False).ids + [0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_language_stage_drops_other_languages_and_junk(spark, folder):
    path, rows = folder
    rng = random.Random(15)
    stems = ["lö", "äm", "gra", "ust", "vry"]
    bad = ["".join(rng.choice(stems) for _ in range(4)) + " " for _ in range(60)]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40)]
    # without labels, so nothing learns from them; a chance word of a learned language makes their score 1
    more = [(200, "".join(bad), None, "src0", 1), (201, "".join(bad) + "bado", None, "src0", 1),
            (202, " ".join(junk), None, "src0", 1), (203, " ".join(junk) + " bado", None, "src0", 1),
            (204, "мир труд май " * 9, None, "src0", 1), (205, rows[0][1] + " 12 ... " + bad[0], None, "src0", 1)]
    docs = spark.createDataFrame(rows + more, H.DOCS)
    got = [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, path).collect()]
    clean = [r[0] for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert sorted(got) == sorted([*clean, 205])


def test_stages_keep_the_columns(spark, folder):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("lang_pred", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:4]:
        assert stage(spark, docs, path).columns == docs.columns, name


def test_native_queries_have_no_python_and_no_cross_join(spark, folder):
    path, _ = folder
    for name in ("op1_simhash_decontamination", "op4_chunk_recipe_dedup", "op5_line_neighbourhood_dedup", "op6_pfair_mix"):
        plan = queries.QUERIES[name](spark, path)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct")), name
