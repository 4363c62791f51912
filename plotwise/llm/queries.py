"""The registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.llm import (decontaminate, exact_dedup, html_extract, langid, line_dedup, minhash, mixing, packing, spelling,
                          suffix_dedup, token_output, warc, whitening)
from plotwise.llm.common import table

#: The public tokenizer of the token-id output.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op4_chunk_recipe_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""")
def op4(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


#: The target mix: a fifth from the largest source, equal shares of the others, the rest pooled.
MIX_SHARES = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}, mixing.REST: 4}
MIX_BLOCK = 16


@query("op6_pfair_mix", mixing.mix_sql(MIX_SHARES, MIX_BLOCK))
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_SHARES, MIX_BLOCK).select(
        "doc_id", "source", "mix_source", "mix_block", "mix_slot", "mix_offset")


@query("op2_warc_seekable", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id, count(*) AS n FROM d
      WHERE payload_bytes >= {warc.MIN_REVISIT_BYTES} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.n > 1 AND d.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.n > 1 AND d.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND f.first_id IS NOT NULL""")
def op2(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(TOKENIZER))


@query("op7_token_shards")
def op7(spark, sf_dir):
    return token_output.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_bloom_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op3_dart_minhash")
def op3(spark, sf_dir):
    return minhash.near_classes(table(spark, sf_dir, "documents"))


@query("op10_sparse_suffix_repeats")
def op10(spark, sf_dir):
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


@query("op1_simhash_decontamination")
def op1(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_line_neighbourhood_dedup")
def op5(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


@query("op9_template_extraction")
def op9(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op11_best_fit_packing")
def op11(spark, sf_dir):
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))[0]


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
