"""The corpus pipeline: from raw documents to token shards in mixed order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of their ``docs``.

1. Language identification drops documents in no known language.
2. Near-duplicate detection keeps one document of each class.
3. Benchmark decontamination drops documents that hold a benchmark item.
4. Mixing puts the rows, and so the files, in the order of the target mix.
5. Token output writes the documents' ids in that order and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.llm import decontaminate, langid, minhash, mixing, queries, token_output
from plotwise.llm.common import shared_folder, table

#: A text is in a known language if the best one has at least this share of the n-grams found in any (with few
#: languages, any text of known n-grams has it) ...
MIN_LANGUAGE_SCORE = 0.2
#: ... and at least this part of the n-grams that the learning documents lead to expect of a text in it (a text of
#: two learned languages has half; the least of the documents has 0.53 at sf0.1, 0.64 at sf0.01).
MIN_LANGUAGE_COVERAGE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; the labels of the documents teach them."""
    model = langid.learn(docs.filter(~langid.held_out()))
    found = langid.predict(docs, model)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE) & (
        F.col("lang_coverage") >= MIN_LANGUAGE_COVERAGE)
    return found.filter(known).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id."""
    return minhash.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the sources interleaved to their target weights."""
    return mixing.mixed_order(docs, queries.MIX_SHARES, block=queries.MIX_BLOCK)


def file_order():
    """The place of a row in its table's files: part number, file of the part, row of the file."""
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"part-(\d+)", 1)
    piece = F.regexp_extract(name, r"-c(\d+)\.", 1)
    number = [F.when(x != "", x).otherwise("0").cast("bigint") for x in (part, piece)]
    return F.shiftleft(number[0], 42) + F.shiftleft(number[1], 32) + F.col("_metadata.row_index")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from shards in the order of ``docs``."""
    return token_output.round_trip(docs, queries.tokenizer_path(), order=file_order())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("mix_sources", mix_sources),
    ("token_output", write_tokens),
]

#: Language models and MinHash classes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
