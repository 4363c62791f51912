"""Operator 8: language identification with bit-sliced Bloom filters of n-grams.

One filter serves all languages. Its slots are words of bits, one bit per
language; an n-gram sets its language's bit in the slots of its hashes. The
bitwise "and" of an n-gram's slots is the set of all languages that contain
it. A text's score for a language is the count of its n-grams whose set holds
the language, less the count that false positives alone would give:
``(hits - n * f) / (1 - f)``, where f is the language's own false-positive
rate, read from how full its bit slice is.

N-grams are runs of ``N`` letters over lower-cased text in which everything
but letters is one space. Learning counts n-grams per language over all
learning documents, in map tasks and then by a shuffle on (n-gram, language);
an n-gram belongs to a language if it makes up a large enough share of that
language's n-grams, and is not much rarer there than in another language (so
that a few foreign lines don't count). The filter's size follows from the
n-grams that it holds, up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import cut_lineage, ship, small_batches, worker_cache

N = 4
#: The least and most slots of the filter (powers of two), slots for each n-gram it holds, and hashes of an n-gram:
#: with four slots and two hashes at most some 0.4 of the slots are taken.
SLOTS, MAX_SLOTS, SLOTS_A_GRAM, HASHES = 1 << 21, 1 << 26, 4, 2
#: An n-gram belongs to a language from this share of the language's n-grams on, and from two occurrences on.
MIN_SHARE = 2e-7
#: Nor does it if its share is below this part of its share in the language that has most of it.
MIN_RATIO = 0.1
#: The filter keeps at most one word of bits per slot.
MAX_LANGUAGES = 64
#: Distinct n-grams that a learning task holds before it passes them on.
HELD = 1 << 20
UNKNOWN = "und"


def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter; its lower case (or itself)."""
    cache = worker_cache()
    if "letters" not in cache:
        size = 0x30000
        points = [chr(i) for i in range(size)]
        is_letter = np.fromiter((c.isalpha() for c in points), bool, size)
        low = np.arange(size, dtype=np.uint32)
        for i, c in enumerate(points):
            x = c.lower()
            if len(x) == 1:
                low[i] = ord(x)
        cache["letters"] = is_letter, low
    return cache["letters"]


def grams(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and the index of each one's text.

    A text is framed by two spaces and one, so that a word of one letter has an n-gram too.
    """
    is_letter, low = letters()
    joined = "".join(f"\x00\x00{t or ''}\x00" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t or "") + 3 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    safe = np.minimum(cp, len(low) - 1)
    letter = is_letter[safe] & (cp < len(low))
    c = np.where(letter, low[safe], np.uint32(32))
    # one space for each run of other characters after a letter, and the frame
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = np.cumsum(sizes) - sizes
    keep[first] = keep[first + 1] = True
    c, doc, letter = c[keep], doc[keep], letter[keep]
    if len(c) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    h = np.zeros(len(c) - n + 1, np.uint64)
    seen = np.zeros(len(h), bool)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + c[i:len(h) + i].astype(np.uint64)
        seen |= letter[i:len(h) + i]
    inside = (doc[n - 1:] == doc[:len(h)]) & seen
    h = h[inside]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, doc[:len(inside)][inside]


def slots(h: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    """The filter's slots of each n-gram."""
    out = []
    for i in range(hashes):
        out.append((h & np.uint64(size - 1)).astype(np.int64))
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(31))
    return out


@dataclass
class Model:
    """The filter, its languages, each one's false-positive rate and the share of its n-grams it holds."""
    languages: list[str]
    filter: np.ndarray
    false_positive: np.ndarray
    coverage: np.ndarray
    hashes: int = HASHES
    n: int = N

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams per text, corrected n-grams per text and language)."""
        h, doc = grams(texts, self.n)
        found = None
        for at in slots(h, len(self.filter), self.hashes):
            found = self.filter[at] if found is None else found & self.filter[at]
        total = np.bincount(doc, minlength=len(texts)).astype(float)
        hits = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            has = (found >> np.uint64(i)) & np.uint64(1)
            hits[:, i] = np.bincount(doc, weights=has.astype(float), minlength=len(texts))
        f = self.false_positive
        return total, np.maximum(0, (hits - total[:, None] * f) / (1 - f))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage.

        The score is the winner's share of the corrected counts of all languages; the coverage is its share of the
        text's n-grams, over the share expected of a text in that language (1 or about for such a text).
        """
        total, hits = self.counts(texts)
        best = hits.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        is_letter, _ = letters()
        known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        every = hits.sum(axis=1)
        top = hits.max(axis=1, initial=0)
        score = np.where(every > 0, top / np.where(every > 0, every, 1), 0.0)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        expected = np.maximum(total, 1) * self.coverage[best]
        covered = np.where(expected > 0, top / np.where(expected > 0, expected, 1), 0.0)
        return names, np.where(known, score, 0.0), np.where(known, covered, 0.0)


def _count(n: int):
    """(lang, text) batches to (lang, gram, count), combined within the task as far as memory allows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang):
            keys, counts = held.pop(lang)
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys)),
                                               "gram": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs = np.array(part.column(0).to_pylist(), object)
                texts = part.column(1).to_pylist()
                for lang in dict.fromkeys(langs):
                    h, _ = grams([texts[i] for i in np.flatnonzero(langs == lang)], n)
                    keys, counts = np.unique(h, return_counts=True)
                    if lang in held:
                        old = held[lang]
                        both, back = np.unique(np.concatenate([old[0], keys]), return_inverse=True)
                        counts = np.bincount(back, weights=np.concatenate([old[1], counts])).astype(np.int64)
                        keys = both
                    held[lang] = keys, counts.astype(np.int64)
                    if len(keys) > HELD:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    return run


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = N, size: int | None = None,
          hashes: int = HASHES, min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> Model:
    """Learn from every row of ``docs`` that has a text and a language.

    The filter has ``size`` slots or, by default, as many as its n-grams need;
    more than ``MAX_SLOTS`` (half a gigabyte) are an error, to be met by a
    larger ``min_share``, which bounds the n-grams of a language by its inverse
    whatever the corpus. The driver receives the slots and a total per
    language. More than 64 languages are an error. Without learning rows the
    model knows no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")) \
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = cut_lineage(rows.mapInArrow(_count(n), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the filter holds {MAX_LANGUAGES}")
    table, held = np.zeros(size or SLOTS, np.uint64), {}
    if languages:
        least = F.create_map(*(F.lit(x) for k in languages for x in (k, max(2.0, totals[k] * min_share))))
        bit = F.create_map(*(F.lit(x) for i, k in enumerate(languages) for x in (k, 1 << i if i < 63 else -(1 << 63))))
        size_of = F.create_map(*(F.lit(x) for k in languages for x in (k, float(totals[k]))))
        share = F.col("n") / size_of[F.col("lang")]
        most = counts.groupBy("gram").agg(F.max(share).alias("most"))
        kept = cut_lineage(counts.join(most, "gram").filter(
            (F.col("n") >= least[F.col("lang")]) & (share >= F.col("most") * min_ratio)).select(
            "lang", "gram", "n", (F.col("n") - 1 >= least[F.col("lang")]).alias("again")))
        # of a text that was not learned from: an n-gram counts if the filter would hold it without that occurrence
        held = {r.lang: r.n for r in kept.filter("again").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        kept = kept.select("gram", bit[F.col("lang")].cast("bigint").alias("bit"))
        if size is None:
            size = max(SLOTS, 1 << (SLOTS_A_GRAM * kept.count() - 1).bit_length())
            if size > MAX_SLOTS:
                raise ValueError(f"the n-grams need {size} slots, more than {MAX_SLOTS}: take a larger min_share")
            table = np.zeros(size, np.uint64)

        def place(batches):
            for b in batches:
                h = np.asarray(b.column(0)).view(np.uint64)
                for at in slots(h, size, hashes):
                    yield pa.RecordBatch.from_pydict({"slot": pa.array(at), "bit": b.column(1)})

        found = kept.mapInArrow(place, "slot bigint, bit bigint").groupBy("slot").agg(F.bit_or("bit").alias("bits")) \
            .toPandas()
        table[found["slot"].to_numpy()] = found["bits"].to_numpy(np.int64).view(np.uint64)
    full = np.array([((table >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(languages))])
    coverage = np.array([held.get(k, 0) / max(1, totals[k]) for k in languages])
    return Model(languages, table, full ** hashes, coverage, hashes, n)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_coverage``, by the text alone.

    The score compares the learned languages with each other; the coverage
    (0, to 1 or about for a text in the language) tells whether it is one of
    them. A null text or one without letters is ``und`` with score and coverage
    0. Ties go to the language that sorts first. Columns of these three names
    are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_coverage")
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    # plain arrays: a class would be looked up by its name on executors, which need no copy of this library
    shared = spark.sparkContext.broadcast(dict(vars(model)))  # at most 8 * MAX_SLOTS bytes

    @F.pandas_udf("lang string, score double, coverage double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(**shared.value)
        for texts in batches:
            texts = texts.tolist()
            names, scores, coverages = [], [], []
            for at in range(0, len(texts), 512):
                a, b, c = m.predict([t if isinstance(t, str) else None for t in texts[at:at + 512]])
                names += a
                scores.append(b)
                coverages.append(c)
            none = [np.empty(0)]
            yield pd.DataFrame({"lang": names, "score": np.concatenate(scores or none),
                                "coverage": np.concatenate(coverages or none)})

    out = docs.withColumn("__guess", guess(F.col(text_col).cast("string")))
    return out.select(*docs.columns, F.col("__guess.lang").alias("lang_pred"), F.col("__guess.score").alias("lang_score"),
                      F.col("__guess.coverage").alias("lang_coverage"))


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


ship(__name__)
