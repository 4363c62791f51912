"""Operator 7: token ids in binary shards with a shared zstandard dictionary.

Every text is encoded by a public tokenizer and closed by an end id. The ids
of one document, as little-endian integers, are compressed alone, with a
dictionary trained on the ids of a bounded sample of documents, so that short
documents compress well and any document is read by itself. A shard holds a
range of documents in ascending order::

    "PWTS" | version u32 | id width u32 | dictionary SHA-256 (32 bytes)
    one zstd frame per document
    index: one entry per document (has_id u8, doc_id i64, offset u64, packed u32, n_tokens u32)
    documents u64 | tokens u64 | index offset u64 | "PWTS"

Texts never move: they are encoded and compressed where they are read, and
only the frames are shuffled to their shard.

The tokenizer is byte-level BPE, which encodes each pre-token (a word with
its leading space, a number, a run of marks, white space) by itself. So a
batch is cut into pre-tokens by array arithmetic, only distinct pre-tokens go
to the tokenizers library, and their ids are gathered back. Texts with
characters outside the scripts whose classes are certain go to the library
whole.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotwise.llm.common import cut_lineage, shared_folder, ship, small_batches, worker_cache
from plotwise.llm.warc import open_folder, put_file

END_ID = 0
#: The dictionary is trained on this many documents, the first 2000 ids of each.
DICT_DOCS, DICT_IDS, DICT_BYTES = 2000, 2000, 64 << 10
#: A shard holds about this many bytes of text.
SHARD_BYTES = 32 << 20
MAGIC = b"PWTS"
HEAD, FOOT = "<4sII32s", "<QQQ4s"
ENTRY = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("packed", "<u4"), ("n_tokens", "<u4")])
#: A shard that grows beyond this many bytes, as with one id on very many rows, goes on in another file.
FILE_BYTES = 64 << 20
#: Code points whose letter, digit and space classes are the same in every Unicode version in use.
SAFE_BELOW = 0x0250
#: Pre-tokens that a worker remembers.
CACHE_ENTRIES = 1 << 19

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(1 << 19, 1 << int(n).bit_length())
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        have = cache["powers"] = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, m)])) for m in (MULTIPLIER, inverse))
    return have


def _classes() -> np.ndarray:
    """The class of each code point below ``SAFE_BELOW``."""
    cache = worker_cache()
    if "classes" not in cache:
        import regex
        out = np.full(SAFE_BELOW + 1, OTHER, np.uint8)
        for i in range(SAFE_BELOW):
            for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
                if regex.match(pattern, chr(i)):
                    out[i] = kind
        cache["classes"] = out
    return cache["classes"]


def pre_token_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the texts begin that lie joined in ``cp``; documents begin at ``doc_starts``.

    Equal to matching the tokenizer's pattern: a contraction, or a run of
    letters, digits or marks with one space before it, or white space (of which
    the last character is left to the token that follows).
    """
    n = len(cp)
    kind = _classes()[np.minimum(cp, SAFE_BELOW)]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last_of_doc = first[1:]
    # the last white space before other text stands alone or joins what follows
    before_text = space & ~last_of_doc
    before_text[:-1] &= ~space[1:]
    before_text[-1:] = False
    start |= before_text
    joins = before_text & (cp == 32)
    glued = np.flatnonzero(joins) + 1
    start[glued] = False
    # contractions: an apostrophe alone, not after a space, before letters
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    for q in quote.tolist():
        a = chr(cp[q + 1])
        b = chr(cp[q + 2]) if q + 2 < n and not first[q + 2] else ""
        size = 1 if a in "stmd" else 2 if a + b in ("re", "ve", "ll") else 0
        if size:
            start[q + 1] = False
            if q + 1 + size < n:
                start[q + 1 + size] = True
    return np.flatnonzero(start)


class _Vocabulary:
    """Ids of pre-tokens by their hash: sorted keys, and the ids of all in one array."""

    def __init__(self, source: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_text(source))
        vocab = self.tokenizer.get_vocab()
        # byte-level vocabularies write the space as G with a dot
        self.opens_word = np.zeros(max(vocab.values()) + 1, np.int64)
        self.opens_word[[i for t, i in vocab.items() if t.startswith("\u0120")]] = 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Add the pre-tokens ``texts``, given in the order of their sorted ``keys``."""
        if len(self.keys) + len(keys) > CACHE_ENTRIES:
            self.clear()
        # words with their leading space stay apart when joined: one call for all of them, the rest one by one
        words = [i for i, t in enumerate(texts) if t[0] == " " and t[-1].isalpha()]
        rest = [i for i, t in enumerate(texts) if not (t[0] == " " and t[-1].isalpha())]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        joined = self.tokenizer.encode_batch_fast(["".join(texts[i] for i in words)], add_special_tokens=False)[0]
        in_words = np.array(joined.ids, np.uint32)
        of_word = np.cumsum(self.opens_word[in_words]) - 1
        order = np.array(words + rest, np.int64)
        size = np.concatenate([np.bincount(of_word, minlength=len(words)).astype(np.int32),
                               np.fromiter((len(x) for x in found), np.int32, len(found))])
        ids = np.concatenate([in_words, *(np.array(x.ids, np.uint32) for x in found)])
        # back to the order of the keys
        begin = np.empty(len(texts), np.int64)
        begin[order] = np.cumsum(size, dtype=np.int64) - size
        unordered, size = size, np.empty(len(texts), np.int32)
        size[order] = unordered
        at = len(self.ids) + begin
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, size)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        raw = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        plain = [i for i, r in enumerate(raw) if len(r) and r.max() < SAFE_BELOW and "<|" not in texts[i]]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        simple = set(plain)
        for i, t in enumerate(texts):
            if t and i not in simple:
                out[i] = self.whole(t)
        if not plain:
            return out
        lengths = np.array([len(raw[i]) for i in plain])
        doc_starts = np.cumsum(lengths) - lengths
        cp = np.concatenate([raw[i] for i in plain])
        starts = pre_token_starts(cp, doc_starts)
        ends = np.append(starts[1:], len(cp))
        # the hash of cp[a:b] is sum(mix(cp[i]) * M^(i-a)); prefix sums give sum(mix * M^i), and an odd M has an inverse
        pw, ipw = _powers(len(cp) + 1)
        mixed = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * pw[:len(cp)])])
        keys = (total[ends] - total[starts]) * ipw[starts]
        keys ^= (ends - starts).astype(np.uint64) << np.uint64(48)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_ENTRIES:
                self.clear()
                known[:] = False
            miss = np.flatnonzero(~known)
            s, e = starts[first[miss]], ends[first[miss]]
            buffer = cp.astype("<u4").tobytes()
            self.learn(distinct[miss], [buffer[4 * a:4 * b].decode("utf-32-le") for a, b in zip(s.tolist(), e.tolist())])
            at = np.searchsorted(self.keys, distinct)
        size = self.size[at][back]
        begin = self.at[at][back]
        # gather: position within the token stream minus the stream start of its pre-token, plus where its ids begin
        stream = np.cumsum(size, dtype=np.int64)
        index = np.arange(int(stream[-1]), dtype=np.int64) + np.repeat(begin - (stream - size), size)
        ids = self.ids[index]
        cuts = np.append(np.searchsorted(starts, doc_starts), len(starts))
        edges = np.concatenate([np.zeros(1, np.int64), stream])[cuts]
        for k, i in enumerate(plain):
            out[i] = ids[edges[k]:edges[k + 1]]
        return out


def tokenizer_text(source: str) -> str:
    """The JSON text of a tokenizer, given as text or as the path of its file: the driver reads the file, and tasks
    get the text, since executors need not have the file."""
    if source.lstrip().startswith("{"):
        return source
    with open(source, encoding="utf-8") as f:
        return f.read()


def vocabulary(source: str) -> _Vocabulary:
    """The vocabulary of a tokenizer's path or text, made once in a worker."""
    cache = worker_cache()
    key = f"vocabulary {len(source)} {hash(source)}"
    if key not in cache:
        cache[key] = _Vocabulary(source)
    return cache[key]


def encode_all(texts: list[str], source: str, end_id: int = END_ID, chars: int = 1 << 19) -> Iterator[np.ndarray]:
    """The ids of each text with the end id, some ``chars`` characters at a time."""
    v, group, size = vocabulary(source), [], 0
    for t in [*texts, None]:
        if t is None or size + len(t) > chars:
            for ids in v.encode(group):
                yield np.append(ids, np.uint32(end_id))
            group, size = [], 0
        if t is not None:
            group.append(t)
            size += len(t)


def _dtype(width: int) -> str:
    return "<u2" if width == 2 else "<u4"


def train_dictionary(docs: DataFrame, n_docs: int, tokenizer: str, width: int, id_col: str, text_col: str) -> bytes:
    """A dictionary from the ids of some ``DICT_DOCS`` documents that a fixed hash of the id selects.

    The hash keeps about three times as many of the ``n_docs`` rows, wherever they are, and the first of
    those are taken: the driver gets that many texts, cut to what training uses, whatever the corpus. Too few
    ids to train on: no dictionary.
    """
    import zstandard
    share = min(1.0, 3 * DICT_DOCS / max(1, n_docs))
    text = F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 1, 8 * DICT_IDS)
    h = F.coalesce(F.xxhash64(id_col), F.lit(0))
    sample = docs.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).select(
        h.alias("h"), F.col(id_col).alias("i"), text.alias("t")).orderBy("h", "i", "t").limit(DICT_DOCS).select("t").collect()
    ids = [x[:DICT_IDS].astype(_dtype(width)).tobytes() for x in encode_all([r.t for r in sample], tokenizer)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    import zstandard
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_dict_id=False), \
        zstandard.ZstdDecompressor(dict_data=d)


def _encode(tokenizer, width: int, dictionary: bytes, bounds: list[int]):
    """(key, doc_id, text) to (shard, key, doc_id, n_tokens, frame), where the text is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, source = _compressor(dictionary)[0], tokenizer.value
        cuts = np.array(bounds, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = list(encode_all(part.column(2).to_pylist(), source))
                frames = [pack.compress(x.astype(_dtype(width)).tobytes()) for x in ids]
                key = part.column(0)
                shard = np.searchsorted(cuts, np.asarray(key.fill_null(0)), side="left")
                shard[np.asarray(key.is_null())] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), key, part.column(1), pa.array(list(map(len, ids)), pa.int32()),
                     pa.array(frames, pa.binary())], names=["shard", "key", "doc_id", "n_tokens", "frame"])

    return run


def _write(folder: str, width: int, dict_hash: bytes):
    """Frames, sorted by shard and document, to shard files; one row per file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, part, frames, docs, offset = None, 0, [], [], struct.calcsize(HEAD)

        def close():
            tokens = sum(d[4] for d in docs)
            body = b"".join(frames)
            index = np.array(docs, ENTRY).tobytes()
            foot = struct.pack(FOOT, len(docs), tokens, struct.calcsize(HEAD) + len(body), MAGIC)
            name = f"shard-{current:06d}-{uuid.uuid4().hex}.bin"
            put_file(folder, name, struct.pack(HEAD, MAGIC, 1, width, dict_hash) + body + index + foot)
            return pa.RecordBatch.from_pydict({"shard": pa.array([current], pa.int32()),
                                               "part": pa.array([part], pa.int32()), "name": [name],
                                               "n_docs": pa.array([len(docs)], pa.int64()),
                                               "n_tokens": pa.array([tokens], pa.int64())})

        for batch in batches:
            for shard, _, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != current or offset > FILE_BYTES:
                    if docs:
                        yield close()
                    part = part + 1 if shard == current else 0
                    current, frames, docs, offset = shard, [], [], struct.calcsize(HEAD)
                docs.append((doc is not None, doc or 0, offset, len(frame), n))
                frames.append(frame)
                offset += len(frame)
        if docs:
            yield close()

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 width: int = 2, shard_bytes: int = SHARD_BYTES, order: Column | None = None) -> tuple[DataFrame, bytes]:
    """Write the shards and the dictionary; returns (one row per file: shard, part, name, n_docs, n_tokens; dictionary).

    Documents go in ascending order of ``order`` (a bigint), of their id without one.
    Null and empty texts give the end id alone. A null id sorts first. Rows
    that repeat an id all stay, next to one another, ordered by their frames.
    An empty table writes no shard. Columns besides the two named are not read.
    """
    small_batches(docs.sparkSession)
    key = F.col(id_col) if order is None else order
    rows = docs.select(key.cast("bigint").alias("key"), F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1).alias("b"), F.count(F.lit(1)).alias("n")).first()
    dictionary = train_dictionary(rows, size.n, tokenizer, width, "doc_id", "text")
    put_file(folder, "dictionary", dictionary)
    total = size.b or 0
    n_shards = max(1, -(-total // shard_bytes))
    bounds: list[int] = []
    if n_shards > 1:
        at = [i / n_shards for i in range(1, n_shards)]
        found = rows.agg(F.percentile_approx("key", at, 100 * n_shards).alias("q")).first().q
        bounds = sorted(set(found or []))
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))
    frames = rows.mapInArrow(_encode(source, width, dictionary, bounds),
                             "shard int, key bigint, doc_id bigint, n_tokens int, frame binary")
    placed = frames.repartition(max(1, len(bounds) + 1), "shard").sortWithinPartitions(
        "shard", F.col("key").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "frame")
    dict_hash = hashlib.sha256(dictionary).digest()
    return cut_lineage(placed.mapInArrow(_write(folder, width, dict_hash),
                                         "shard int, part int, name string, n_docs bigint, n_tokens bigint")), dictionary


def open_shard(folder: str, name: str):
    """(file, id width, dictionary hash, index) of a shard."""
    store, path = open_folder(folder)
    f = store.open_input_file(f"{path}/{name}")
    magic, _, width, dict_hash = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
    f.seek(f.size() - struct.calcsize(FOOT))
    n, _, at, end = struct.unpack(FOOT, f.read(struct.calcsize(FOOT)))
    if (magic, end) != (MAGIC, MAGIC):
        raise ValueError(f"{name} is not a token shard")
    f.seek(at)
    return f, width, dict_hash, np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)


def read_document(folder: str, name: str, at: int, dictionary: bytes) -> np.ndarray:
    """The ids of the document at place ``at`` of a shard, by its index entry alone."""
    f, width, dict_hash, index = open_shard(folder, name)
    if dict_hash != hashlib.sha256(dictionary).digest():
        raise ValueError("another dictionary")
    f.seek(int(index["offset"][at]))
    return np.frombuffer(_compressor(dictionary)[1].decompress(
        f.read(int(index["packed"][at])), max_output_size=int(index["n_tokens"][at]) * width), _dtype(width))


def _read(folder: str, dictionary: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = _compressor(dictionary)[1]
        for pdf in batches:
            for name, first in zip(pdf["name"], pdf["first"]):
                f, width, dict_hash, index = open_shard(folder, name)
                if dict_hash != hashlib.sha256(dictionary).digest():
                    raise ValueError("another dictionary")
                start = int(first)
                for at in range(0, len(index), 1024):
                    part = index[at:at + 1024]
                    f.seek(int(part["offset"][0]))
                    data = f.read(int(part["packed"].sum()))
                    ids, place = [], 0
                    for size, n in zip(part["packed"].tolist(), part["n_tokens"].tolist()):
                        ids.append(unpack.decompress(data[place:place + size], max_output_size=n * width))
                        place += size
                    n = part["n_tokens"].astype(np.int64)
                    wide = [np.frombuffer(x, _dtype(width)).astype("<u4") for x in ids]
                    doc = pd.arrays.IntegerArray(part["doc_id"].astype(np.int64), part["has_id"] == 0)
                    yield pd.DataFrame({
                        "doc_id": doc,
                        "start": start + np.cumsum(n) - n, "n_tokens": n,
                        "ids_crc32": np.array([zlib.crc32(x.tobytes()) for x in wide], np.int64), "ids": wide})
                    start += int(n.sum())

    return run


def read_shards(folder: str, shards: DataFrame, dictionary: bytes, with_ids: bool = True) -> DataFrame:
    """Every document of the shards in reading order: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``start`` counts the ids of all documents before: a running total over the
    shards (one row each), continued by the index of the shard.
    """
    spark = shards.sparkSession
    totals = sorted((r.shard, r.part, r.name, r.n_tokens) for r in shards.collect())  # a row per 32 MB of text
    first, rows = 0, []
    for _, _, name, n in totals:
        rows.append((name, first))
        first += n
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
                                     + ", ids array<bigint>" * with_ids)
    names = spark.createDataFrame(rows, "name string, first bigint").repartition(len(rows))
    read = _read(folder, dictionary)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if with_ids:
        return names.mapInPandas(read, schema + ", ids array<bigint>")
    return names.mapInPandas(lambda it: (x.drop(columns="ids") for x in read(it)), schema)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
               order: Column | None = None) -> DataFrame:
    """Write the shards of ``docs`` to a new shared folder and read them back, without the ids."""
    folder = shared_folder(docs.sparkSession, "tokens")
    shards, dictionary = write_shards(docs, folder, tokenizer, id_col, text_col, order=order)
    return read_shards(folder, shards, dictionary, with_ids=False)


ship(__name__)
