"""Operator 2: WARC archives in seekable Zstandard bundles.

A bundle is a file of independent zstd frames, each holding a group of whole
WARC records, closed by the seek table of the public zstd seekable format (a
skippable frame that lists every frame's two sizes). The manifest maps each
record's identifier to its bundle, its frame and its place in the frame, so
one record is read by seeking to one frame.

``write_archives`` runs in map tasks: a task streams its rows into bundles of
bounded size, writes each under a temporary name and renames it when whole.
A task that is run again after a lost executor writes bundles of its own; only
those in the manifest of the successful attempt are ever read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plotwise.llm.common import cut_lineage, shared_folder, ship, small_batches

#: Payloads below this many bytes are always stored, never revisited.
MIN_REVISIT_BYTES = 100
#: A frame is closed at this many bytes of records, a bundle at this many bytes of frames.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20

# FIXED: the zstd seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

CRLF = b"\r\n"
MANIFEST = ("bundle string, record_id string, page_id bigint, frame int, frame_offset bigint, frame_bytes int, "
            "offset_in_frame int, record_bytes int")
RECORDS = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
           "refers_to bigint, record_id string, payload binary")


def record_name(page_id) -> str:
    """The record identifier of a page: the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(page_id, url, payload: bytes, payload_bytes: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has headers alone; length and digest are the full payload's."""
    block = b""
    if kind == "response":
        block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8",
                           b"Content-Length: %d" % len(payload), b"", payload])
    headers = {"WARC-Type": kind, "WARC-Record-ID": record_name(page_id), "WARC-Date": "1970-01-01T00:00:00Z",
               "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-ID": "" if page_id is None else page_id,
               "X-Payload-Bytes": payload_bytes, "Content-Length": len(block)}
    if url is not None:
        # a header is one line; percent-encode what would break it
        headers["WARC-Target-URI"] = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    if kind == "revisit":
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = record_name(refers_to)
        headers["X-Refers-To-Page-ID"] = refers_to
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()
    return b"WARC/1.1\r\n" + head + CRLF + block + CRLF + CRLF


def decode_records(data: bytes) -> Iterator[dict]:
    """The records of one frame, with the payload checked against its digest."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        h = dict(x.split(": ", 1) for x in lines[1:])
        size = int(h["Content-Length"])
        block = data[end + 4: end + 4 + size]
        payload = block.split(b"\r\n\r\n", 1)[1] if h["WARC-Type"] == "response" else None
        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {h['WARC-Record-ID']} does not match its digest")
        url = h.get("WARC-Target-URI")
        yield {"page_id": int(h["X-Page-ID"]) if h["X-Page-ID"] else None,
               "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
               "payload_bytes": int(h["X-Payload-Bytes"]), "payload_digest": digest, "record_type": h["WARC-Type"],
               "refers_to": int(h["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in h else None,
               "record_id": h["WARC-Record-ID"], "payload": payload}
        at = end + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: (compressed, decompressed) size per frame, then the footer."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) per frame."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    table = bundle[len(bundle) - 9 - 8 * n: len(bundle) - 9]
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def open_folder(folder: str):
    """The file system and path of a shared folder."""
    from pyarrow import fs
    # from_uri wants "file:///x" or "/x"; Hadoop also writes "file:/x"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder[5:]
    return fs.FileSystem.from_uri(folder)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder so that it is seen whole or not at all."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/_{name}.tmp") as out:
        out.write(data)
    store.move(f"{path}/_{name}.tmp", f"{path}/{name}")


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        open_frame, entries = bytearray(), []
        pending: list[tuple] = []

        def close_frame():
            nonlocal open_frame, pending
            if open_frame:
                data = packer.compress(bytes(open_frame))
                at = sum(s[0] for s in sizes)
                entries.extend((*p[:2], len(sizes), at, len(data), *p[2:]) for p in pending)
                sizes.append((len(data), len(open_frame)))
                frames.append(data)
                open_frame, pending = bytearray(), []

        def close_bundle():
            nonlocal frames, sizes, entries
            close_frame()
            if frames:
                name = f"{uuid.uuid4().hex}.warc.zst"
                put_file(folder, name, b"".join(frames) + seek_table(sizes))
                done = pd.DataFrame([(name, *e) for e in entries], dtype=object,
                                    columns=["bundle", "record_id", "page_id", "frame", "frame_offset", "frame_bytes",
                                             "offset_in_frame", "record_bytes"])
                done["page_id"] = done["page_id"].astype("Int64")
                frames, sizes, entries = [], [], []
                return done

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                page_id = None if r.page_id is None else int(r.page_id)
                refers = None if r.refers_to is None else int(r.refers_to)
                payload = r.html.encode() if r.record_type == "response" else b""
                rec = encode_record(page_id, r.url, payload, int(r.payload_bytes), r.payload_digest, r.record_type,
                                    refers)
                pending.append((record_name(page_id), page_id, len(open_frame), len(rec)))
                open_frame += rec
                if len(open_frame) >= frame_bytes:
                    close_frame()
                    if sum(s[0] for s in sizes) >= bundle_bytes:
                        yield close_bundle()
        last = close_bundle()
        if last is not None:
            yield last

    return run


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to), html null for revisits."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html"), F.octet_length(html).cast("bigint").alias("payload_bytes"),
                        F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"))
    # only digests that occur again can make a revisit; counts and minima combine before the shuffle
    shared = rows.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(
        F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(
        F.col("payload_digest").alias("__digest"), "__first")
    # the bulk is the html: move only what can be a copy
    joined = rows.join(shared, F.col("payload_digest") == F.col("__digest"), "left")
    again: Column = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes",
                         "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("__first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", frame_bytes: int = FRAME_BYTES,
                   bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` and return the manifest, a table in the shared folder.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at
    least 100 bytes the smallest ``page_id`` is the response, and rows with
    another id revisit it (rows that repeat that id too are responses; where
    no copy has an id, all are). Smaller payloads are always responses. A
    record is never split, so a very long page is a frame of its own. An empty
    table writes no bundle.
    """
    small_batches(pages.sparkSession)
    # ids travel as text: pandas would make floats of whole numbers beside nulls
    rows = classify(pages, id_col, url_col, html_col).withColumns(
        {c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return cut_lineage(rows.mapInPandas(_write(folder, frame_bytes, bundle_bytes), MANIFEST))


def _read(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        store, path = open_folder(folder)
        for pdf in batches:
            for name in pdf["bundle"]:
                with store.open_input_file(f"{path}/{name}") as f:
                    f.seek(f.size() - 9)
                    n = struct.unpack("<IBI", f.read(9))[0]
                    f.seek(f.size() - 9 - 8 * n)
                    for at, packed, plain in read_seek_table(f.read(9 + 8 * n)):
                        f.seek(at)
                        out = pd.DataFrame(list(decode_records(unpack.decompress(f.read(packed), plain))), dtype=object)
                        for c in ("page_id", "refers_to", "payload_bytes"):
                            out[c] = out[c].astype("Int64")
                        yield out

    return run


def read_archives(folder: str, manifest: DataFrame, bundles_per_task: int = 8) -> DataFrame:
    """Every record of the bundles that the manifest names (payload null for revisits).

    Only names are shuffled; a task reads its bundles frame by frame.
    """
    names = manifest.select("bundle").distinct()
    tasks = max(1, -(-names.count() // bundles_per_task))
    return names.repartition(tasks).mapInPandas(_read(folder), RECORDS)


def read_record(folder: str, entry: dict) -> dict:
    """One record by its manifest row: seeks to its frame and decodes that frame alone."""
    import zstandard
    store, path = open_folder(folder)
    with store.open_input_file(f"{path}/{entry['bundle']}") as f:
        f.seek(entry["frame_offset"])
        frame = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_bytes"]))
    at = entry["offset_in_frame"]
    return next(decode_records(frame[at: at + entry["record_bytes"]]))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` to a new shared folder and read them back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(folder, write_archives(pages, folder))


ship(__name__)
