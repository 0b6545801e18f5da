"""Media columns: payloads stored as sound files in content-defined chunks, each distinct chunk once.

A payload becomes the 8-bit samples of a mono sound file. The file is cut where a rolling gear hash of the last 32 bytes
has CUT_BITS zero bits, so equal stretches of different files give equal chunks. A file is known by the ordered list of
its chunks' digests (the manifest); the store holds each digest's bytes once. Reading joins manifests with the store,
puts the chunks in order, and checks every chunk's and the file's digest before anything is computed from it. Equal
files are read once and their figures joined to all their rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _kernels as K
from quire.llm._store import settled

#: A payload's length is a positive multiple of this.
UNIT = 64
#: Chunks end at a cut after at least LEAST bytes, after MOST at the latest; cuts are 2**CUT_BITS bytes apart on average.
LEAST, MOST, CUT_BITS = 4096, 65536, 13
SAMPLE_RATE = 8000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
#: A chunk asked for by more than this share of all requests is sent to every task; there are at most 1 / HOT_SHARE such, of MOST bytes at most.
HOT_SHARE = 0.001
_GEAR = K.mix(np.arange(256, dtype=np.uint64) + np.uint64(0xC0FFEE)).astype(np.uint32)


def sound_file(text: bytes) -> bytes:
    """The payload (text and zero bytes up to a multiple of UNIT) as a RIFF file of unsigned 8-bit samples."""
    payload = text + bytes(-len(text) % UNIT if text else UNIT)
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The payload that a sound file holds."""
    fields = HEADER.unpack_from(media)
    if fields[0] != b"RIFF" or fields[2] != b"WAVE" or fields[5:7] != (1, 1) or fields[10] != 8 or fields[12] != len(media) - HEADER.size:
        raise ValueError("not a sound file of this form")
    return media[HEADER.size :]


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks of a file."""
    n = len(media)
    if n <= LEAST:
        return [n]
    with np.errstate(over="ignore"):
        value = _GEAR[np.frombuffer(media, np.uint8)]
        for step in (1, 2, 4, 8, 16):  # sum over the last 32 bytes, each shifted once more than the next
            value[step:] = value[step:] + (value[:-step] << np.uint32(step))
    ends = np.flatnonzero(value >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, last = [], 0
    while n - last > LEAST:
        at = int(np.searchsorted(ends, last + LEAST))
        end = min(int(ends[at]) if at < len(ends) else n, last + MOST, n)
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return out


def _chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, whole, lists = [], [], []
        for t in batch.column(1):
            text = (t.as_py() or "").encode()
            media = sound_file(text)
            sizes.append(len(text))
            whole.append(hashlib.sha256(media).digest())
            lists.append([hashlib.sha256(c).digest() for c in _chunks(media)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media_id", "chunks"])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        seen: dict[bytes, bytes] = {}
        for t in batch.column(0):
            for c in _chunks(sound_file((t.as_py() or "").encode())):
                if (digest := hashlib.sha256(c).digest()) not in seen:
                    seen[digest] = press.compress(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["digest", "frame"])


def features(payload: bytes) -> str:
    """Peak, mean, energy and zero crossings of the samples about their middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"peak={int(np.abs(x).max())};mean={x.mean():.6f};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for media_id, n, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = {p["seq"]: p for p in parts}
            if sorted(parts) != list(range(n)):
                raise ValueError("a chunk is missing from the store")
            held = []
            for seq in range(n):
                held.append(expand.decompress(parts[seq]["frame"]))
                if hashlib.sha256(held[-1]).digest() != parts[seq]["digest"]:
                    raise ValueError("a chunk does not match its digest")
            media = b"".join(held)
            if hashlib.sha256(media).digest() != media_id:
                raise ValueError("a file does not match its digest")
            payload = samples(media)
            rows.append((media_id, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), media_id.hex(), features(payload)))
        types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def manifests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media_id, chunks): the ordered chunk list of every row's file. Null text is empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_manifest, "doc_id long, n_bytes long, media_id binary, chunks array<binary>")


def chunk_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, frame): each distinct chunk once, compressed."""
    return docs.select(F.col(text).alias("text")).mapInArrow(_stored, "digest binary, frame binary").groupBy("digest").agg(F.first("frame").alias("frame"))


def read_media(listed: DataFrame, store: DataFrame) -> DataFrame:
    """(media_id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each distinct file, rebuilt and checked.

    Chunks stay where their digests put them, and the other requests come there; the few that many files ask for go to
    the requests instead, wherever those are.
    """
    files = listed.groupBy("media_id").agg(F.first("chunks").alias("chunks"))
    wanted = settled(files.select("media_id", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "digest")), "requests")
    total = wanted.count()
    hot = settled(wanted.groupBy("digest").count().filter(F.col("count") > max(1000, total * HOT_SHARE)).select("digest"), "hot")
    few = F.broadcast(hot)  # at most 1 / HOT_SHARE digests
    found = wanted.join(few, "digest", "left_anti").join(store, "digest")
    if not hot.isEmpty():
        sent = F.broadcast(store.join(few, "digest", "left_semi"))  # at most MOST / HOT_SHARE bytes
        found = found.unionByName(wanted.join(few, "digest", "left_semi").join(sent, "digest"))
    parts = found.select("media_id", "n", F.struct("seq", "digest", "frame").alias("part"))
    lone = parts.filter("n = 1").select("media_id", "n", F.array("part").alias("parts"))  # complete as it is
    rest = parts.filter("n > 1").groupBy("media_id").agg(F.first("n").alias("n"), F.collect_list("part").alias("parts"))  # one file's chunks
    schema = "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return lone.unionByName(rest).mapInArrow(_read, schema)


def media_features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and read_media()'s figures of every row.

    Null text is empty; an empty text's payload is UNIT zero bytes. Equal texts give equal values. Rows that repeat a
    doc_id, or have none, are files of their own. A file of any length is stored whole. An empty table gives no rows.
    Other columns are not looked at. A chunk that is missing or altered stops the query.
    """
    listed = settled(manifests(docs, text, doc_id), "manifests")
    figures = read_media(listed, chunk_store(docs, text))
    return listed.select("doc_id", "n_bytes", "media_id").join(figures, "media_id").drop("media_id").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
