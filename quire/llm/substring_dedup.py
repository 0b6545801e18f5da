"""Removal of passages that occur earlier in the corpus, word for word.

Rabin-Karp values of every window of ``k`` consecutive words are dealt out by their value and counted there; the windows
whose words also start earlier are sent back to their documents, where overlapping ones merge into maximal removal
intervals. A map task sends each value once for every FLUSH_WINDOWS windows (the earliest, the others are known to
repeat), so a passage of a third of all documents stays small, and values travel packed, a blob for each bucket; what is
found travels packed too, a blob for each bucket and block of documents. Spark deals the blobs out; the values of a bucket
are sorted and counted there by numpy.

Windows are told apart by 64 bits of their words' hashes and by their bucket, which a second polynomial gives: with n
windows in b buckets the chance that any two different windows are taken for the same is below n * n / (2**65 * b), 1 in
10,000 for the 5 * 10**9 windows of 30 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _kernels as K
from quire.llm._store import freed, settled

#: Windows that a map task holds before it sends them, and that a bucket gets on average, whatever the input's size.
FLUSH_WINDOWS, BUCKET_WINDOWS = 1_000_000, 750_000
#: Bytes of text that stand for one window when buckets are counted out.
WINDOW_BYTES = 6
_BUCKET_BASE = 0xA24BAED4963EE407

#: Stands for a null doc_id: before all others.
NULL_ID = -(1 << 63)


def _pack(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> bytes:
    """docs: rows of keys (doc_id, text_hash)."""
    used, docs = np.unique(docs, return_inverse=True)
    head = np.array([len(used), len(starts), len(hashes)], np.int64).tobytes()
    near = np.diff(starts.astype(np.int32), prepend=np.int32(0))
    ids = keys[used]
    body = head + np.diff(ids[:, 0], prepend=np.int64(0)).tobytes() + ids[:, 1].tobytes() + np.diff(docs.astype(np.int32), prepend=np.int32(0)).tobytes() + near.view(np.uint8).reshape(-1, 4).T.tobytes()
    body = zstandard.ZstdCompressor(level=1).compress(body)
    return len(body).to_bytes(4, "little") + body + hashes.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    body = zstandard.ZstdDecompressor().decompress(blob[4 : 4 + n])
    n_keys, m, n_hashes = np.frombuffer(body, np.int64, 3).tolist()
    keys = np.frombuffer(body, np.int64, 2 * n_keys, 24).reshape(2, -1).T.copy()
    np.cumsum(keys[:, 0], out=keys[:, 0])
    at = 24 + 16 * n_keys
    docs = np.cumsum(np.frombuffer(body, np.int32, m, at))
    starts = np.cumsum(np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * m, at + 4 * m).reshape(4, -1).T).view(np.int32).ravel())
    return np.frombuffer(blob, np.uint64, n_hashes, len(blob) - 8 * n_hashes), docs, starts, keys


def _earliest(hashes: np.ndarray, keys: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are the earliest of their value, rows that start later than that). Equal (doc_id, start): both earliest."""
    order = np.lexsort((starts, keys[docs, 0], hashes))
    h, d, s = hashes[order], keys[docs[order], 0], starts[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    tie = (d == d[lead]) & (s == s[lead])
    return order[tie], order[~tie]


def _windows(buckets: int, k: int, null_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        keys: list[np.ndarray] = []
        n_docs = n_held = 0

        def flush():
            hashes, deal, docs, starts = (np.concatenate(x) for x in zip(*held, strict=True))
            all_keys = np.concatenate(keys)
            first, later = _earliest(hashes, all_keys, docs, starts)
            rows = []
            if len(later):
                later.sort()
                rows.append((int(docs[later[0]]) % buckets, True, _pack(np.zeros(0, np.uint64), docs[later], starts[later], all_keys)))
            first = np.sort(first)
            first = first[np.argsort(deal[first], kind="stable")]
            cuts = np.flatnonzero(np.diff(deal[first], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(first)], strict=True):
                x = first[a:b]
                rows.append((int(deal[x[0]]), False, _pack(hashes[x], docs[x], starts[x], all_keys)))
            held.clear(), keys.clear()
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "known", "blob"])

        for batch in batches:
            ids = np.stack([np.asarray(batch.column(0).fill_null(null_id)), np.asarray(batch.column(1))], axis=1).astype(np.int64)
            for at, to, data, offs in K.texts(batch.column(2)):
                starts, ends, first = K.words(data, offs)
                hashes = K.word_hashes(data, starts, ends)
                doc, start = K.window_starts(first, k)
                if len(doc):
                    deal = (K.rolling(hashes, k, _BUCKET_BASE)[start] >> np.uint64(40)).astype(np.int64) % buckets
                    held.append((K.rolling(hashes, k)[start], deal.astype(np.int32), (doc + n_docs).astype(np.int32), (start - first[doc]).astype(np.int32)))
                    keys.append(ids[at:to])
                    n_docs += to - at
                    n_held += len(doc)
                if n_held >= FLUSH_WINDOWS:
                    yield from flush()
                    n_docs = n_held = 0
        if held:
            yield from flush()
        K.give_back()

    return run


_NONE = np.zeros(0, np.uint64)


def _repeats(blocks: int):
    """Of one bucket: blobs, by block of documents, of the windows that start later than the same words elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        found, parts, keys = [], [], []  # found: (key rows, starts) pairs
        n_keys = 0
        for is_known, blob in zip(table.column("known").to_pylist(), table.column("blob"), strict=True):
            hashes, docs, starts, own = _unpack(blob.as_py())
            if is_known:
                found.append((own[docs], starts))
            else:
                parts.append((hashes, docs + n_keys, starts))
                keys.append(own)
                n_keys += len(own)
        if parts:
            hashes, docs, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
            all_keys = np.concatenate(keys)
            _, later = _earliest(hashes, all_keys, docs, starts)
            found.append((all_keys[docs[later]], starts[later]))
        rows, starts = (np.concatenate(x) for x in zip(*found, strict=True))
        block = (K.mix(rows[:, 0].astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)
        order = np.lexsort((starts, rows[:, 1], rows[:, 0], block))
        block, rows, starts = block[order], rows[order], starts[order].astype(np.int32)
        new_doc = np.append(True, (rows[1:] != rows[:-1]).any(axis=1)) if len(rows) else np.zeros(0, bool)
        doc, keys_of = np.cumsum(new_doc) - 1, rows[new_doc]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        blobs = [_pack(_NONE, doc[a:b], starts[a:b], keys_of) for a, b in zip(cuts, np.append(cuts[1:], len(rows))[: len(cuts)], strict=True)]
        return pa.table({"block": pa.array(block[cuts], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _collected(table: pa.Table) -> pa.Table:
    """Of one block: a row for each document with the first words of its later windows."""
    parts = [_unpack(blob.as_py()) for blob in table.column("blob")]
    rows, starts = np.concatenate([keys[docs] for _, docs, _, keys in parts]), np.concatenate([s for _, _, s, _ in parts]).astype(np.int32)
    order = np.lexsort((starts, rows[:, 1], rows[:, 0]))
    rows, starts = rows[order], starts[order]
    cuts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    blobs = [starts[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)]
    return pa.table({"doc_id": pa.array(rows[cuts, 0]), "text_hash": pa.array(rows[cuts, 1]), "starts": pa.array(blobs, pa.binary())})


def _removed(n_words: int, starts: bytes | None, k: int) -> np.ndarray:
    """Which words the windows cover."""
    change = np.zeros(n_words + k + 1, np.int64)
    at = np.unique(np.frombuffer(starts or b"", np.int32))
    change[at] += 1
    change[at + k] -= 1
    return np.cumsum(change)[:n_words] > 0


def _cut(k: int, names: list[str], handed: list[str]):
    types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("__text", "__starts")}
            marks = columns["__starts"].to_pylist()
            n_words, n_removed, digests, out, spans = [], [], [], [], []
            for at, to, data, offs in K.texts(columns["__text"]):
                starts, ends, first = K.words(data, offs)
                raw = data.tobytes()
                for d in range(to - at):
                    a, b = int(first[d]), int(first[d + 1])
                    gone = _removed(b - a, marks[at + d], k)
                    s, e = starts[a:b], ends[a:b]
                    cuts = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    edges = [(int(s[i]), int(s[j]) if j < b - a else int(e[j - 1])) for i, j in zip(cuts[::2], cuts[1::2], strict=True)]
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True)])).hexdigest())
                    spans.append([{"start": int(i), "end": int(j)} for i, j in zip(cuts[::2], cuts[1::2], strict=True)])
                    at_byte, left = int(offs[d]), []
                    for x, y in edges:
                        left.append(raw[at_byte:x])
                        at_byte = y
                    left.append(raw[at_byte : int(offs[d + 1])])
                    out.append(b"".join(left).decode() if columns["__text"][at + d].is_valid else None)
            new = {"n_words": n_words, "n_removed": n_removed, "kept_sha256": digests, "removed": spans, "kept_text": out}
            own = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", *handed)}
            columns = [own["doc_id"], *(pa.array(new[n], types[n]) for n in names), *(own[n] for n in handed)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, *handed])
        K.give_back()

    return run


def _text_hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _keyed(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, int, bool]:
    """(doc_id, text_hash, text) of every row, the bytes of all texts, and whether no doc_id repeats. text_hash tells rows of one doc_id apart; it is 0 where there is no need."""
    found = docs.agg(F.sum(F.octet_length(F.col(text))).alias("size"), F.count("*").alias("n"), F.count_distinct(F.col(doc_id)).alias("ids")).first()
    unique = found["n"] == found["ids"]
    hashed = F.lit(0).cast("long") if unique else _text_hash(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), hashed.alias("text_hash"), F.col(text).alias("text")), found["size"] or 0, unique


def repeated_windows(keyed: DataFrame, size: int, k: int = 20) -> DataFrame:
    """(doc_id, text_hash, starts) of documents with windows whose words start earlier: those windows' first words, as packed 32-bit numbers."""
    buckets = max(8, int(size / WINDOW_BYTES / BUCKET_WINDOWS))
    packed = keyed.mapInArrow(_windows(buckets, k, NULL_ID), "bucket int, known boolean, blob binary")
    found = packed.groupBy("bucket").applyInArrow(_repeats(buckets), "block int, blob binary")
    return found.groupBy("block").applyInArrow(_collected, "doc_id long, text_hash long, starts binary")


def remove_repeats(docs: DataFrame, k: int = 20, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and n_words, n_removed, kept_sha256, removed (word intervals [start, end)), kept_text of every row.

    Removed is each word covered by a window of k words of one text whose word sequence also starts earlier: in a
    smaller doc_id, or in the same document at an earlier word. kept_sha256 is of the kept words joined by one space;
    kept_text is the text without the removed intervals, each up to the next
    kept word, its other white space as it was. Null text: no words, null
    kept_text, the digest of nothing. A null doc_id comes before all others; it counts as the least 64-bit number. Rows
    that repeat a doc_id are documents of their own, told apart by their texts; windows at the same start of theirs tie,
    and neither is later. Texts of fewer than k words lose nothing. An empty table gives no rows. Columns named in carry
    are handed on; others are not looked at. Sequences are compared by hashes of 64 bits and more, see above.
    """
    keyed, size, unique = _keyed(docs, text, doc_id)
    # written, so that the windows' shuffle files can go before the texts are dealt out
    found = settled(repeated_windows(keyed, size, k), "repeats")
    freed(docs.sparkSession)
    marks = found.select(F.col("doc_id").alias("__key"), F.col("text_hash").alias("__hash"), F.col("starts").alias("__starts"))
    hashed = F.lit(0).cast("long") if unique else _text_hash(text)
    handed = [f"__c{i}" for i in range(len(carry))]
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("__key"), hashed.alias("__hash"), F.col(text).alias("__text"),
        *[F.col(c).alias(n) for c, n in zip(carry, handed, strict=True)],
    )
    both = rows.join(marks, ["__key", "__hash"], "left").drop("__key", "__hash")
    own = [("doc_id", "long"), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("removed", "array<struct<start:bigint,end:bigint>>"), ("kept_text", "string")]
    ddl = ", ".join(f"{n} {t}" for n, t in [*own, *((n, docs.schema[c].dataType.simpleString()) for c, n in zip(carry, handed, strict=True))])
    out = both.mapInArrow(_cut(k, [n for n, _ in own[1:]], handed), ddl)
    return out.select(*[n for n, _ in own], *[F.col(n).alias(c) for c, n in zip(carry, handed, strict=True)])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)),
runs AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS k, count(*) OVER f AS n FROM one WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT doc_id, i, i AS start FROM runs WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, word, coalesce(i - max(start) OVER (PARTITION BY doc_id ORDER BY i) < 20, false) AS gone FROM one LEFT JOIN later USING (doc_id, i))
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
