"""Near-duplicate documents by one-permutation MinHash.

A document's set of word shingles is hashed once; its smallest value in each of BANDS * ROWS bins is its signature, and
empty bins take the value of a bin chosen by a fixed hash of (bin, attempt), which keeps the chance of agreement at the
similarity (optimal densification). Documents of equal sets are one class from the start. Each band of a signature is a
bucket's key. A bucket's candidate edges form a star: every member to the member with the smallest number, its centre.

All buckets of one centre are a group, which holds each member once. A group's task builds the full sets of its texts,
counts what each two of them share, and gives back a spanning forest of the links it finds; so every pair that shares a
bucket is compared, and a group of n members gives n - 1 rows at most. A centre of more members than a task should hold
has them dealt into blocks, each with the centre. Pairs across its blocks are compared afterwards, and only in buckets
that the links so far leave in several components: there the members of the largest component meet the others, block by
block, and the others each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _kernels as K
from quire.llm._store import released, settled
from quire.llm.components import components

#: At a similarity of 0.8 a pair shares no bucket with a chance of (1 - 0.8**4)**32, 5 in 10**8.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Members, and shingles of all members, that are compared with each other in one task.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Columns of a matrix of sets that are multiplied at a time; a shingle of more than 1 / DENSE of the sets is such a column.
COLUMNS, DENSE = 1024, 16
_EDGES = (np.arange(BINS + 1, dtype=object) * (1 << 64) // BINS).tolist()
_LOW = np.array([e for e in _EDGES[:-1]], np.uint64)
#: Bins that an empty bin turns to, attempt by attempt.
_TURNS = (K.mix(np.arange(BINS * 512, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)) % np.uint64(BINS)).astype(np.int64).reshape(512, BINS)


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of ``width`` lower-cased words; fewer words are one shingle."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offs)
    hashes = K.word_hashes(data, starts, ends)
    rolled = K.rolling(hashes, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        else:
            out.append(K.rolling(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else hashes[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each set that isn't empty."""
    out, filled = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, _LOW)
        has = at < np.append(at[1:], len(s))
        out[i, has], filled[i] = s[at[has]], has
    rows = np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1))
    had, values = filled[rows], out[rows].copy()
    done = had.copy()
    for attempt in range(1 << 20):
        if done.all():
            break
        turn = _TURNS[attempt % len(_TURNS)] if attempt < len(_TURNS) else (np.arange(BINS) + attempt) % BINS
        use = ~done & had[:, turn]
        values[use] = out[rows][:, turn][use]
        done |= use
    out[rows] = values
    return out


def _sign(width: int):
    """Batches: doc_id, text, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = K.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            for at, to, data, offs in K.texts(batch.column(1)):
                sets = shingles(data, offs, width)
                sign = signatures(sets).reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(salt, sign.shape[:2]).copy()
                for r in range(ROWS):
                    key = K.mix(key ^ sign[:, :, r])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([k.tobytes() if len(s) else None for k, s in zip(key, sets, strict=True)], pa.binary()),
                ], names=["doc_id", "text_hash", "n_shingles", "digest", "keys"])
        K.give_back()

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.asarray(part.column(0)), BANDS))], names=["key", "node"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) numbers of hashes that each two sets share; each set's hashes are distinct."""
    n = len(sets)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    of, values = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])[order], values[order]
    run = np.cumsum(np.append(True, values[1:] != values[:-1]), dtype=np.int32) - 1
    del values, order
    times = np.bincount(run)
    shared = np.zeros(n * n, np.int32)
    some = ((times > 1) & (times * DENSE <= n))[run]
    r, o = run[some], of[some]
    at, step = np.arange(len(r), dtype=np.int32), 0  # a hash of few sets: its pairs one by one, by their distance in its run
    while len(at):
        step += 1
        at = at[at + step < len(r)]
        at = at[r[at] == r[at + step]]
        if len(at):
            code, counts = np.unique(o[at].astype(np.int64) * n + o[at + step], return_counts=True)
            shared[code] += counts.astype(np.int32)
    shared = shared.reshape(n, n)
    shared = shared + shared.T
    many = (times > 1) & (times * DENSE > n)
    some = many[run]
    c, o = (np.cumsum(many, dtype=np.int32) - 1)[run[some]], of[some]
    for low in range(0, int(many.sum()), COLUMNS):  # a hash of many sets: a column of ones
        a, b = np.searchsorted(c, [low, low + COLUMNS])
        ones = np.zeros((n, COLUMNS), np.float32)
        ones[o[a:b], c[a:b] - low] = 1
        shared += (ones @ ones.T).astype(np.int32)
    return shared


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of ``linked`` (n, n) that join what all its edges join, without a circle."""
    left, edges = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        reach = [i] if left[i] else []
        left[i] = False
        while reach:
            u = reach.pop()
            found = np.flatnonzero(linked[u] & left)
            left[found] = False
            edges += [(u, v) for v in found.tolist()]
            reach += found.tolist()
    return edges


def _links(width: int, percent: int):
    """Of one group (node, label, text): links between labels, as many as are needed to join what they join. Texts are whole."""

    def run(table: pa.Table) -> pa.Table:
        nodes, labels = (np.asarray(table.column(c)) for c in ("node", "label"))
        sets = [s for _, _, data, offs in K.texts(table.column("text")) for s in shingles(data, offs, width)]
        sizes, shared = np.array([len(s) for s in sets]), shared_counts(sets)
        linked = np.empty(shared.shape, bool)
        for a in range(0, len(nodes), 256):
            b = slice(a, a + 256)
            part = shared[b].astype(np.int64)
            linked[b] = (100 * part >= percent * (sizes[b, None] + sizes[None, :] - part)) & (labels[b, None] != labels[None, :])
        del shared, sets
        edges = np.array(forest(linked), np.int64).reshape(-1, 2)
        if len(nodes) > 64:
            K.give_back()
        return pa.table({"a": pa.array(nodes[edges[:, 0]], pa.int64()), "b": pa.array(nodes[edges[:, 1]], pa.int64())})

    return run


def _parts(n: Column, shingles_of_all: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles_of_all / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _dealt(node: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(node), F.col(blocks).cast("long")).cast("int")


def _compared(groups: DataFrame, by: list[str], classes: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) within groups: rows of by, node and label."""
    wanted = groups.select("node").distinct().join(classes.select("node", "rep"), "node")
    texts = wanted.join(source, F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.text_hash") == F.col("text_hash"))).groupBy("node").agg(F.first("text").alias("text"))
    return groups.join(texts, "node").groupBy(*by).applyInArrow(_links(width, percent), "a long, b long").distinct()


def _across(buckets: DataFrame, big: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups (key, rest, i, j) of nodes with their labels, for the buckets of big centres that hold several components."""
    rows = buckets.join(big.select("centre"), "centre").join(labels, "node", "left").join(classes.select("node", "n_shingles"), "node")
    rows = rows.select("key", "node", F.coalesce("label", "node").alias("label"), "n_shingles")
    held = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    spanning = held.groupBy("key").agg(F.max(F.struct("n", "w", "label")).alias("lead"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("labels")).filter("labels > 1")
    spanning = spanning.select(
        "key", F.col("lead.label").alias("lead"), _parts(F.col("lead.n"), F.col("lead.w")).alias("leading"), _parts(F.col("n") - F.col("lead.n"), F.col("w") - F.col("lead.w")).alias("others")
    )
    rows = rows.join(spanning, "key")
    first, other = rows.filter("label = lead"), rows.filter("label <> lead")

    def meet(df, rest, i, j):
        return df.select("key", F.lit(rest).alias("rest"), i.alias("i"), j.alias("j"), "node", "label")

    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    led = meet(first.withColumn("j", F.explode(count("others"))), False, _dealt("node", "leading"), F.col("j"))
    leads = meet(other.withColumn("i", F.explode(count("leading"))), False, F.col("i"), _dealt("node", "others"))
    own = other.withColumn("own", _dealt("node", "others")).withColumn("to", F.explode(count("others")))
    return led.unionByName(leads).unionByName(meet(own, True, F.least("own", "to"), F.greatest("own", "to")))


def duplicate_groups(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """near_duplicates() with text_hash (xxhash64 of the text) and stands: whether the row is the one that stands for its group.

    That is the row of the smallest doc_id, null last; ties: the smaller text_hash, then any one. A row without words
    stands for itself.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = settled(source.mapInArrow(_sign(width), "doc_id long, text_hash long, n_shingles long, digest binary, keys binary").withColumn("row", F.monotonically_increasing_id()), "signatures")
    real = signed.filter("digest is not null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "row")
    classes = real.groupBy("digest").agg(F.min(place).alias("rep"), F.max("n_shingles").alias("n_shingles"))
    classes = settled(classes.withColumn("node", F.col("rep.row")), "classes")
    members = real.select(F.col("row").alias("node"), "keys").join(classes.select("node"), "node").mapInArrow(_buckets, "key long, node long")
    centres = members.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("key", "centre")
    buckets = settled(members.join(centres, "key"), "buckets")
    star = settled(buckets.filter("node <> centre").select("centre", "node").distinct().join(classes.select("node", "n_shingles"), "node"), "star")
    blocks = star.groupBy("centre").agg(_parts(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    blocks = settled(blocks, "blocks")
    dealt = star.join(blocks, "centre").select("centre", _dealt("node", "blocks").alias("block"), "node")
    dealt = dealt.unionByName(blocks.select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("centre").alias("node")))
    links = settled(_compared(dealt.withColumn("label", F.col("node")), ["centre", "block"], classes, source, width, percent), "links")
    labels = components(links)
    big = blocks.filter("blocks > 1")
    if not big.isEmpty():
        groups = settled(_across(buckets, big, labels, classes), "across")
        more = settled(_compared(groups, ["key", "rest", "i", "j"], classes, source, width, percent), "more")
        labels = components(links.unionByName(more))
        released(groups, more)
    released(buckets, star, blocks, links)
    grouped = classes.join(labels, "node", "left").select("digest", "rep", F.coalesce("label", "node").alias("label"))
    firsts = grouped.groupBy("label").agg(F.min("rep").alias("first"))
    own = grouped.join(firsts, "label").select("digest", "first")
    shown = ("doc_id", "text_hash", "n_shingles")
    found = real.join(own, "digest").select(*shown, F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("stands"))
    return found.unionByName(signed.filter("digest is null").select(*shown, F.col("doc_id").alias("component_id"), F.lit(True).alias("stands")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Words are runs of bytes other than white space, A-Z lower-cased; a document's set is its distinct shingles of
    ``width`` words, or all its words as one shingle if they are fewer. Documents are linked if 100 * shared >= percent
    * united, counted on the full sets (as hashes of 64 bits). component_id: the smallest doc_id reachable over links;
    kept: whether that is the document's own. A pair of documents that share no bucket is not compared: at a similarity
    of 0.8 that is a chance of 5 in 10**8. Empty, null and blank texts have no shingles, are linked with nothing and
    kept. Rows that repeat a doc_id are documents of their own, linked by their texts alone. Rows with a null doc_id are
    linked like others; a group of such rows alone has no component_id and one of them is kept. An empty table gives no
    rows. Other columns are not looked at. Texts are processed whole, whatever their length.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("stands"))
    return duplicate_groups(docs, width, percent, text, doc_id).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group of near duplicates; see duplicate_groups().

    Rows are known by doc_id and text. Of rows alike in both, one stays, any one if other columns differ; but rows
    without words all stay. Columns may have any names.
    """
    known = duplicate_groups(docs, width, percent, text, doc_id).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.count_if("stands").alias("stay")).filter("stay < n")
    rows = docs.select(F.struct("*").alias("all"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    marked = rows.join(known, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    one = marked.filter("stay = 1").groupBy("id", "hash").agg(F.first("all").alias("all"))
    return marked.filter("stay is null").select("all.*").unionByName(one.select("all.*"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


OP6_SQL = r"""
WITH RECURSIVE one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS words
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)),
runs AS (SELECT doc_id, i, words, string_agg(word, ' ') OVER f AS k, count(*) OVER f AS n FROM one WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, k FROM runs WHERE n = 4 OR words < 4 AND i = 1),
sizes AS (SELECT doc_id, count(*) AS size FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * n >= 80 * (a.size + b.size - n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS far FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN both_ways ON x = far)
SELECT doc_id, coalesce(any_value(size), 0)::BIGINT AS n_shingles, min(far) AS component_id, min(far) = doc_id AS kept FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
