"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected on CURVES random planes of DIMS dimensions, each shifted by a random offset, and ordered along a
Hilbert curve in each. Spark range-partitions every ordering; its rows are dealt into blocks of consecutive ones. A query
looks at its own block and at those within WINDOW of the rows on either side, in every ordering; what these windows find
is merged and ranked by the exact inner product.

The largest inner products belong to long vectors in the query's direction. So a query stands in an ordering where its
vector would, lengthened (or shortened) to the length that QUANTILE of the vectors stay below; where all lengths are
equal that is its own place.

Vectors without structure (independent coordinates) need wide windows: at 64 dimensions the windows of 24 curves must
span 4 % of the rows together for a recall of 0.95, so the search takes about as many inner products as a full one (0.96
of them from 50,000 rows on). CURVES and WINDOW are set for that; with clustered vectors a window far smaller will do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._store import settled

CURVES, DIMS, BITS = 24, 8, 7
#: Share of the rows on either side of a query that its windows reach at least; rows of a block, at least and at most: a
#: block is no larger than a window's side, so that rounding adds little, and a task's memory does not grow.
WINDOW, BLOCKS = 0.0134, (256, 4096)
#: Queries are placed as if their length were this quantile of all lengths.
QUANTILE = 0.95
#: Vectors by which coordinates are scaled, at most: those whose ids hash lowest.
SAMPLE = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (n, dims), each coordinate below 2**bits, along the Hilbert curve.

    The curve's order is found level by level from the top: the coordinates' bits of a level, seen in the current frame,
    give the cell's place by their Gray code, and the cell's entry corner and direction give the frame of the next.
    """
    n, dims = cells.shape
    one = np.uint64(1)
    full = np.uint64((1 << dims) - 1)
    entry, turn = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    key = np.zeros(n, np.uint64)
    width = np.uint64(dims)
    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.uint64)
        for d in range(dims):
            corner |= ((cells[:, d].astype(np.uint64) >> np.uint64(level)) & one) << np.uint64(d)
        seen = corner ^ entry
        by = (turn + one) % width
        seen = ((seen >> by) | (seen << (width - by) % np.uint64(64))) & full
        place = seen.copy()  # inverse Gray code
        for shift in (1, 2, 4, 8, 16, 32):
            place ^= place >> np.uint64(shift)
        key = (key << width) | place
        # entry corner and direction of that place in its parent
        even = np.where(place == 0, np.uint64(0), (place - one) & ~one)
        start = np.where(place == 0, np.uint64(0), even ^ (even >> one))
        odd = np.where(place & one == 0, np.where(place == 0, np.uint64(0), place - one), place)
        direction = np.zeros(n, np.uint64)
        live = odd.copy()
        for _ in range(dims):  # trailing ones
            more = (live & one) == one
            direction += more
            live = np.where(more, live >> one, np.uint64(0))
        direction = np.where(place == 0, np.uint64(0), direction % width)
        start = ((start << by) | (start >> ((width - by) % np.uint64(64)))) & full
        entry ^= start
        turn = (turn + direction + one) % width
    return key


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.7978845608 * (x + 0.044715 * x**3)))


class Curves:
    """Random planes and shifts from a seed, and the scale of the sample's coordinates on them."""

    def __init__(self, sample: np.ndarray, dim: int, seed: int = 20):
        r = np.random.default_rng(seed)
        self.dims = min(DIMS, dim)
        self.planes = [np.linalg.qr(r.normal(size=(dim, self.dims)))[0] for _ in range(CURVES)]
        self.shifts = r.random((CURVES, self.dims)) / 2
        on = [sample @ p for p in self.planes]
        self.mean = [x.mean(axis=0) if len(x) else np.zeros(self.dims) for x in on]
        self.spread = [np.maximum(x.std(axis=0), 1e-12) if len(x) else np.ones(self.dims) for x in on]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(CURVES, n) keys."""
        out = []
        for c in range(CURVES):
            # numbers beyond all bounds lie at an end
            unit = _normal_cdf(np.clip(np.nan_to_num((vectors @ self.planes[c] - self.mean[c]) / self.spread[c]), -50, 50))
            cells = np.minimum((unit / 2 + self.shifts[c]) * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
            out.append(hilbert_keys(cells, BITS).astype(np.int64))
        return np.stack(out)


def _unpack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _packed(dim: int):
    """Usable vectors as bytes, with their lengths: all components there, finite, and not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
            x = x + 0.0  # one zero
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in x[good]], pa.binary()), pa.array(np.linalg.norm(x[good], axis=1))], names=["vec_id", "vec", "norm"])

    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, vec, norm) of the rows that take part, and their dimension: the most frequent length (ties: the smaller)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).filter("vec_id is not null and e is not null and size(e) > 0")
    top = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = top["d"] if top else 1
    return rows.filter(F.size("e") == dim).mapInArrow(_packed(dim), "vec_id long, vec binary, norm double"), dim


def build_index(rows: DataFrame, dim: int, window: float = WINDOW) -> tuple[DataFrame, int, int]:
    """(curve, block, node, vec, asks) of every vector in every ordering, and again (asks) where a query stands; blocks to look at on either side, and the last block.

    rows: (node, vec, norm, asked), a vector each.
    """
    spark = rows.sparkSession
    sample = rows.select("node", "vec").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()  # SAMPLE vectors
    curves = Curves(np.frombuffer(b"".join(r["vec"] for r in sample), np.float64).reshape(-1, dim), dim)
    found = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.percentile_approx("norm", QUANTILE, 10000).alias("length")).first()
    total, length = found["n"] + found["asked"], found["length"] or 1.0
    size = int(min(max(window * total, BLOCKS[0]), BLOCKS[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                for asks in (False, True):
                    if asks:
                        part = part.filter(part.column(3))
                    if not part.num_rows:
                        continue
                    x = _unpack(part.column(1), dim)
                    if asks:
                        x = x * (length / np.asarray(part.column(2)))[:, None]
                    for c, keys in enumerate(curves.keys(x)):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), part.column(0), part.column(1), pa.array(np.full(len(keys), asks))], names=["curve", "key", "node", "vec", "asks"])

    keyed = rows.select("node", "vec", "norm", "asked").mapInArrow(run, "curve int, key long, node long, vec binary, asks boolean")
    parts = max(CURVES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # written, so that the partitions, whose bounds Spark samples, are the same for the counts and for the blocks
    ordered = settled(
        keyed.repartitionByRange(parts, "curve", "key", "node", "asks").sortWithinPartitions("curve", "key", "node", "asks")
        .select("curve", "node", "vec", "asks", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "curves",
    )
    # one row for each partition and curve that meet, parts + CURVES at most
    counts = ordered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    places = counts.select("curve", "part", "first", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ordered.join(F.broadcast(settled(places, "places")), ["curve", "part"])
    index = placed.select("curve", F.floor((F.col("before") + F.col("at") - F.col("first")) / size).cast("int").alias("block"), "node", "vec", "asks")
    return index, max(1, math.ceil(window * total / size)), max(0, (total - 1) // size)


def _rank(dim: int, k: int):
    """Of one block and the queries that look at it: each query's k nearest there."""

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows or not block.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        queries, rows = _unpack(asked.column("point"), dim), _unpack(block.column("vec"), dim)
        ids, nodes = np.asarray(asked.column("query")), np.asarray(block.column("node"))
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows[order], nodes[order]
        out = []
        for at in range(0, len(ids), 256):
            scores = queries[at : at + 256] @ rows.T
            if scores.shape[1] > k:
                # all that tie with the k-th, and a little more: the sums are taken again in one order below
                floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                i, j = np.nonzero(scores >= (floor - 1e-9 * np.maximum(1, np.abs(floor)))[:, None])
            else:
                i, j = np.nonzero(np.ones_like(scores, bool))
            exact = np.einsum("ij,ij->i", queries[at + i], rows[j])
            order = np.lexsort((nodes[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, i)
            keep = np.arange(len(i)) - first < k
            out.append((ids[at + i[keep]], nodes[j[keep]], exact[keep]))
        query, node, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": pa.array(query), "node": pa.array(node), "score": pa.array(score)})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", window: float = WINDOW) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of ``queries`` (a column of ids of ``vectors``) the k nearest of the other rows.

    Nearest is the largest inner product in double precision, ties to the smaller vec_id. Rows whose vector is null,
    all zero, of another length than most, or holds a null or a number that isn't finite take no part, nor do rows
    without an id. Equal vectors are searched once and all k of them that can matter are given by id: a vector of a
    third of all rows is one row of the index. Rows that repeat an id and its vector count once. Where there are fewer
    candidates than k, all are given. An empty table gives no rows. Other columns are not looked at.
    """
    found, dim = usable(vectors, vec_id, embedding)
    found = settled(found.distinct(), "vectors")
    keyed = found.withColumn("same", F.sha2("vec", 256))
    # the smallest k + 1 ids of a vector: more can't be among anyone's k nearest
    place = Window.partitionBy("same").orderBy("vec_id")
    least = settled(keyed.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1).select("same", "vec_id", "place", F.when(F.col("place") == 1, F.col("vec")).alias("vec"), "norm"), "members")
    nodes = least.filter("place = 1").select("same", F.col("vec_id").alias("node"), "vec", "norm")
    asked = keyed.select("vec_id", "same").join(queries.select(F.col(queries.columns[0]).cast("long").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), "same")
    asked = settled(asked.join(nodes.select("same", F.col("node").alias("query")), "same").select("query_id", "query"), "queries")
    wanted = asked.select(F.col("query").alias("node")).distinct().withColumn("asked", F.lit(True))
    rows = settled(nodes.join(wanted, "node", "left").select("node", "vec", "norm", F.coalesce("asked", F.lit(False)).alias("asked")), "nodes")
    placed, reach, last = build_index(rows, dim, window)
    index = placed.filter("not asks").drop("asks")
    looking = placed.filter("asks").select(
        F.col("curve").alias("on"), F.col("node").alias("query"), F.col("vec").alias("point"), F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(last)))).alias("near")
    )
    hits = looking.groupBy("on", "near").cogroup(index.groupBy("curve", "block")).applyInArrow(_rank(dim, k + 1), "query long, node long, score double")
    merged = hits.groupBy("query", "node").agg(F.max("score").alias("score"))
    best = merged.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).filter(F.col("place") <= k + 1).drop("place")
    of_node = least.join(nodes.select("same", "node"), "same").select("node", "vec_id")
    # (k + 1) nodes of at most k + 1 ids each for a query vector
    members = best.join(of_node, "node").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1).drop("place")
    ranked = asked.join(members, "query").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter("vec_id % 20 = 0").select("vec_id"))
