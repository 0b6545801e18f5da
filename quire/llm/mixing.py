"""Mixing of sources to target weights by systematic sampling.

Each document of a source expects the same number of copies, its source's target over its source's size. The prefix
sums of these expectations, shifted by one random offset for the source, run along the documents in order of size; a
document is emitted once for every integer boundary its own stretch crosses. Running in order of size makes the sample
take its share of every size, so that the words taken come near the target.

A document's place in its source is counted on three levels (size, bucket of ids, id), none of which gathers a source
in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._store import settled

#: Buckets of the documents of one source and size.
BUCKETS = 1024
#: Steps of the offsets of consecutive sources, and of those of consecutive seeds; the fractions of these numbers' multiples
#: spread evenly.
OFFSET_STEP, SEED_STEP = 0.6180339887498949, 0.7548776662466927
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int = 0) -> DataFrame:
    """(source, source_size, n_docs, target, ratio, offset) of each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words; a source gets
    at most ``most`` times its size, and what it leaves is shared again by weight, until none is above. The fixed point
    is a level L: every source gets the least of its cap and L times its weight. Sources in order of cap / weight are
    capped up to some place, so running sums find L. One row for each source, so these windows hold few rows.
    """
    by_source = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("s"), F.count("*").alias("n")).groupBy("source").agg(F.sum("s").alias("source_size"), F.sum("n").alias("n_docs"))
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        by_source.withColumn("k", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(turn, (F.col("k") % len(weights) + 1).cast("int")))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
    )
    by_level = everything.orderBy(F.col("cap") / F.col("weight"), "k")
    capped_before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.col("total") - capped_before) / weight_left).withColumn("is_under", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("is_under"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "k", "level"))).over(everything)["level"]
    target = F.least("cap", F.coalesce(F.col("the_level") * F.col("weight"), F.col("cap")))
    offset = (F.col("k") + 1) * F.lit(OFFSET_STEP)
    if seed:
        offset = offset + F.lit(seed * SEED_STEP)
    return (
        levels.withColumn("the_level", level)
        .withColumn("target", target)
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("offset", offset - F.floor(offset))
        .select("source", "source_size", "n_docs", "target", "ratio", "offset")
    )


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _copies(place: Column, most: float) -> Column:
    """Boundaries that the stretch of the document at ``place`` crosses; in exact numbers never more than ``most``, rounded up."""
    ends = [F.floor(p.cast("double") * F.col("ratio") + F.col("offset")) for p in (place, place - 1)]
    return F.least(ends[0] - ends[1], F.lit(math.ceil(most)))


def _placed(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    """doc_id, source, size, source_size, target, ratio, offset and place (from 1, in its source) of every row."""
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    sized = sized.withColumn("bucket", F.coalesce(F.pmod(F.col("doc_id"), F.lit(BUCKETS)), F.lit(0)).cast("int"))
    sized = settled(sized, "sizes")  # read five times below
    targets = source_targets(sized, weights, share, most, seed)
    # the places before each size of a source, each bucket of a size, each document of a bucket
    by_bucket = sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    by_size = by_bucket.groupBy("source", "size").agg(F.sum("n").alias("n"))

    def before(w):
        return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    size_place = by_size.select("source", "size", before(Window.partitionBy("source").orderBy("size")).alias("before_size"))
    bucket_place = by_bucket.select("source", "size", "bucket", before(Window.partitionBy("source", "size").orderBy("bucket")).alias("before_bucket"))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    places = bucket_place.join(size_place, same(bucket_place, size_place, "source", "size"), "left").select(bucket_place["*"], "before_size")
    # targets has one row for each source
    places = places.join(targets, places["source"].eqNullSafe(targets["source"]), "left").select(
        places["source"].alias("p_source"), places["size"].alias("p_size"), places["bucket"].alias("p_bucket"),
        (F.col("before_size") + F.col("before_bucket")).alias("before"), "source_size", "target", "ratio", "offset",
    )
    numbered = sized.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id")))
    placed = numbered.join(places, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("bucket") == F.col("p_bucket")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "ratio", "offset", (F.col("before") + F.col("nth")).alias("place"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 0
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row.

    size is the number of runs of bytes other than white space; null or empty text has size 0 and is placed first. Rows
    that repeat a doc_id are documents of their own; those of one source, size and doc_id tie and share their copies in
    no set order. A null source is a source, the last. A source of size 0 has target 0 and gets no copies. A null doc_id
    counts as bucket 0. An empty table gives no rows. Other columns are not looked at. The offsets follow from ``seed``
    and the source's rank alone, so reruns agree.
    """
    placed = _placed(docs, weights, share, most, text, doc_id, source, seed)
    return placed.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("place"), most).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 0
) -> DataFrame:
    """The rows of docs, with all their columns, each as many times as mix() takes it.

    Rows of one source, size and doc_id have places in a row in mix(); here they take them in order of their text's
    hash, each its own copies. Columns may have any names. Other cases as in mix().
    """
    placed = _placed(docs, weights, share, most, text, doc_id, source, seed)
    # keys without nulls: joined by equality, the rows lie as the numbering below wants them
    key = lambda i, s, n: [F.coalesce(i, F.lit(0)).alias("k_id"), i.isNull().alias("k_no_id"), F.coalesce(s, F.lit("")).alias("k_source"), s.isNull().alias("k_no_source"), n.alias("k_size")]
    names = ["k_id", "k_no_id", "k_source", "k_no_source", "k_size"]
    firsts = placed.groupBy(*key(F.col("doc_id"), F.col("source"), F.col("size"))).agg(F.min("place").alias("first"), F.first("ratio").alias("ratio"), F.first("offset").alias("offset"))
    rows = docs.select(F.struct("*").alias("all"), F.xxhash64(text).alias("r_hash"), *key(F.col(doc_id).cast("long"), F.col(source), word_count(text)))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("r_hash"))
    taken = rows.join(firsts, names).withColumn("copies", _copies(F.col("first") + nth - 1, most)).filter("copies > 0")
    return taken.select("all", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("all.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
weighed AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
caps AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][k % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM weighed),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
chosen AS (SELECT *, first_value(level) OVER (ORDER BY CASE WHEN level * weight <= cap THEN 0 ELSE 1 END, cap / weight, k) AS the_level FROM levels),
targets AS (SELECT source, source_size, least(cap, the_level * weight) AS target, ((k + 1) * 0.6180339887498949::DOUBLE) - floor((k + 1) * 0.6180339887498949::DOUBLE) AS shift FROM chosen),
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio, t.shift,
  row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id % 1024, s.doc_id)::DOUBLE AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(place * ratio + shift) - floor((place - 1) * ratio + shift), 2) * size)::BIGINT AS taken FROM placed
"""
