"""Quality scores by compression.

Two zstandard dictionaries are built from good and from bad labelled texts. A text like the good ones gets shorter with
the good dictionary; the difference of the two sizes over the text's length becomes a probability by a logistic curve,
fitted to labelled texts that the dictionaries have not seen. The curve weighs the two sizes each on its own: text that
says the same over and over is short with either dictionary, and its small difference means less (the README has what
this gains over one weight for both).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled texts of each class that are learned from, at most (lowest id hashes).
SAMPLE_DOCS = 1000
#: Bytes of a dictionary, the compression level, and bytes that are compressed at a time: in short blocks the dictionary
#: counts for more than what the text itself has said before. Dictionaries see texts in such blocks too.
DICT_BYTES, LEVEL, BLOCK = 112 << 10, 3, 1024
#: One of so many sampled texts is kept from the dictionaries, for the curve.
FITTED = 4
#: Blocks of a text that are learned from, at most, evenly spread over it; with SAMPLE_DOCS this bounds what the driver
#: holds. Scores are of whole texts.
TEXT_BLOCKS = 64
THRESHOLD = 0.3


class Model:
    """dicts: good and bad dictionary, as bytes; weights: of the difference, of the size with the good dictionary, and a constant."""

    def __init__(self, dicts: list[bytes], weights: np.ndarray):
        self.dicts, self.weights = dicts, weights
        self._ready: list | None = None

    def __getstate__(self):
        return {"dicts": self.dicts, "weights": self.weights, "_ready": None}

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Of each text the size with the bad dictionary less that with the good one, and the latter, over the length; 0 for an empty text."""
        if self._ready is None:
            self._ready = []
            for d in self.dicts:
                held = zstandard.ZstdCompressionDict(d)
                held.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_dict_id=False, write_checksum=False, write_content_size=False))
        out = np.zeros((len(texts), 2))
        good, bad = self._ready
        for i, t in enumerate(texts):
            if t:
                view, g, b = memoryview(t), 0, 0
                for at in range(0, len(t), BLOCK):
                    block = view[at : at + BLOCK]
                    g += len(good.compress(block))
                    b += len(bad.compress(block))
                out[i] = (b - g) / len(t), g / len(t)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.features(texts) @ self.weights[:-1] + self.weights[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the features and a constant of a logistic curve, by Newton's steps, with a small penalty in the features' own scale."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1e-2), 1e-6)
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _spread(text: str) -> Column:
    """The text, or if it is longer than TEXT_BLOCKS blocks so many of them from all over it."""
    step = F.length(text) / TEXT_BLOCKS
    parts = F.transform(F.sequence(F.lit(0), F.lit(TEXT_BLOCKS - 1)), lambda i: F.substr(F.col(text), F.floor(i * step).cast("int") + 1, F.lit(BLOCK)))
    return F.when(F.length(text) <= BLOCK * TEXT_BLOCKS, F.col(text)).otherwise(F.array_join(parts, ""))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE_DOCS) -> Model:
    """Learns from rows with text and a label of 0 or 1 that aren't held out: ``sample`` of each label at most, by hash of the id, and of a text's blocks no more than TEXT_BLOCKS.

    One of FITTED fits the probabilities, weighed by how often each label occurs, the others fill the dictionaries. With a label missing, every score is the share of good ones, or a half. Rows that repeat an id count once for each.
    """
    marks = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out("id") & F.col("id").isNotNull())
    shares = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    rows: dict[int, list[bytes]] = {}
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    for k in (0, 1):
        chosen = marks.filter(F.col("label") == k).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
        held = source.join(F.broadcast(chosen), "id").select("id", _spread("text").alias("text"))
        found = held.orderBy(F.xxhash64("id"), "id", "text").limit(sample).collect()  # ``sample`` texts of TEXT_BLOCKS blocks
        rows[k] = [r["text"].encode() for r in found]
    total = sum(shares.values())
    if min(len(rows[0]), len(rows[1])) < 4:
        share = shares.get(1, 0) / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model([b" " * 8] * 2, np.array([0.0, 0.0, np.log(share / (1 - share))]))
    unseen = [rows[k][::FITTED] for k in (0, 1)]
    model = Model([_dictionary([t for i, t in enumerate(rows[k]) if i % FITTED]) for k in (1, 0)], np.zeros(3))
    x = model.features([t for texts in unseen for t in texts])
    y = np.concatenate([np.full(len(texts), k) for k, texts in enumerate(unseen)])
    weight = np.array([shares[k] / len(unseen[k]) for k in (0, 1)])[y]
    model.weights = _fit(x, y, weight * len(y) / weight.sum())
    return model


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts' blocks; the blocks themselves where there are too few for zstandard to choose from."""
    blocks = [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICT_BYTES:].rjust(8)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 from THRESHOLD on) of every row.

    Null text is empty text, whose sizes are 0. Rows that repeat a doc_id, or have none, are scored each by its
    own text. An empty table gives no rows. Whole texts are compressed, whatever their length. Other columns are not
    looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores([(t or "").encode() for t in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
