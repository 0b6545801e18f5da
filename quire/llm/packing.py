"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every partition packs its own documents as they come: a document's remainder (what full windows leave over) goes to
the fill level that keeps the sum of squared counts of partly filled windows smallest, with the counts held in an array
of levels. Nothing is shuffled; a partition's memory is its open windows.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quire.llm._kernels import give_back, texts

#: Sequences of a partition, at most; sequence_id is partition * SPAN + number.
SPAN = 1 << 33
#: Open windows that a partition holds, at most: 128 MB of ids at 2048 a window. A partition of 100 MB of text makes no more.
OPEN_LIMIT = 16384
#: Distinct word forms whose ids a worker keeps.
CACHE_WORDS = 200_000
_WHITE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that aren't parted at every space, line end, stop and comma: white space beside white space, a stop or comma after no letter.
ODD = rf"[ \n]{_WHITE}|{_WHITE}[ \n]|^[ \n.,]|[ \n]$|[^\pL][.,]"


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts by a byte-level BPE file, as tokenizers gives them for each whole text.

    The file's pattern takes a single space between two non-spaces only at the start of a token, a single line end as a
    token, and starts a token at a stop or comma after a letter. There a text is parted into forms that can be encoded
    one by one; a batch's distinct forms are looked up once and their ids gathered with numpy. New forms are encoded together, as one text, and parted again where a token starts with a space:
    tiktoken does that with the ranks read from the same file, several times as fast as tokenizers, which still takes
    every form that the ranks alone don't settle (special tokens, white space at an edge).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True
        # the byte-level alphabet: printable bytes stand for themselves, the others, in order, for 256 and up
        plain = [b for b in range(256) if chr(b) in set(ByteLevel.alphabet())]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = int(self._plain("\n")[0])
        self.part = regex.compile(r"(?<=\S) (?=\S)")
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}  # of forms after a space
        self.heads: dict[str, int] = {}  # of first forms
        self.start, self.count, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint32), 0

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Stores forms' ids; the first slot."""
        n, m = len(counts), len(ids)
        while self.used + n > len(self.count):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.n_ids + m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids : self.n_ids + m] = ids
        self.start[self.used : self.used + n] = self.n_ids + np.cumsum(counts) - counts
        self.count[self.used : self.used + n] = counts
        self.used, self.n_ids = self.used + n, self.n_ids + m
        return self.used - n

    def _learn(self, forms: list[str]) -> None:
        """forms: as they follow a space, or from their line end, stop or comma on, or with the space where that is needed to tell."""
        easy = [f for f in forms if f and "<|" not in f and not f[-1].isspace()]
        spaced = [f for f in easy if f[0] not in "\n.," and " " not in f and not f[0].isspace()]
        lines = [f for f in easy if f[0] == "\n" and " " not in f and "\n" not in f[1:] and not f[1].isspace()]
        for some, text in ((spaced, " " + " ".join(spaced)), (lines, "".join(lines))):
            if some:
                ids = np.array(self.fast.encode_ordinary(text), np.uint32)
                cuts = np.flatnonzero(self.spaced[ids] if some is spaced else ids == self.line_end)
                if len(cuts) == len(some) and cuts[0] == 0:
                    slot = self._keep(ids, np.diff(np.append(cuts, len(ids))))
                    self.slots.update(zip(some, range(slot, slot + len(some)), strict=True))
        for f in forms:
            if f not in self.slots:
                ids = self._plain(f if f and f[0] in "\n., " else " " + f)
                self.slots[f] = self._keep(ids, np.array([len(ids)]))

    def _gather(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as lists of forms, and where each text's ids start, with the end."""
        offs = lists.offsets.to_numpy().astype(np.int64)
        offs, flat = offs - offs[0], lists.flatten()
        coded = flat.dictionary_encode()
        forms, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.slots) > CACHE_WORDS:
            self.clear()
        if new := [f for f in forms if f not in self.slots]:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, forms), np.int64, len(forms))[index]
        heads = offs[:-1][np.diff(offs) > 0]
        for at, f in zip(heads.tolist(), flat.take(pa.array(heads)).to_pylist(), strict=True):
            if f not in self.heads:
                ids = self._plain(f) if "<|" in f else np.array(self.fast.encode_ordinary(f), np.uint32)
                self.heads[f] = self._keep(ids, np.array([len(ids)]))
            slot[at] = self.heads[f]
        counts = self.count[slot].astype(np.int64)
        before = np.append(0, np.cumsum(counts))
        ids = self.ids[np.repeat(self.start[slot] - before[:-1], counts) + np.arange(before[-1])]
        return ids, before[offs]

    @staticmethod
    def _even(batch: pa.Array) -> pa.ListArray:
        for mark in "\n.,":
            batch = pc.replace_substring(batch, mark, f" {mark}")
        return pc.split_pattern(batch, " ")

    def _odd(self, batch: pa.Array) -> pa.ListArray:
        parted = (self.part.split(t) for t in batch.to_pylist())
        return pa.array([forms[:1] + [" " + f if f[:1] in ("\n", ".", ",") else f for f in forms[1:]] for forms in parted], pa.list_(pa.string()))

    def encode(self, batch: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column without nulls."""
        odd = np.asarray(pc.match_substring_regex(batch, ODD))
        out: list[np.ndarray] = [None] * len(batch)  # type: ignore[list-item]
        for rows, part in ((np.flatnonzero(~odd), self._even), (np.flatnonzero(odd), self._odd)):
            if len(rows):
                ids, at = self._gather(part(batch.take(pa.array(rows))))
                for k, row in enumerate(rows.tolist()):
                    out[row] = ids[at[k] : at[k + 1]]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class SumOfSquares:
    """Windows of one partition. levels[f]: number of open windows filled to f."""

    def __init__(self, size: int):
        self.size, self.next = size, 0
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(size + 1)]  # by level: (window, its pieces)
        self.n_open = 0

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def full(self, piece) -> tuple[int, list]:
        return self.number(), [piece]

    def place(self, length: int, piece) -> tuple[int, list] | None:
        """Puts a piece of length < size into a window; the window if that fills it."""
        n, size = self.levels, self.size
        # joining level h takes a window from h and adds one at h + length; a full window is no longer counted
        cost = 2 * n[length : size + 1] + 1  # h + length, for h from 0 to size - length
        cost[-1] = 0
        cost = cost - 2 * n[: size - length + 1] + 1
        cost[0] += 2 * n[0] - 1  # a new window takes nothing from a level
        allowed = n[: size - length + 1] > 0
        allowed[0] = True
        cost = np.where(allowed, cost, np.iinfo(np.int64).max)
        level = size - length - int(np.argmin(cost[::-1]))  # ties: the fuller window
        if level:
            window = self.open[level].pop()
            n[level] -= 1
            self.n_open -= 1
        else:
            window = self.number(), []
        window[1].append(piece)
        if level + length == size:
            return window
        self.open[level + length].append(window)
        n[level + length] += 1
        self.n_open += 1
        return None

    def close(self, split: Callable, keep: int = 0) -> Iterator[tuple[int, list]]:
        """Fills the fuller open windows with pieces cut from the emptiest ones and gives them back; keep windows stay."""
        rest = [(level, *w) for level in range(1, self.size) for w in self.open[level]]  # emptiest first
        low, high = 0, len(rest) - 1
        while low < high and high - low + 1 > keep:
            room = self.size - rest[high][0]
            target = rest[high][2]
            while room and low < high:
                level, window, pieces = rest[low]
                piece = pieces.pop()
                taken, left = split(piece, room)
                target.append(taken)
                room -= taken[1]
                if left is not None:
                    pieces.append(left)
                rest[low] = level - taken[1], window, pieces
                if not pieces:
                    low += 1
            if room:  # only the target is left
                rest[high] = self.size - room, rest[high][1], target
                break
            yield rest[high][1:]
            high -= 1
        left = rest[low : high + 1]
        self.levels[:] = 0
        self.open = [[] for _ in range(self.size + 1)]
        self.n_open = 0
        for level, window, pieces in left:
            if keep:
                self.open[level].append((window, pieces))
                self.levels[level] += 1
                self.n_open += 1
            else:
                yield window, pieces


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", open_limit: int = OPEN_LIMIT) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``size`` tokens.

    Columns: SCHEMA and ``ids`` (the piece's ids, little-endian unsigned 32-bit). A document is its ids followed by
    end_id; null or empty text is end_id alone. Cut where a window ends; each id is in exactly one piece. Rows that
    repeat a doc_id (or have none) are packed as documents of their own. An empty table gives no rows. Other columns
    are not looked at, whatever their names. Within a sequence pieces lie gapless from offset 0. A text of any length
    is cut into full windows as it is read. At its end a partition fills its open windows, the fullest first, with pieces
    cut from the emptiest, so that one at most stays partly filled; a partition that comes to hold more than
    ``open_limit`` open windows does so for the fuller half of them at once and packs on by the sum of squares. No id is
    left out either way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) * SPAN
        enc, packer = encoder(tokenizer), SumOfSquares(size)
        rows: list[tuple] = []

        def split(piece, room):
            doc, length, start, ids, total = piece
            if length <= room:
                return piece, None
            return (doc, room, start + length - room, ids[4 * (length - room) :], total), (doc, length - room, start, ids[: 4 * (length - room)], total)

        def done(window):
            number, pieces = window
            at = 0
            for doc, length, start, ids, total in pieces:
                rows.append((doc, start, length, zlib.crc32(ids), total, base + number, at, ids))
                at += length

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.binary()], strict=True)], names=[*(c.split()[0] for c in SCHEMA.split(", ")), "ids"])

        end = np.uint32(end_id).tobytes()
        for batch in batches:
            docs_of, values = batch.column(0), batch.column(1).fill_null("")
            for at, to, _, _ in texts(values):
                for doc, ids in zip(docs_of.slice(at, to - at).to_pylist(), enc.encode(values.slice(at, to - at)), strict=True):
                    ids = ids.tobytes() + end
                    total, start = len(ids) // 4, 0
                    while total - start >= size:
                        done(packer.full((doc, size, start, ids[4 * start : 4 * (start + size)], total)))
                        start += size
                    if start < total and (window := packer.place(total - start, (doc, total - start, start, ids[4 * start :], total))):
                        done(window)
                if packer.n_open > open_limit:
                    for window in packer.close(split, open_limit // 2):
                        done(window)
                if len(rows) >= 2000:
                    yield flush()
        for window in packer.close(split):
            done(window)
        yield flush()
        enc.clear()  # the worker may go on to other work
        give_back()

    from pyspark.sql import functions as F

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"{SCHEMA}, ids binary")


def padding(packed: DataFrame, size: int = 2048) -> DataFrame:
    """One row: sequences, tokens, padded tokens (to size, but none at a power of two)."""
    from pyspark.sql import functions as F

    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    powers = [1 << i for i in range(int(math.log2(size)) + 1)]
    return used.agg(
        F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.sum(F.when(F.col("used").isin(powers), 0).otherwise(size - F.col("used"))).alias("padding")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return packed.drop("ids")
