"""Language identification of mixed-language text.

A word's script, from ranges of code points, narrows the languages it may be of; hashed character n-grams give the word
a score in each of those. Viterbi over a text's words, with a penalty for every switch, labels spans of one language;
the document's language is that of most letters. Words are scored once for a batch, and the Viterbi steps of a batch's
texts are taken together, sorted by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quire.llm import _kernels as K

#: Labelled documents of each language that the scores are learned from, about: those whose ids hash lowest; all, if a
#: language has fewer.
SAMPLE_DOCS = 1500
#: Hash table of n-grams: log2 of its size, down to LEAST_BITS so that all languages' tables together hold MOST_CELLS
#: numbers at most (for more than MOST_CELLS / 2**LEAST_BITS languages: 2**LEAST_BITS each). N-grams of 1 to MOST_GRAM
#: characters, and whole words.
TABLE_BITS, LEAST_BITS, MOST_CELLS, MOST_GRAM = 18, 10, 1 << 24, 4
#: Cost of a switch, in the same nats as the scores; scores of one word lie within +-WORD_LIMIT.
SWITCH_PENALTY, WORD_LIMIT = 6.0, 8.0
#: A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 0.01
#: Words of distinct spelling that a worker keeps scores of, and scores that it keeps, at most.
CACHE_WORDS, CACHE_SCORES = 200_000, 8 << 20
#: A document's least mean score of a word in its language, in nats, at which identified() takes it for that language.
LEAST_EVIDENCE = 0.25
#: Words whose n-grams are taken at a time.
GRAM_WORDS = 20_000
UNKNOWN = "und"

#: First code point of each range and its script; a range ends where the next begins.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_FIRST = np.array([a for a, _ in SCRIPT_RANGES], np.int64)
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.int8)
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_HAS_LETTER = regex.compile(r"\p{L}")
#: White space by which texts are parted into words.
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def table_bits(n_langs: int) -> int:
    return max(LEAST_BITS, min(TABLE_BITS, (MOST_CELLS // max(1, n_langs)).bit_length() - 1))


def _grams(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word of each n-gram, its cell in the table), and each word's script and number of letters."""
    text = "".join("\x00" + w + "\x00" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    inside = codes != 0
    script = _SCRIPT[np.searchsorted(_FIRST, codes[inside].astype(np.int64), "right") - 1]
    votes = np.bincount(word[inside] * len(SCRIPTS) + script, minlength=len(words) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
    rows, cells = [], []
    value = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, MOST_GRAM + 1):
            value = (value[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            same = word[: len(value)] == word[n - 1 :]
            if n == 1:
                same &= inside
            rows.append(word[: len(value)][same])
            cells.append(((value[same] ^ (value[same] >> np.uint64(29))) >> np.uint64(64 - bits - 3)) & np.uint64((1 << bits) - 1))
    return np.concatenate(rows), np.concatenate(cells).astype(np.int64), votes.argmax(axis=1), lengths - 2


def _letters(token: str) -> str:
    return _NOT_LETTERS.sub("", token).lower()


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """First token of each text with the end, tokens' numbers, distinct tokens."""
    lists = pc.split_pattern_regex(column, _SPACE)
    offs = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return offs - offs[0], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _count(langs: list[str]):
    """Partial n-gram counts of a partition's texts, a row for each language and cell."""

    number, bits = {x: k for k, x in enumerate(langs)}, table_bits(len(langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), 1 << bits), np.float32)
        scripts = np.zeros((len(langs), len(SCRIPTS)), np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()])
            for at, to, _, _ in K.texts(batch.column(1)):
                offs, index, forms = _tokens(batch.column(1).slice(at, to - at).fill_null(""))
                of = np.repeat(lang[at:to], np.diff(offs))
                times = {k: np.bincount(index[of == k], minlength=len(forms)) for k in np.unique(of).tolist()}
                for a in range(0, len(forms), GRAM_WORDS):
                    row, cell, script, n = _grams([_letters(f) for f in forms[a : a + GRAM_WORDS]], bits)
                    for k, seen in times.items():
                        some = seen[a : a + GRAM_WORDS]
                        counts[k] += np.bincount(cell, some[row], 1 << bits).astype(np.float32)
                        scripts[k] += np.bincount(script, some * n, len(SCRIPTS)).astype(np.int64)
        for k in range(len(langs)):
            cells = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k, np.int32)), pa.array(cells), pa.array(counts[k][cells].astype(np.float64))], names=["lang", "cell", "n"])
            seen = np.flatnonzero(scripts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(-1 - seen), pa.array(scripts[k][seen].astype(np.float64))], names=["lang", "cell", "n"])

    return run


class Model:
    """scores[c, l]: log odds of cell c in language l against the others; allowed[s, l]: whether script s is written in l."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        rates = (counts + 0.25) / (counts.sum(axis=1, keepdims=True) + 0.25 * counts.shape[1])
        logs = np.log(rates)
        self.scores = (logs - logs.mean(axis=0)).T.astype(np.float32) if langs else np.zeros((counts.shape[1], 0), np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = (share >= SCRIPT_SHARE).T
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return {"langs": self.langs, "scores": self.scores, "allowed": self.allowed, "cache": {}}

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each word, and its number of letters. Languages that its script rules out get -WORD_LIMIT."""
        parts = [self._some_scores(words[a : a + GRAM_WORDS]) for a in range(0, len(words), GRAM_WORDS)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _some_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        row, cell, script, n = _grams(words, self.scores.shape[0].bit_length() - 1)
        out = np.stack([np.bincount(row, self.scores[cell, k], len(words)) for k in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(words), 0))
        # an n-gram overlaps with others, so their sum says too much
        out = np.clip(out / MOST_GRAM, -WORD_LIMIT, WORD_LIMIT)
        may = self.allowed[script]
        out = np.where(may | ~may.any(axis=1, keepdims=True), out, -WORD_LIMIT)
        out[n == 0] = 0
        return out.astype(np.float32), n


def viterbi(scores: np.ndarray, offs: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; scores: (words, labels), offs: first word of each text with the end. Ties stay, or go to the first label."""
    lengths, n_labels = np.diff(offs), scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        # texts of about one length, so that few steps are taken for a few long ones
        to = at + max(1, int(np.searchsorted(-lengths[order[at:]], -(lengths[order[at]] // 2), "right")))
        some = order[at : min(to, at + 2048)]
        at += len(some)
        first, n = offs[:-1][some], lengths[some]
        best = scores[first].copy()
        steps = int(n[0])
        switched = np.zeros((steps, len(some), n_labels), bool)
        leader = np.zeros((steps, len(some)), np.int16)
        live = len(some)
        for t in range(1, steps):
            while n[live - 1] <= t:
                live -= 1
            now = best[:live]
            lead = now.argmax(axis=1)
            top = now[np.arange(live), lead][:, None] - penalty
            away = top > now
            switched[t, :live], leader[t, :live] = away, lead
            best[:live] = np.where(away, top, now) + scores[first[:live] + t]
            if t % 256 == 0:
                best[:live] -= best[:live].max(axis=1, keepdims=True)
        label = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            while live < len(some) and n[live] > t:
                live += 1
            labels[first[:live] + t] = label[:live]
            label[:live] = np.where(switched[t, np.arange(live), label[:live]], leader[t, :live], label[:live])
    return labels


def _label(model_of, penalty: float, spans: bool):
    """Batches: id, text, and columns to hand on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_of.value
        n_labels = len(model.langs)
        known = model.cache
        if not hasattr(model, "table"):
            model.table, model.sizes = np.zeros((0, n_labels), np.float32), np.zeros(0, np.int64)
        for batch in batches:
            for at, to, _, _ in K.texts(batch.column(1)):
                ids, column = batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at).fill_null("")
                offs, index, forms = _tokens(column)
                if len(known) > min(CACHE_WORDS, CACHE_SCORES // max(1, n_labels)):
                    known.clear()
                    model.table, model.sizes = np.zeros((0, n_labels), np.float32), np.zeros(0, np.int64)
                if new := [f for f in forms if f not in known]:
                    scores, n = model.word_scores([_letters(f) for f in new])
                    n = np.where(n > 0, [n_ if _HAS_LETTER.search(f) else 0 for n_, f in zip(n.tolist(), new, strict=True)], 0)
                    known.update(zip(new, range(len(model.table), len(model.table) + len(new)), strict=True))
                    model.table, model.sizes = np.concatenate([model.table, scores]), np.concatenate([model.sizes, n])
                slot = np.array([known[f] for f in forms], np.int64)[index]
                sizes = model.sizes[slot]
                # words without letters say nothing and take the label around them
                says = np.flatnonzero(sizes > 0)
                text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[says]
                cuts = np.searchsorted(text, np.arange(len(offs)))
                labels = viterbi(model.table[slot[says]], cuts, penalty) if n_labels else np.zeros(len(says), np.int16)
                weight = np.bincount(text * max(1, n_labels) + labels, sizes[says], len(column) * max(1, n_labels)).reshape(len(column), -1)
                total = weight.sum(axis=1)
                known_lang = (total > 0) & bool(n_labels)
                pick = weight.argmax(axis=1)
                score = np.where(known_lang, weight.max(axis=1) / np.maximum(total, 1), 0.0)
                gained = model.table[slot[says], labels] if n_labels else np.zeros(len(says))
                evidence = np.bincount(text, gained, len(column)) / np.maximum(np.bincount(text, minlength=len(column)), 1)
                columns = [ids, pa.array([model.langs[p] if k else UNKNOWN for p, k in zip(pick.tolist(), known_lang.tolist(), strict=True)], pa.string()), pa.array(score), pa.array(evidence)]
                names = ["doc_id", "lang_pred", "score", "evidence"]
                if spans:
                    turn = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (labels[1:] != labels[:-1])) if len(says) else np.zeros(0, bool))
                    word = says - offs[text]
                    last = np.append(turn[1:], len(says)) - 1
                    lists: list[list] = [[] for _ in range(len(column))]
                    for a, b in zip(turn.tolist(), last.tolist(), strict=True) if n_labels else ():
                        lists[text[a]].append({"lang": model.langs[labels[a]], "first_word": int(word[a]), "last_word": int(word[b])})
                    columns.append(pa.array(lists, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))))
                    names.append("spans")
                for k in range(2, batch.num_columns):
                    columns.append(batch.column(k).slice(at, to - at))
                    names.append(batch.schema.names[k])
                yield pa.RecordBatch.from_arrays(columns, names=names)
        known.clear()  # the worker may go on to other work
        model.table, model.sizes = np.zeros((0, n_labels), np.float32), np.zeros(0, np.int64)
        K.give_back()

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Model:
    """Learns from text and lang of rows that have both and aren't held out: of each language that any such row has, about ``sample`` of them.

    A row is taken if its id's hash lies below the share that its language's rows leave for ``sample``, so every
    language is learned, however rare, without a sort.
    """
    labelled = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    whole = 1 << 31
    found = sorted(tuple(r) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row for each language
    langs = [x for x, _ in found]
    bits = table_bits(len(langs))
    counts, scripts = np.zeros((len(langs), 1 << bits)), np.zeros((len(langs), len(SCRIPTS)))
    if langs:
        shares = docs.sparkSession.createDataFrame([(x, whole if n <= sample else max(1, whole * sample // n)) for x, n in found], "of string, share long")
        hashed = F.pmod(F.xxhash64("id"), F.lit(whole))
        rows = labelled.join(F.broadcast(shares), F.col("lang") == F.col("of")).filter(hashed < F.col("share")).select("lang", "text")
        # a table of fixed size for each language
        table = rows.mapInArrow(_count(langs), "lang int, cell long, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
        k, cell, n = (np.asarray(table.column(c)) for c in ("lang", "cell", "n"))
        counts[k[cell >= 0], cell[cell >= 0]] = n[cell >= 0]
        scripts[k[cell < 0], -1 - cell[cell < 0]] = n[cell < 0]
    return Model(langs, counts, scripts)


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", penalty: float = SWITCH_PENALTY, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, evidence and, if asked for, spans (lang, first and last word) of every row.

    lang_pred is the language of most letters, ties to the first in code point order; score is that share; evidence is
    the mean score of the words with letters, each in the language of its span. Null texts, texts without a letter, and
    any text if nothing was learned, get ``und`` with score and evidence 0 and no spans. Words without a letter belong to
    the span around them. Rows that repeat a doc_id, or have none, are judged each by its own text. An empty table gives
    no rows. Texts of any length are labelled whole. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_CELLS scores at most, or 2**LEAST_BITS for each language
    schema = "doc_id long, lang_pred string, score double, evidence double" + ", spans array<struct<lang: string, first_word: long, last_word: long>>" * spans
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_label(shared, penalty, spans), schema)


def identified(docs: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH_PENALTY, least: float = LEAST_EVIDENCE) -> DataFrame:
    """The rows of docs, with all their columns, whose language identify() can tell: a learned one, with evidence of ``least`` or more.

    Texts of letters that make no words of a learned language have evidence about 0 and go, as do null and blank texts
    and those without a letter. If nothing was learned there is nothing to go by, and all rows with a letter stay. An
    empty table gives no rows. Columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.col(text).alias("t"), F.struct("*").alias("row"))
    if not model.langs:
        return rows.filter(F.col("t").rlike(r"\p{L}")).select("row.*")
    schema = StructType([StructField("doc_id", LongType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("evidence", DoubleType()), rows.schema["row"]])
    return rows.mapInArrow(_label(shared, penalty, False), schema).filter((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= least)).select("row.*")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs), spans=False).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
