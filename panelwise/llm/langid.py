"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans of mixed text.

A word's score under a language is the log likelihood of its byte n-grams
(lower-cased, with word boundaries) in a hashed table of fixed width. Words of
a script that a language was never seen in rule that language out. A path
through the words pays a fixed penalty for every change of language; the best
path gives the spans, and the language with the most letters is the
document's.

Defined results: null texts and texts without a letter are ``und`` with score
0 and no spans; without any learned language everything is ``und``; documents
without a language take no part in learning; repeated rows count as often as
they occur; equal scores go to the language that sorts first; other columns,
whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm import words
from panelwise.llm.common import seeded, small_batches

BUCKETS = 1 << 15
GRAMS = (2, 3)
SWITCH = 12.0
BLOCK = 512
UNKNOWN = "und"
NOT_ITS_SCRIPT = -25.0

#: Anything that cannot be part of a word: ASCII except letters.
_BREAK = np.zeros(256, bool)
_BREAK[:0x80] = True
_BREAK[0x41:0x5B] = _BREAK[0x61:0x7B] = False

#: First and last code point of the scripts that are told apart; everything else counts as Latin.
SCRIPTS = {
    "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "armenian": (0x530, 0x58F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x77F),
    "devanagari": (0x900, 0x97F), "bengali": (0x980, 0x9FF), "tamil": (0xB80, 0xBFF), "thai": (0xE00, 0xE7F), "georgian": (0x10A0, 0x10FF),
    "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF),
}


def _scripts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script number (0: Latin and all others) of the first character of every word."""
    at = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    lead = at[starts]
    two = ((lead & 0x1F) << 6) | (at[starts + 1] & 0x3F)
    three = ((lead & 0x0F) << 12) | ((at[starts + 1] & 0x3F) << 6) | (at[starts + 2] & 0x3F)
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, 0)))
    out = np.zeros(len(starts), np.int64)
    for k, (low, high) in enumerate(SCRIPTS.values(), start=1):
        out[(point >= low) & (point <= high)] = k
    return out


def _grams(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: the word number and the bucket of every gram; a blank stands before and after each word."""
    flat = np.where(_BREAK[raw], np.uint8(0x20), raw)
    inside = flat != 0x20
    begin = np.zeros(len(raw), bool)
    begin[starts] = True
    # each word is laid out as blank, word, blank
    letters = np.flatnonzero(inside)
    word = np.cumsum(begin, dtype=np.int64)[letters] - 1
    place = np.arange(len(letters)) + 2 * word + 1
    laid = np.full(len(letters) + 2 * len(starts), 0x20, np.uint64)
    laid[place] = flat[letters]
    owner = np.full(len(laid), -1, np.int64)
    owner[place] = word
    first = place[np.concatenate([[True], word[1:] != word[:-1]])] if len(place) else place
    owner[first - 1] = word[np.concatenate([[True], word[1:] != word[:-1]])] if len(place) else word
    last = place[np.concatenate([word[1:] != word[:-1], [True]])] if len(place) else place
    owner[last + 1] = word[np.concatenate([word[1:] != word[:-1], [True]])] if len(place) else word
    for n in GRAMS:
        if len(laid) < n:
            continue
        key = np.full(len(laid) - n + 1, n, np.uint64)
        for j in range(n):
            key = (key << np.uint64(8)) | laid[j:len(laid) - n + 1 + j]
        whole = owner[:len(laid) - n + 1] == owner[n - 1:]
        bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        yield owner[:len(laid) - n + 1][whole], bucket[whole]


def _lowered(texts: pd.Series) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), ""))


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, log probabilities (bucket, language) and which script each language uses (script, language)."""

    languages: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def emissions(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Score of every word under every language, over windows of bounded size."""
        out = np.zeros((len(starts), len(self.languages)), np.float32)
        bounds = np.append(starts, len(raw))
        for a, b in words.pieces(bounds, 1 << 17):
            low, high = bounds[a], bounds[b]
            part, begin = raw[low:high], starts[a:b] - low
            for owner, bucket in _grams(part, begin):
                cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
                if len(owner):
                    out[a + owner[cut]] += np.add.reduceat(self.table[bucket], cut, axis=0)
            out[a:b] += np.where(self.allowed[_scripts(part, begin)], 0.0, NOT_ITS_SCRIPT).astype(np.float32)
        return out


def _forward(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, init: np.ndarray, penalty: float):
    """Viterbi over many blocks at once. ``init`` is (blocks, start states, languages); blocks come longest first."""
    state = init.copy()
    stay = np.zeros((int(length.sum()), *init.shape[1:]), bool)
    best = np.zeros((int(length.sum()), init.shape[1]), np.int16)
    row = np.concatenate([[0], np.cumsum(length)[:-1]])
    for t in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t, "left"))  # blocks longer than t
        now = state[:live]
        top = now.max(axis=2, keepdims=True) - penalty
        keep = now >= top
        stay[row[:live] + t], best[row[:live] + t] = keep, now.argmax(axis=2)
        state[:live] = np.where(keep, now, top) + scores[begin[:live] + t][:, None, :]
    return state, stay, best, row


def _backward(path: np.ndarray, begin: np.ndarray, length: np.ndarray, row: np.ndarray, stay: np.ndarray, best: np.ndarray,
              entry: np.ndarray, end: np.ndarray) -> None:
    """Fill ``path`` from the end states; blocks come longest first."""
    state, b = end.copy(), np.arange(len(length))
    for t in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        at, now, r = b[:live], state[:live], row[:live] + t
        path[begin[at] + t] = now
        state[:live] = np.where(stay[r, entry[:live], now], now, best[r, entry[:live]])


def decode(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH, block: int = BLOCK) -> np.ndarray:
    """Best language of every word. Text i has the words ``first[i]`` to ``first[i + 1]``.

    Long texts are cut into blocks; a block is solved for every state it may
    be entered in, and the blocks are joined afterwards, so the result is that
    of one pass over the whole text.
    """
    path = np.zeros(len(scores), np.int64)
    n, langs = np.diff(first), scores.shape[1]
    short = np.flatnonzero((n > 0) & (n <= block))
    short = short[np.argsort(-n[short], kind="stable")]
    if len(short):
        begin, length = first[short], n[short]
        state, stay, best, row = _forward(scores, begin, length, np.zeros((len(short), 1, langs), np.float32), penalty)
        _backward(path, begin, length, row, stay, best, np.zeros(len(short), np.int64), state[:, 0].argmax(axis=1))
    long = np.flatnonzero(n > block)
    if len(long):
        parts = -(-n[long] // block)
        base = np.concatenate([[0], np.cumsum(parts)])  # first block of each text
        nth = np.arange(base[-1]) - np.repeat(base[:-1], parts)
        begin = np.repeat(first[:-1][long], parts) + nth * block
        length = np.minimum(block, np.repeat(first[1:][long], parts) - begin)
        order = np.argsort(-length, kind="stable")
        init = np.tile(np.where(np.eye(langs, dtype=bool), np.float32(0), np.float32(-1e9)), (len(begin), 1, 1)).astype(np.float32)
        init[nth == 0] = 0
        state, stay, best, row = _forward(scores, begin[order], length[order], init[order], penalty)
        place = np.argsort(order)  # where each block went
        leave, enter = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        for low, high in zip(base[:-1], base[1:]):
            total, came = state[place[low], 0].astype(float), []
            for k in range(low + 1, high):
                both = total[:, None] + state[place[k]]
                came.append(both.argmax(axis=0))
                total = both.max(axis=0)
            leave[high - 1] = total.argmax()
            for k in range(high - 1, low, -1):
                enter[k] = leave[k - 1] = came[k - low - 1][leave[k]]
        _backward(path, begin[order], length[order], row, stay, best, enter[order], leave[order])
    return path


_RESULT = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()), T.StructField("lang", T.StringType())])))])


def _label(texts: pd.Series, model: LanguageModel, penalty: float) -> pd.DataFrame:
    raw, offsets = words.buffers(_lowered(texts))
    starts, first = words.split(raw, offsets, _BREAK)
    names = np.array(model.languages, object)
    path = decode(model.emissions(raw, starts), first, penalty)
    size = np.add.reduceat((~_BREAK[raw]).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    langs, scores, spans = [], [], []
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            langs.append(UNKNOWN), scores.append(0.0), spans.append([])
            continue
        share = np.bincount(path[a:b], weights=size[a:b], minlength=len(names))
        langs.append(names[share.argmax()]), scores.append(float(share.max() / share.sum()))
        cut = np.flatnonzero(np.diff(path[a:b])) + 1
        edges = [0, *cut.tolist(), int(b - a)]
        spans.append([{"first_word": x, "last_word": y - 1, "lang": names[path[a + x]]} for x, y in zip(edges[:-1], edges[1:])])
    return pd.DataFrame({"lang": langs, "score": scores, "spans": spans})


def identify(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "language", penalty: float = SWITCH) -> DataFrame:
    """Add ``out``: struct(lang, score, spans). The score is the language's share of the letters; spans count words of letters from 0."""
    small_batches(df.sparkSession)

    @F.pandas_udf(_RESULT)
    def label(texts: pd.Series) -> pd.DataFrame:
        return _label(texts, model, penalty)

    return df.withColumn(out, _with_letters(F.col(text), label(F.col(text)) if model.languages else F.lit(None).cast(_RESULT)))


def _with_letters(text: Column, found: Column) -> Column:
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.array().cast(_RESULT["spans"].dataType).alias("spans"))
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(letter & found.isNotNull(), found).otherwise(none)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", keys: tuple[str, ...] = ("doc_id",), bound: int = 4000,
          smooth: float = 0.5) -> LanguageModel:
    """Learn from at most about ``bound`` documents of each language, chosen by a hash of their keys.

    The driver gets one row per language and bucket that occurs.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, bound / n)))])
    picked = known.where(seeded(11, *[F.col(k) for k in keys]) < share[F.col(lang)]) \
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            texts = pc.utf8_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), ""))
            for name in set(names):
                raw, offsets = words.buffers(texts.filter(pa.array(names == name)))
                for a, b in words.pieces(offsets):
                    part = raw[offsets[a]:offsets[b]]
                    starts, _ = words.split(part, offsets[a:b + 1] - offsets[a], _BREAK)
                    total = totals.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
                    for _, bucket in _grams(part, starts):
                        total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(_scripts(part, starts), minlength=len(SCRIPTS) + 1)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(total[used])], ["lang", "bucket", "n"])

    counts = picked.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    full = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(names)))
    full[counts["bucket"].to_numpy(np.int64), pd.Categorical(counts["lang"], names).codes] = counts["n"]
    grams, scripts = full[:BUCKETS], full[BUCKETS:]
    table = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * BUCKETS)).astype(np.float32)
    allowed = scripts >= 0.005 * np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(list(names), table, allowed | ~allowed.any(axis=1, keepdims=True))
