"""Importance resampling towards a target distribution of hashed n-gram features.

Texts of a batch are joined with a separator, one regex pass finds all words,
and a search of the documents' offsets tells which document a word is in, so
that n-grams across a border are masked before the buckets are counted. An
n-gram's CRC-32 comes from those of its words: CRCs are linear, so appending
a word of L bytes is one table lookup per byte of the CRC so far.

Two passes over the texts: bucket counts of the corpus and of the target, from
which each bucket gets an integer gain; then each document's weight, the sum
of the gains of its features. Adding Gumbel noise seeded by the id and taking
the highest scores draws without replacement in proportion to the weights.

Defined results: null and empty texts have no features and weight 0; repeated
rows count and are drawn like any other, equal scores to the smaller id, null
ids last; an empty corpus or target has counts of zero; other columns do not
take part.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm import words
from panelwise.llm.common import small_batches, stored

#: A word: a run of ASCII letters and digits and of all bytes of non-ASCII characters; A-Z are lower-cased before.
FEATURE_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 10_000
LONGEST_GRAM = 3
#: Between texts; no byte of a word.
SEPARATOR = b"\n"
#: Bytes of text that are joined at a time; a longer text is a batch of its own.
BATCH = 1 << 22
#: Words of a batch that are hashed at a time.
BLOCK = 1 << 18

_POLYNOMIAL = 0xEDB88320


@functools.cache
def _step_table() -> np.ndarray:
    """What one zero byte does to each low byte of a CRC."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


@functools.cache
def _shift_tables() -> np.ndarray:
    """(length, byte of the CRC, its value) -> its share of the CRC after ``length`` zero bytes, for lengths below 64."""
    step = _step_table()
    tables = np.empty((64, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << np.array([0, 8, 16, 24], np.uint32)[:, None]
    for n in range(1, 64):
        tables[n] = step[tables[n - 1] & 255] ^ (tables[n - 1] >> 8)
    return tables


def _shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC registers after as many zero bytes as ``sizes`` says."""
    tables, rest = _shift_tables(), sizes.astype(np.int64)
    while True:
        now = np.minimum(rest, 63)
        crc = tables[now, 0, crc & 255] ^ tables[now, 1, (crc >> 8) & 255] ^ tables[now, 2, (crc >> 16) & 255] ^ tables[now, 3, crc >> 24]
        rest = rest - now
        if not rest.any():
            return crc


def _long_shift(crc: int, size: int) -> int:
    """One CRC register after ``size`` zero bytes, by squaring the one-bit operator."""
    columns = [(1 << (i - 1)) if i else _POLYNOMIAL for i in range(32)]  # what one zero bit does to each bit
    bits = 8 * size
    while bits:
        if bits & 1:
            crc = functools.reduce(lambda x, y: x ^ y, (columns[i] for i in range(32) if crc >> i & 1), 0)
        columns = [functools.reduce(lambda x, y: x ^ y, (columns[i] for i in range(32) if c >> i & 1), 0) for c in columns]
        bits >>= 1
    return crc


def appended(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from those of their parts; ``sizes`` are the bytes of the right parts."""
    out = np.empty_like(left)
    short = sizes <= 4096
    out[short] = _shifted(left[short], sizes[short]) ^ right[short]
    for i in np.flatnonzero(~short):
        out[i] = _long_shift(int(left[i]), int(sizes[i])) ^ int(right[i])
    return out


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (document, CRC-32) of every run of 1 to ``LONGEST_GRAM`` consecutive words of the texts, repeats included.

    A block starts with the last words of the one before, so that no run is
    lost between them and a very long text takes no more memory than a block.
    """
    joined = SEPARATOR.join(texts).translate(words.LOWER.tobytes())
    offsets = np.cumsum([0] + [len(t) + len(SEPARATOR) for t in texts])
    matches = FEATURE_WORD.finditer(joined)
    carried = np.zeros((0, 3), np.int64)
    while found := [(m.start(), zlib.crc32(m[0]), m.end()) for m in itertools.islice(matches, BLOCK)]:
        table, old = np.concatenate([carried, np.array(found, np.int64)]), len(carried)
        carried = table[-(LONGEST_GRAM - 1):]
        starts, crc, sizes = table[:, 0], table[:, 1].astype(np.uint32), table[:, 2] - table[:, 0]
        doc = np.searchsorted(offsets, starts, "right") - 1
        # the word with a space before it: the CRC of the space carried over the word
        spaced = appended(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, sizes)
        docs, codes, last = [doc[old:]], [crc[old:]], crc
        for n in range(2, min(LONGEST_GRAM, len(doc)) + 1):
            last = appended(last[:-1], spaced[n - 1:], sizes[n - 1:] + 1)
            first = max(0, old - n + 1)  # earlier runs were in the block before
            inside = doc[first:-(n - 1)] == doc[first + n - 1:]
            docs.append(doc[first:-(n - 1)][inside])
            codes.append(last[first:][inside])
        yield np.concatenate(docs), np.concatenate(codes)


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``BATCH`` bytes, each with the place of its first text."""
    raw, offsets = words.buffers(texts)
    for a, b in words.pieces(offsets, BATCH):
        yield a, [raw[offsets[i]:offsets[i + 1]].tobytes() for i in range(a, b)]


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Every task counts its rows into one array; the driver gets one row per bucket."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _batches(batch.column(0)):
                for _, codes in grams(texts):
                    total += np.bincount(codes % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in df.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed frequencies, target over source, in thousandths, rounded down."""
    n = len(source)
    above, below = (target + 1.0) * (source.sum() + n), (source + 1.0) * (target.sum() + n)
    return np.floor(1000.0 * np.log(above / below)).astype(np.int64)


def weigh(df: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight``, the sum of the gains of all features."""
    small_batches(df.sparkSession)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def measured(texts: pa.Array) -> pa.Array:
        n_features, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, batch in _batches(texts):
            b = a + len(batch)
            for doc, code in grams(batch):
                n_features[a:b] += np.bincount(doc, minlength=len(batch))
                # sums of integers below 2^53 are exact in doubles
                weight[a:b] += np.bincount(doc, weights=gain[code % np.uint32(len(gain))], minlength=len(batch)).astype(np.int64)
        # n words have 3 n - 3 features, but 1 has 1 and none has none
        n_words = np.where(n_features > 1, n_features // LONGEST_GRAM + 1, n_features)
        return pa.StructArray.from_arrays([pa.array(x) for x in (n_words, n_features, weight)], ["n_words", "n_features", "weight"])

    return df.withColumn("_m", measured(F.col(text))).select(*df.columns, "_m.*")


def noise(key: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, score: str, tie: str, out: str = "rank") -> DataFrame:
    """Add ``out``: the place of every row by falling ``score``, then rising ``tie`` (null last).

    Rows are dealt out by ranges of the order and numbered inside their range;
    the sizes of the earlier ranges, one number each, are added. The ranges are
    sampled from the rows, and equal rows are told apart by a row number, so no
    score or key is a range of its own.
    """
    order = [F.desc(score), F.asc_nulls_last(tie), F.asc("_row")]
    cut = df.withColumn("_row", F.monotonically_increasing_id())
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = stored(cut.repartitionByRange(width, *order).sortWithinPartitions(*order)
                .withColumn("_place", F.monotonically_increasing_id()).drop("_row")
                .withColumn("_range", F.shiftright("_place", 33).cast("long")), "ranges")
    sizes = at.groupBy("_range").count().collect()  # one row per range, however many rows there are
    sizes = sorted((r["_range"], r["count"]) for r in sizes)
    starts = itertools.accumulate((n for _, n in sizes), initial=0)
    offsets = df.sparkSession.createDataFrame([(r, start) for (r, _), start in zip(sizes, starts)], "_range long, _before long")
    number = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return at.join(F.broadcast(offsets), "_range").withColumn(out, number.cast("long")).select(*df.columns, out)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20,
             buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; ``rank`` numbers the drawn ones from 1 and is null for the others.

    Drawn are ``percent`` percent (rounded down) of the documents with at
    least ``least_words`` words: those of highest score.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    scored = stored(weigh(rows, gain, "_text").drop("_text").withColumn("score", F.col("weight") + noise(F.col("_key"), seed)), "weights")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = ranked(able, "score", "_key").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(F.col("_key").alias(key), "n_features", "weight", "score", "rank")
