"""Counts of terms per row, dealt out by term.

A block has some of the terms and all rows in which they occur, so what is said of a term (its document frequency, its
deviation, its coefficient) is made and used in the block's task, and no dictionary is gathered. What is added up over
blocks has a number per row. Rows are numbered: the known ones first, then those that are asked about.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.ordering import parts_for
from panelwise.session import table_path

#: Characters of text, or entries, of which one block has the terms.
BLOCK_CHARS, BLOCK_ENTRIES = 4_000_000, 1_000_000
#: Words that are counted at a time.
SLICE_WORDS = 500_000
#: Numbers in one piece of a sum, and bytes of all tasks' sums beyond which tasks add them up before the driver does.
PIECE, SENT = 1 << 20, 64 << 20

#: Blocks that a task is sent at a time.
BLOCKS_SENT = 2

_PACK = "part int, terms array<string>, starts binary, rows binary, counts binary"
_SIDES = ("known", "asked")
_BLOCK = "part int, terms array<string>, total binary, squares binary, " + ", ".join(f"{s}_starts binary, {s}_rows binary, {s}_counts binary" for s in _SIDES)


def _ints(column, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.int32)


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All members of a column of lists and the length of each list, 0 for null."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _packs(terms: pa.Array, codes: np.ndarray, rows: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row per part with its terms and their entries; ``codes`` are those of ``terms``, ascending."""
    of = np.array([zlib.crc32(t) % parts for t in terms.cast(pa.binary()).to_pylist()], np.int64)
    order = np.argsort(of, kind="stable")
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of))
    inner = np.argsort(place[codes], kind="stable")
    starts = _starts(np.bincount(place[codes], minlength=len(of)))
    rows, counts, terms = rows[inner].astype(np.int32), counts[inner].astype(np.int32), terms.take(pa.array(order))
    found, first = np.unique(of[order], return_index=True)
    cut = [*first, len(of)]
    out = []
    for part, a, b in zip(found, cut, cut[1:]):
        s, e = starts[a], starts[b]
        out.append((int(part), terms.slice(a, b - a), (starts[a:b + 1] - s).tobytes(), rows[s:e].tobytes(), counts[s:e].tobytes()))
    flat = pa.concat_arrays([x[1] for x in out]) if out else pa.array([], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(_starts(np.array([len(x[1]) for x in out], np.int64))), flat)
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), lists, *[pa.array([x[i] for x in out], pa.binary()) for i in (2, 3, 4)]],
                                      ["part", "terms", "starts", "rows", "counts"])


def _counted(words: pa.Array, sizes: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words and bigrams of some rows: distinct terms, and term, row and count of each entry."""
    owner = np.repeat(np.arange(len(rows)), sizes)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    both = pc.binary_join_element_wise(words.take(pa.array(pair)), words.take(pa.array(pair + 1)), " ")
    terms = pa.concat_arrays([words, both]).dictionary_encode()
    key, counts = np.unique(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(rows)) + np.concatenate([owner, owner[pair]]), return_counts=True)
    codes, local = np.divmod(key, max(1, len(rows)))
    return terms.dictionary, codes, rows[local], counts


@dataclass
class Block:
    """Some terms with the entries of known rows (and of asked ones), grouped by term."""

    batch: pa.RecordBatch
    i: int
    known: int
    asked: int

    def __getattr__(self, name: str) -> np.ndarray:
        side, _, what = name.partition("_")
        if side not in _SIDES or what not in ("starts", "rows", "counts"):
            raise AttributeError(name)
        return _ints(self.batch.column(name), self.i)

    @property
    def part(self) -> int:
        return self.batch.column("part")[self.i].as_py()

    @cached_property
    def terms(self) -> list[str]:
        return self.batch.column("terms")[self.i].as_py()

    @cached_property
    def frequency(self) -> np.ndarray:
        """Known rows that have the term."""
        return np.diff(self.known_starts).astype(float)

    @cached_property
    def idf(self) -> np.ndarray:
        return np.log((self.known + 1.0) / (self.frequency + 1.0))

    @cached_property
    def total(self) -> np.ndarray:
        """Sum of the counts of known rows, by term."""
        return np.frombuffer(self.batch.column("total")[self.i].as_buffer())

    @cached_property
    def scale(self) -> np.ndarray:
        """One over the deviation of a term's counts, 0 for a term without any or without weight. Counts times idf over their deviation are counts over that of counts."""
        n = self.known
        spread = n * np.frombuffer(self.batch.column("squares")[self.i].as_buffer()) - self.total * self.total
        return np.where((spread > 0) & (self.idf > 0), np.sqrt(n * max(1.0, n - 1.0) / np.where(spread > 0, spread, 1.0)), 0.0)

    def by_term(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(float), self.known_starts[:-1]) if len(values) else np.zeros(len(self.known_starts) - 1)

    def gathered(self, a: np.ndarray) -> np.ndarray:
        """The transposed standardised matrix of the known rows times ``a``: exact zeros for whole numbers that cancel."""
        return self.scale * (self.by_term(self.known_counts * a[self.known_rows]) - self.total * a.sum() / self.known)

    def spread(self, v: np.ndarray, side: str = "known") -> np.ndarray:
        """The standardised matrix of the rows times ``v``."""
        v = self.scale * v
        return self.counted(v, side) - float(self.total @ v) / self.known

    def counted(self, v: np.ndarray, side: str) -> np.ndarray:
        """The counts of the rows times ``v``."""
        starts, rows, counts = (getattr(self, f"{side}_{x}") for x in ("starts", "rows", "counts"))
        return np.bincount(rows, weights=counts * np.repeat(v, np.diff(starts)), minlength=getattr(self, side)).astype(float)


@contextmanager
def blocks_sent(spark: SparkSession) -> Iterator[None]:
    """Tasks that run meanwhile get a few blocks at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BLOCKS_SENT)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class TermTable:
    """``blocks`` as a written table; numbers of known rows, asked rows and terms."""

    blocks: DataFrame
    known: int
    asked: int
    terms: int
    parts: int

    @property
    def tasks(self) -> int:
        """Each task makes one sum, with a number per row: their number follows from the cores, not from the rows."""
        return min(self.parts, 2 * self.blocks.sparkSession.sparkContext.defaultParallelism)

    def each(self, give: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str, sides: tuple[str, ...] = ("known",), terms: bool = False) -> DataFrame:
        """What ``give`` makes of the blocks of each task; to be run within ``blocks_sent``."""
        known, asked = self.known, self.asked
        columns = ["part", *["terms"] * terms, "total", "squares", *[f"{s}_{x}" for s in sides for x in ("starts", "rows", "counts")]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from give(Block(batch, i, known, asked) for batch in batches for i in range(batch.num_rows))
        return self.blocks.select(*columns).coalesce(self.tasks).mapInArrow(run, schema)

    def sums(self, give: Callable[[Block], list[np.ndarray]], shapes: list[tuple[int, ...]], sides: tuple[str, ...] = ("known",)) -> list[np.ndarray]:
        """Sums over all blocks of the arrays of these shapes that ``give`` makes of one."""
        def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            total = None
            for block in blocks:
                own = give(block)
                total = own if total is None else [a + b for a, b in zip(total, own)]
            for k, values in enumerate(total or []):
                flat = np.ascontiguousarray(values, float).ravel()
                for at in range(0, len(flat), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([flat[at:at + PIECE].tobytes()], pa.binary())], ["which", "at", "numbers"])

        def add(pieces: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer()) for x in pieces.column("numbers"))
            return pieces.slice(0, 1).set_column(2, "numbers", pa.array([total.tobytes()], pa.binary()))
        schema = "which int, at long, numbers binary"
        found = self.each(run, schema, sides)
        if self.tasks * sum(8 * int(np.prod(s)) for s in shapes) > SENT:
            found = found.groupBy("which", "at").applyInArrow(add, schema)
        out = [np.zeros(int(np.prod(s))) for s in shapes]
        with blocks_sent(self.blocks.sparkSession):
            rows = found.toArrow().to_pylist()
        for row in rows:
            piece = np.frombuffer(row["numbers"])
            out[row["which"]][row["at"]:row["at"] + len(piece)] += piece
        return [x.reshape(s) for x, s in zip(out, shapes)]


def _table(packs: DataFrame, known: int, asked: int, parts: int, min_df: int) -> TermTable:
    """Blocks of the terms that at least ``min_df`` known rows have."""
    def merge(pieces: pa.Table) -> pa.Table:
        words, sizes, rows, counts = [], [], [], []
        for batch in pieces.to_batches():
            words.append(_flat(batch.column("terms"))[0])
            for i in range(batch.num_rows):
                sizes.append(np.diff(_ints(batch.column("starts"), i)))
                rows.append(_ints(batch.column("rows"), i))
                counts.append(_ints(batch.column("counts"), i))
        terms = pa.concat_arrays(words).dictionary_encode()
        codes = np.repeat(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(sizes))
        rows, counts = np.concatenate(rows), np.concatenate(counts)
        order = np.argsort(codes * (known + asked) + rows)
        codes, rows, counts = codes[order], rows[order], counts[order]
        keep = np.bincount(codes[rows < known], minlength=len(terms.dictionary)) >= max(1, min_df)
        place = np.cumsum(keep) - 1
        some = keep[codes]
        codes, rows, counts = place[codes[some]], rows[some], counts[some]
        own, several = codes[rows < known], counts[rows < known].astype(float)
        out = [pieces.column("part")[0].as_py(), terms.dictionary.filter(pa.array(keep)).to_pylist(),
               *[np.bincount(own, weights=x, minlength=int(keep.sum())).astype(float).tobytes() for x in (several, several * several)]]
        for side, first in ((rows < known, 0), (rows >= known, known)):
            out += [_starts(np.bincount(codes[side], minlength=int(keep.sum()))).tobytes(), (rows[side] - first).astype(np.int32).tobytes(), counts[side].tobytes()]
        kinds = [pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 8]
        names = ["part", "terms", "total", "squares", *[f"{s}_{x}" for s in _SIDES for x in ("starts", "rows", "counts")]]
        return pa.table([pa.array([x], k) for x, k in zip(out, kinds)], names).slice(0, int(keep.any()))
    blocks = packs.repartition(parts, "part").groupBy("part").applyInArrow(merge, _BLOCK)
    path = table_path(packs.sparkSession, "term-blocks")
    blocks.write.option("maxRecordsPerFile", 1).parquet(path)
    table = packs.sparkSession.read.schema(blocks.schema).parquet(path)
    return TermTable(table, known, asked, table.agg(F.sum(F.size("terms"))).first()[0] or 0, parts)


def _numbers(known: np.ndarray, asked: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Numbers of the rows with these ids."""
    ids = np.concatenate([known, asked])
    order = np.argsort(ids)
    ids = ids[order]
    return lambda rows: order[np.searchsorted(ids, rows)]


def from_words(words: DataFrame, known: np.ndarray, asked: np.ndarray, chars: int, min_df: int) -> TermTable:
    """Words and bigrams of (row, words); ``known`` and ``asked`` have the ids of all rows, ``chars`` is the length of all texts."""
    parts = parts_for(chars, BLOCK_CHARS)
    number = words.sparkSession.sparkContext.broadcast((known, asked))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _numbers(*number.value)
        for batch in batches:
            flat, sizes = _flat(batch.column(1))
            rows, ends = of(batch.column(0).to_numpy(zero_copy_only=False)), np.cumsum(sizes)
            i = 0
            while i < len(rows):
                before = int(ends[i] - sizes[i])
                j = max(i + 1, int(np.searchsorted(ends, before + SLICE_WORDS, "right")))
                yield _packs(*_counted(flat.slice(before, int(ends[j - 1]) - before), sizes[i:j], rows[i:j]), parts)
                pa.default_memory_pool().release_unused()
                i = j
    return _table(words.mapInArrow(count, _PACK), len(known), len(asked), parts, min_df)


def from_entries(entries: DataFrame, known: np.ndarray) -> TermTable:
    """The terms of (row, term, n); ``known`` has the ids of all rows."""
    parts = parts_for(entries.count(), BLOCK_ENTRIES)
    number = entries.sparkSession.sparkContext.broadcast((known, known[:0]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _numbers(*number.value)
        for batch in batches:
            terms = batch.column(1).dictionary_encode()
            codes = terms.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            yield _packs(terms.dictionary, codes[order], of(batch.column(0).to_numpy(zero_copy_only=False)[order]), batch.column(2).to_numpy(zero_copy_only=False)[order], parts)
    return _table(entries.select("row", "term", "n").mapInArrow(pack, _PACK), len(known), 0, parts, 1)
