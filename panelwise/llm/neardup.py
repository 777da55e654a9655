"""MinHash near-duplicates with odd sketches.

Each document is the set of its distinct word shingles. Equal sets are one
class first. MinHash samples of a class are (a) banded into buckets that
propose candidates and (b) folded into a parity bitmap, the odd sketch: the
population count of the XOR of two bitmaps estimates how many samples differ,
precisely where similarities are high. Candidates whose estimate is far below
the threshold are dropped, all others are confirmed on their full sets.

A bucket never yields all its pairs. Its members are first compared with one
pivot, another in every band; links make components; then only members of
different components of the same bucket are compared, smaller components
against the rest; inside a large family (connected by plausible pairs) tile by
tile, without a row per pair. Pairs inside a component are not needed to know
the components, so no link between documents that share a bucket is lost,
whatever the bucket's size.

With 32 bands of 4 rows a pair of similarity 0.8 shares a bucket with
probability 1 - 5e-8; the sketch cut (an estimate of 0.62) lies five standard
deviations below the threshold.

Defined results: documents without words have size 0 and are a component of
their own; fewer words than a shingle are one shingle; rows with equal ids are
one node; rows with a null id follow their equal texts, else they have no
component; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm import words
from panelwise.llm.common import small_batches, stored
from panelwise.operators.graph import connected_components

#: All samples are folded into the sketch; the first BANDS * ROWS of them are banded.
SAMPLES, BANDS, ROWS, BITS = 256, 32, 4, 1024
CUT = 0.62
#: Families of more classes than ``FAMILY`` are compared in tiles of about ``TILE`` sets; up to ``BROADCAST_IDS`` ids (8 bytes each) are sent to every task.
FAMILY, TILE, BROADCAST_IDS = 96, 256, 2_000_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_FIRST, _SECOND, _THIRD = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    raw, offsets = words.buffers(texts)
    for a, b in words.pieces(offsets):
        part = raw[offsets[a]:offsets[b]]
        starts, first = words.split(part, offsets[a:b + 1] - offsets[a])
        code = words.hashes(part, starts)
        for low, high in zip(first[:-1], first[1:]):
            own = code[low:high]
            size = min(width, len(own))
            if not size:
                yield own
                continue
            key = np.full(len(own) - size + 1, size, np.uint64)
            for j in range(size):
                key = words.mix(key * _FIRST + own[j:len(own) - size + 1 + j] * _SECOND + _THIRD)
            key.sort()
            yield key[np.concatenate([[True], key[1:] != key[:-1]])]


def minhash(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of a set under each of ``SAMPLES`` permutations of 32 bits."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), 2048):
        least = np.minimum(least, (_A[:, None] * short[None, k:k + 2048] + _B[:, None]).min(axis=1))
    return least


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of ``BITS`` bits as int64 words: sample i with value m flips bit hash(i, m)."""
    place = words.mix(samples.astype(np.uint64) * _FIRST + np.arange(SAMPLES, dtype=np.uint64) * _SECOND) % np.uint64(BITS)
    at = place.astype(np.int64) + BITS * np.arange(len(samples))[:, None]
    odd = np.bincount(at.ravel(), minlength=BITS * len(samples)).reshape(len(samples), BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(samples), 1))
    for j in range(ROWS):
        key = words.mix(key * _FIRST + samples[:, j:BANDS * ROWS:ROWS].astype(np.uint64) * _SECOND + _THIRD)
    return key.view(np.int64)


def most_different_bits(cut: float) -> int:
    """Largest XOR population count whose similarity estimate is still ``cut``."""
    return int(np.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - cut)))))


def _lists(rows: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    """A list per row, empty where ``keep`` is false."""
    size = np.where(keep, rows.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(rows[keep].ravel(), pa.int64()))


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, f1, f2, bands, odd): set size, a 128-bit fingerprint of the set, bucket keys and odd sketch; one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2 = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            samples = np.zeros((batch.num_rows, SAMPLES), np.uint32)
            for i, own in enumerate(shingle_sets(batch.column(1), width)):
                n[i] = len(own)
                f1[i], f2[i] = words.mix(own ^ _FIRST).sum(dtype=np.uint64), words.mix(own ^ _SECOND).sum(dtype=np.uint64)
                samples[i] = minhash(own)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                _lists(band_keys(samples), n > 0), _lists(odd_sketches(samples), n > 0)], ["id", "n", "f1", "f2", "bands", "odd"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, "id long, n long, f1 long, f2 long, bands array<long>, odd array<long>")


def _sent(ids: DataFrame) -> DataFrame:
    """A stored table of ids, sent to every task while it is small enough, so that texts stay where they are; beyond, both are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(docs: DataFrame, key: str, text: str, width: int, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents in ``ids``: texts are filtered in place while the ids are few enough to be sent along."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(shingle_sets(batch.column(1), width))
            flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))], ["id", "set"])

    ids = _sent(stored(ids, "set-ids"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(build, "id long, set array<long>")


def _plausible(n_a: Column, n_b: Column, odd_a: Column, odd_b: Column, percent: int) -> Column:
    """Whether sizes allow the similarity and the odd sketches do not speak against it."""
    apart = F.aggregate(F.zip_with(odd_a, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (apart <= most_different_bits(CUT))


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The (a, b) of a stored table of pairs whose full sets reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(_sets(docs, key, text, width, ids), "shingle-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a") \
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _tiled(crowd: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) inside large families, found without a row per pair.

    ``crowd`` has (rep, family, component, main): family members outside the
    main component are compared with the whole family, tile by tile. A tile
    knows all its sets, counts shared shingles exactly and returns one link
    for a document and another component.
    """
    sets = stored(_sets(docs, key, text, width, crowd.select(F.col("rep").alias("id")).distinct()), "family-sets")
    counts = crowd.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("component") != F.col("main")).alias("m"))
    rows = crowd.join(counts.select("family", F.ceil(F.col("n") / TILE).alias("nb"), F.ceil(F.col("m") / TILE).alias("mb")), "family").where("mb > 0") \
        .join(sets.withColumnRenamed("id", "rep"), "rep")
    spread = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"), F.pmod(F.xxhash64(F.lit(1), F.col("rep")), F.col("mb")).cast("int")
    every = rows.select("family", "rep", "component", "set", spread[0].alias("rb"), F.explode(F.sequence(F.lit(0), (F.col("mb") - 1).cast("int"))).alias("lb"))
    outside = rows.where("component <> main").select("family", "rep", "component", "set", spread[1].alias("lb"), F.explode(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int"))).alias("rb"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            size = np.array([len(x) for x in right["set"]])
            shingle = np.concatenate(right["set"].to_numpy())
            order = np.argsort(shingle, kind="stable")
            owner, (known, first) = np.repeat(np.arange(len(right)), size)[order], np.unique(shingle[order], return_index=True)
            ends = np.append(first[1:], len(order))
            reps, comps = right["rep"].to_numpy(), right["component"].to_numpy()
            for rep, comp, own in zip(left["rep_l"], left["component_l"], left["set_l"]):
                at = np.searchsorted(known, own)
                at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own)]
                span = ends[at] - first[at]
                hits = owner[np.repeat(first[at] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())] if len(at) else np.zeros(0, np.int64)
                shared = np.bincount(hits, minlength=len(right))
                good = np.flatnonzero((100 * shared >= percent * (size + len(own) - shared)) & (comps != comp))
                _, one = np.unique(comps[good], return_index=True)
                out += [(rep, x) for x in reps[good[one]]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    other = outside.toDF(*[f"{c}_l" for c in outside.columns])
    return other.groupBy("family_l", "lb_l", "rb_l").cogroup(every.groupBy("family", "lb", "rb")).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row: components of documents linked by 100 * shared >= percent * union."""
    seen = stored(sketches(docs, key, text, width), "sketches")
    classes = stored(seen.where("n > 0").groupBy("n", "f1", "f2").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "classes")
    # a bucket's key holds its band; four orders of pivots, so that a member meets several but not 32 of them
    entries = classes.where("rep IS NOT NULL").select("rep", F.posexplode("bands").alias("band", "bucket"))
    turn = F.struct(F.xxhash64("rep", F.col("band") % 4).alias("place"), F.col("rep"))
    crowds = stored(entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min_by("rep", turn).alias("pivot")).where("size > 1").drop("size"), "buckets")
    members = stored(entries.join(crowds, "bucket"), "bucket-members")
    facts = classes.select("rep", "n", "odd", "bands")

    def sided(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(facts.select(*[F.col(c).alias(x) for c, x in (("rep", side), ("n", f"n_{side}"), ("odd", f"odd_{side}"))]), side)
        return pairs.where(_plausible(F.col("n_a"), F.col("n_b"), F.col("odd_a"), F.col("odd_b"), percent)).select("a", "b")

    stars = stored(sided(members.where("rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()), "star-pairs")
    links = stored(_confirmed(stars, docs, key, text, width, percent), "links")
    found = stored(connected_components(links, "a", "b").withColumnRenamed("node", "rep"), "components")
    # families: what plausible pairs connect, whether they are links or not
    family = stored(connected_components(stars, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("family"))
                    .join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "families")
    parts = family.groupBy("family", "component").agg(F.count("*").alias("c"))
    large = stored(parts.groupBy("family").agg(F.sum("c").alias("n"), F.max_by("component", F.struct("c", "component")).alias("main")).where(F.col("n") > FAMILY), "large-families")
    crowd = stored(family.join(large.select("family", "main"), "family"), "large-family-members")
    more = _tiled(crowd, docs, key, text, width, percent)

    # all other members of one bucket that are not linked yet, pair by pair: smaller components against the rest
    now = members.join(family.join(large.select("family", F.lit(True).alias("big")), "family", "left"), "rep", "left").select(
        "band", "bucket", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("family", "rep").alias("family"), F.coalesce("big", F.lit(False)).alias("big"))
    # nothing is left to compare where all are linked, or all belong to one large family
    mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("family").alias("f1"), F.max("family").alias("f2"), F.min("big").alias("big")) \
        .where("lo < hi AND NOT (big AND f1 = f2)").select("bucket")
    open_rows = stored(now.join(mixed, "bucket"), "open-members")
    largest = open_rows.groupBy("bucket", "component").agg(F.count("*").alias("c")) \
        .groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    ranked = stored(open_rows.join(largest, "bucket").join(facts, "rep"), "open-ranked")
    columns = ("rep", "component", "family", "n", "odd", "bands")
    small = ranked.where("component <> main").select("bucket", "band", "big", *[F.col(c).alias(f"{c}_a") for c in columns])
    rest = ranked.select("bucket", (F.col("component") == F.col("main")).alias("is_main"), *[F.col(c).alias(f"{c}_b") for c in columns])
    # a pair is taken in the first bucket it shares, not once per bucket
    sooner = F.expr("arrays_overlap(slice(bands_a, 1, band), slice(bands_b, 1, band))")
    across = small.join(rest, "bucket").where(
        (F.col("component_a") != F.col("component_b")) & (F.col("is_main") | (F.col("rep_a") < F.col("rep_b"))) & ~(F.col("big") & (F.col("family_a") == F.col("family_b")))
        & _plausible(F.col("n_a"), F.col("n_b"), F.col("odd_a"), F.col("odd_b"), percent) & ~sooner) \
        .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).join(stars, ["a", "b"], "left_anti")
    extra = _confirmed(stored(across, "cross-pairs"), docs, key, text, width, percent)
    late = stored(more.unionByName(extra), "late-links")
    if not late.isEmpty():
        found = stored(connected_components(stored(links.unionByName(late), "all-links"), "a", "b").withColumnRenamed("node", "rep"), "components")

    # only classes with copies or links can differ from the document's own id
    joined = classes.join(found, "rep", "left").where("copies > 1 OR component IS NOT NULL") \
        .select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    table = stored(joined, "class-components")
    final = seen.select("id", "n", "f1", "f2").join(table, ["n", "f1", "f2"], "left")
    component = F.coalesce("component", "id")
    return final.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose document is not the smallest of its component; of rows with one id, one stays. Rows with a null id stay."""
    groups = stored(near_duplicates(docs, key, text, width, percent), "near-duplicates")
    gone = stored(groups.where(f"NOT kept AND {key} IS NOT NULL").select(key).distinct(), "gone")
    left = docs.join(_sent(gone), key, "left_anti")
    again = stored(groups.where("kept").groupBy(key).count().where("count > 1").select(key), "repeated")
    if again.isEmpty():
        return left
    again = _sent(again)
    return left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
