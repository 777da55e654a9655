"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class keeps a mean and a covariance that is shrunk towards the pooled
covariance and towards a multiple of the identity. A document's score is the
difference of the two Gaussian log densities, computed from Mahalanobis
distances with the Cholesky factors of the covariances, which are made once
per model. Fitting needs only counts, sums and cross products per class, so
it reads all labelled rows in one aggregation and nothing is sampled.

Defined results: null and empty texts have the statistics of a text without
characters and get a finite score like any other; a null label takes no part
in fitting; with rows of one class only every score is 0.5; repeated rows count
as often as they occur; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm import words
from panelwise.llm.common import small_batches

#: Classes of bytes whose shares describe a text.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"()-?"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _PLAIN | words.SPACE)

FEATURES = ("symbols", "upper", "digits", "plain", "repeats", "variety", "word_length", "bare_symbols", "length")


def _logit(count: np.ndarray, total: np.ndarray, weight: float) -> np.ndarray:
    """Log odds of a share, held back by ``weight`` pseudo counts so that short texts stay moderate."""
    return np.log((count + 0.02 * weight) / (np.maximum(total - count, 0) + weight))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics (``FEATURES``) per text, over its whole length."""
    raw, offsets = words.buffers(texts)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for a, b in words.pieces(offsets):
        out[a:b] = _statistics(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
    return out


def _statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    letters, chars = per_text(_LETTER[raw]), np.diff(offsets).astype(float)
    symbols, upper, digits = per_text(_SYMBOL[raw]), per_text(_UPPER[raw]), per_text(_DIGIT[raw])
    plain, spaces = per_text(_PLAIN[raw]), per_text(words.SPACE[raw])
    starts, first = words.split(raw, offsets)
    n = np.diff(first).astype(float)
    code = words.hashes(raw, starts)
    same = np.zeros(len(code), bool)
    same[1:] = code[1:] == code[:-1]
    same[first[:-1][first[:-1] < len(code)]] = False
    runs = np.concatenate([[0], np.cumsum(same, dtype=np.int32)])
    repeats = (runs[first[1:]] - runs[first[:-1]]).astype(float)
    distinct = np.array([len(np.unique(code[a:b])) for a, b in zip(first[:-1], first[1:])], float)
    bare = np.zeros(len(code), bool)
    if len(code):
        bare = ~np.logical_or.reduceat(_LETTER[raw] | _DIGIT[raw], starts)
    alone = np.concatenate([[0], np.cumsum(bare, dtype=np.int32)])
    bare = (alone[first[1:]] - alone[first[:-1]]).astype(float)
    return np.column_stack([
        _logit(symbols, chars, 60.0), _logit(upper, letters, 60.0), _logit(digits, chars, 60.0), _logit(plain, chars, 60.0),
        _logit(repeats, n, 15.0),
        np.log1p(distinct) - 0.8 * np.log1p(n),  # distinct words against the growth expected for that length
        (letters + 20.0) / (n + 4.0) - 5.0, _logit(bare, n, 15.0), np.sqrt(np.log1p(chars - spaces))])


def _rows(texts: pd.Series) -> np.ndarray:
    return statistics(pa.array(texts, pa.large_string(), from_pandas=True))


def document_statistics(text: Column) -> Column:
    """The transformed statistics of a text column as array<double>, in the order of ``FEATURES``."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_rows(texts)))

    return measured(text)


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the regularised covariances, log determinants and priors."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors, one per class
    offsets: np.ndarray  # log prior minus half the log determinant

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        density = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return density[1] - density[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1. The log odds are divided by the number of statistics: they count as one observation each, not as independent ones."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x) / x.shape[1], -700, 30)))


def fit(df: DataFrame, label: str, stats: str, shrink: float = 0.2, ridge: float = 0.05) -> Discriminant | None:
    """Fit on all rows with label 0 or 1 and an array of statistics; None unless both classes occur.

    ``shrink`` moves each class covariance towards the pooled one, ``ridge``
    towards a multiple of the identity. Sums and cross products are aggregated
    by Spark; the driver gets one row per class.
    """
    d = len(FEATURES)
    cell = [F.col(stats)[i] for i in range(d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cell)]
    cross = [F.sum(cell[i] * cell[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = df.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("n"), *sums, *cross).collect()
    got = {r["_label"]: r for r in rows}
    if set(got) != {0, 1}:
        return None
    n = np.array([got[k]["n"] for k in (0, 1)], float)
    total = np.array([[got[k][f"s{i}"] for i in range(d)] for k in (0, 1)])
    second = np.zeros((2, d, d))
    for k in (0, 1):
        for i in range(d):
            for j in range(i, d):
                second[k, i, j] = second[k, j, i] = got[k][f"c{i}_{j}"]
    centre = total.sum(0) / n.sum()
    within = sum(second[k] - np.outer(total[k], total[k]) / n[k] for k in (0, 1)) / n.sum()
    spread = np.sqrt(np.maximum(np.diag(within), 1e-12))
    means = (total / n[:, None] - centre) / spread
    pooled = within / np.outer(spread, spread)
    factors, offsets = [], []
    for k in (0, 1):
        own = (second[k] / n[k] - np.outer(total[k] / n[k], total[k] / n[k])) / np.outer(spread, spread)
        cov = (1 - shrink) * own + shrink * pooled
        cov = (1 - ridge) * cov + ridge * (np.trace(cov) / d) * np.eye(d)
        lower = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, spread, means, np.array(factors), np.array(offsets))


def measured(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, stats) of every document: the texts are read once and never shuffled."""
    small_batches(docs.sparkSession)
    return docs.select(*keys, document_statistics(F.col(text)).alias("stats"))


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant | None:
    """Fit on the rows of ``measured`` that ``labels`` (key, label) marks."""
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).alias("_quality"))
    return fit(stats.select(F.col(key).alias("_key"), "stats").join(marked, "_key"), "_quality", "stats")


def score(df: DataFrame, model: Discriminant | None, text: str | None = "text", stats: str | None = None, out: str = "score",
          threshold: float = 0.7, decision: str = "predicted") -> DataFrame:
    """Add ``out`` (0 to 1, higher: label 1 likelier) and ``decision`` (1 from ``threshold`` on) to every row.

    Scores come from the column ``stats`` if it is named, else from ``text``.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def rate(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.vstack(values.to_numpy()) if stats else _rows(values)))

    scored = df.withColumn(out, F.lit(0.5) if model is None else rate(F.col(stats or text)))
    return scored.withColumn(decision, (F.col(out) >= threshold).cast("int"))
