"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of the whole text, such as the share of repeated words or of upper-case letters, are
transformed (logarithms and square roots) to be closer to normal. For each class, the mean and the
covariance are learnt from a bounded sample of labelled rows; the covariance is shrunk towards the
pooled one and towards a diagonal. A text's score is the posterior of class 1 from the difference of
the Mahalanobis log-densities, computed with the Cholesky factors that the model keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemill.llm import textops
from tidemill.llm.common import chunks, free_name

#: Labelled rows of each class that the model is fitted on (all, if there are fewer), and the bytes of their texts at most.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 1 << 17
POOLED, DIAGONAL = 0.2, 0.05
#: Densities that differ by more are not told apart further: labels are never that certain.
MOST_LOG_ODDS = 30.0
THRESHOLD = 0.3

STATISTICS = ("words", "word_length", "word_spread", "distinct", "repeats", "upper", "digits", "punctuation", "symbols", "spaces", "lines", "line_spread", "sentence_ends", "capitals")

_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 usual punctuation, 5 symbol, 6 space, 7 line end
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[*b".,;:'\"()-"]] = 4
_CLASS[[*b"!?#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[[9, 11, 12, 13, 32]] = 6
_CLASS[10] = 7


def statistics(column: pa.Array) -> np.ndarray:
    """n x len(STATISTICS) transformed statistics; of an empty or null text all are 0."""
    b, offsets = textops.raw_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    has = np.flatnonzero(size > 0)
    share = np.zeros((n, 8))
    kind = _CLASS[b]
    text = np.repeat(np.arange(n), size)
    share[:] = np.bincount(text * 8 + kind, minlength=8 * n).reshape(n, 8)
    # whitespace-separated tokens
    blank = kind >= 6
    before = np.ones(len(b), bool)
    before[1:] = blank[:-1]
    before[offsets[:-1][has]] = True
    start = np.flatnonzero(~blank & before)
    token_text = text[start]
    n_tokens = np.bincount(token_text, minlength=n)
    filled = np.add.reduceat((~blank).astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    per = np.maximum(n_tokens, 1)
    mean = np.bincount(token_text, filled, n) / per
    spread = np.sqrt(np.maximum(np.bincount(token_text, filled.astype(np.float64) ** 2, n) / per - mean**2, 0))
    capital = np.bincount(token_text, kind[start] == 2, n) / per
    # words and how often they come back
    w = textops.words(column)
    word_text = np.repeat(np.arange(n), w.counts)
    seen = textops.occurrences(word_text, w.hashes) == 0
    n_words = np.maximum(w.counts, 1)
    distinct = np.bincount(word_text, seen, n)
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (word_text[1:] == word_text[:-1])
    repeats = np.bincount(word_text, same, n) / n_words
    lines = share[:, 7] + 1
    bytes_ = np.maximum(size, 1)
    letters = np.maximum(share[:, 1] + share[:, 2], 1)
    stop = np.bincount(text, (b == 46) | (b == 33) | (b == 63), n)
    out = np.stack(
        [
            np.log1p(n_tokens),
            np.log1p(mean),
            np.log1p(spread),
            np.log1p(distinct) - np.log1p(w.counts),
            np.sqrt(repeats),
            np.sqrt(share[:, 2] / letters),
            np.sqrt(share[:, 3] / bytes_),
            np.sqrt(share[:, 4] / bytes_),
            np.sqrt(share[:, 5] / bytes_),
            np.sqrt(share[:, 6] / bytes_),
            np.log1p(lines) - np.log1p(n_tokens),
            np.log1p(n_tokens / lines),
            np.sqrt(stop / per),
            np.sqrt(capital),
        ],
        axis=1,
    )
    out[size == 0] = 0
    return out


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class x statistic
    factors: np.ndarray  # inverse Cholesky factor of each class
    offset: np.ndarray  # log prior minus half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log = np.stack([self.offset[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)])
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -MOST_LOG_ODDS, MOST_LOG_ODDS)))


def fit(x: np.ndarray, y: np.ndarray, prior: float) -> Model | None:
    """A model of the rows of `x` with labels `y`; `prior` is the share of label 1. None without both labels."""
    if len(np.unique(y)) < 2:
        return None
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - centre) / scale
    means = np.stack([z[y == k].mean(axis=0) for k in (0, 1)])
    own = [np.cov(z[y == k].T, bias=True) if (y == k).sum() > 1 else np.zeros((z.shape[1],) * 2) for k in (0, 1)]
    rest = z - means[y]
    pooled = rest.T @ rest / len(z)
    factors, offset = [], []
    for k in (0, 1):
        weight = POOLED + (1 - POOLED) * z.shape[1] / (z.shape[1] + (y == k).sum())  # few rows: closer to the pooled one
        c = (1 - weight) * own[k] + weight * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.eye(len(c)) * max(np.trace(c) / len(c), 1e-3)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        offset.append(np.log(prior if k else 1 - prior) - np.log(np.diag(low)).sum())
    return Model(centre, scale, means, np.stack(factors), np.array(offset))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Model | None, float]:
    """(model, share of label 1) from the texts of a bounded sample of each label's rows in `labels` (id,
    label), taken by a hash of the id. Other labels than 0 and 1 are left out."""
    rows = labels.where(F.col(label_col).isin(0, 1))
    counts = {r[0]: r["n"] for r in rows.groupBy(label_col).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None, 0.5
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col(label_col) == k, F.lit(min(1.0, SAMPLE_ROWS / n))) for k, n in counts.items()])
    sampled = rows.where(chance < share).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    picked = texts.join(F.broadcast(sampled), "id").select("y", "text")  # about SAMPLE_ROWS rows of each label

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(statistics(b.column("text"))), pa.list_(pa.float64()))], names=["y", "x"])

    got = picked.mapInArrow(measured, "y int, x array<double>").collect()
    if not got:
        return None, prior
    got = sorted((r["y"], tuple(r["x"])) for r in got)
    return fit(np.array([r[1] for r in got]), np.array([r[0] for r in got]), prior), prior


def score(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, keep_text: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns of `docs` (the text only with keep_text) and, called by `names`, the score (chance of
    label 1) and predicted (1 if it is at least `threshold`). The model is learnt from `labels` (id, label)
    and the texts of `learn_from` (`docs`, if not given).

    Null and empty texts have the statistics 0 and are scored like others. Without rows of both labels
    every score is the smoothed share of label 1 (0.5 if there is no label). Repeated rows are scored one by one;
    an empty table gives none. Where `docs` has columns of these names, the new ones have underscores before them.
    """
    kept = [f for f in docs.schema if keep_text or f.name != text_col]
    names = tuple(free_name([f.name for f in kept], x) for x in names)
    model, prior = train(learn_from or docs, labels, id_col, text_col, label_col)
    held = docs.sparkSession.sparkContext.broadcast((model, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p = held.value
        for b in chunks(batches, text_col):
            s = m.score(statistics(b.column(text_col))) if m else np.full(b.num_rows, p)
            columns = [i for i, c in enumerate(b.schema.names) if keep_text or c != text_col]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in columns), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*(b.schema.names[i] for i in columns), *names])

    schema = StructType([*kept, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    return docs.mapInArrow(run, schema)
