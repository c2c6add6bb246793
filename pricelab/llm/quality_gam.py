"""Quality score: generalised additive model with pairwise interactions.

Each text is reduced to the ``FEATURES`` below (byte classes, word and line repetition, lengths).  The model is
an intercept plus one look-up table per feature and one two-way table per chosen pair of features, so a score
is a sum of table entries at the features' bins.  The tables are learned by cyclic boosting: in every round
each feature in turn gets a shallow tree (up to three cuts) over its bins, fitted to the gradient of the
logistic loss and added with a small step; afterwards the pairs with the largest gain in the residuals get
two-way trees (one cut on the first, one on the second in each half) in the same way.

Scoring bins a whole Arrow batch at once and adds the entries.  Features come from whole texts.

Defined results: null and empty texts count as texts without words (all features 0) and get a score of their
bins; without labelled rows of both classes every score is the share of label 1 among those learned (0 without
any).  Labels, language, source and id are no features.  Only the columns named in the result are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelab.llm.common import LOWER, hash_share, id_bucket, mix, text_chunks, word_bounds, word_hashes

FEATURES = ("log_words", "mean_word", "upper_share", "symbols_per_word", "stops_per_word", "marks_per_word", "digit_share", "wide_share",
            "repeated_lines", "repeated_triples", "distinct_words", "top_word", "words_per_line", "short_words", "entropy", "bars_per_word")
#: Bound of the fit: expected number of sampled labelled documents.
SAMPLE_DOCS = 12_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, STEP = 150, 60, 0.1

_CLASSES = np.zeros((256, 7))
_CLASSES[65:91, 0] = 1
_CLASSES[97:123, 1] = 1
_CLASSES[list(b"#*$%&<>@^~=+_/\\{}[]"), 2] = 1
_CLASSES[list(b".,;:"), 3] = 1
_CLASSES[list(b"!?"), 4] = 1
_CLASSES[48:58, 5] = 1
_CLASSES[list(b"|"), 6] = 1


def features_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    docs, size = len(off) - 1, np.diff(off)
    seen = np.bincount(np.repeat(np.arange(docs), size) * 256 + data, minlength=docs * 256).reshape(docs, 256).astype(np.float64)
    upper, lower, symbols, stops, marks, digits, bars = (seen @ _CLASSES).T
    total = np.maximum(size, 1)
    starts, ends, first = word_bounds(data, off)
    n = np.diff(first)
    words = np.maximum(n, 1)
    out = np.zeros((docs, len(FEATURES)))
    share = np.where(seen > 0, seen / total[:, None], 1)
    out[:, 0], out[:, 2], out[:, 3], out[:, 4], out[:, 5] = np.log1p(n), upper / np.maximum(upper + lower, 1), symbols / words, stops / words, marks / words
    out[:, 6], out[:, 7], out[:, 14], out[:, 15] = digits / total, seen[:, 128:].sum(axis=1) / total, -(share * np.log2(share)).sum(axis=1), bars / words
    if not len(starts):
        return out
    folded = LOWER[data]
    hashes = word_hashes(folded, starts)
    length = ends - starts
    doc = np.repeat(np.arange(docs), n)
    out[:, 1] = np.bincount(doc, weights=length, minlength=docs) / words
    out[:, 13] = np.bincount(doc, weights=length <= 3, minlength=docs) / words
    # lines with words: a line begins at its first word
    line = np.cumsum(data == 10)[starts]
    begin = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])]))
    place = np.arange(len(starts)) - np.repeat(begin, np.diff(np.append(begin, len(starts))))
    lines = np.add.reduceat(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin)
    line_first = np.searchsorted(begin, first)
    triples = mix(hashes[:-2] + mix(hashes[1:-1] + mix(hashes[2:]))) if len(hashes) > 2 else hashes[:0]
    for d in np.flatnonzero(n):
        a, b = first[d], first[d + 1]
        counts = np.unique(hashes[a:b], return_counts=True)[1]
        own = lines[line_first[d] : line_first[d + 1]]
        out[d, 8] = 1 - len(np.unique(own)) / len(own)
        out[d, 9] = 1 - len(np.unique(triples[a : b - 2])) / (b - a - 2) if b - a > 2 else 0.0
        out[d, 10], out[d, 11], out[d, 12] = len(counts) / (b - a), counts.max() / (b - a), np.log1p((b - a) / len(own))
    return out


class PairwiseGAM:
    """Cut points of the bins, tables of the features and of the pairs, intercept."""

    def __init__(self, intercept: float):
        self.intercept = intercept
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pair_cuts: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.cuts[k], x[:, k], "right")]
        coarse: dict[int, np.ndarray] = {}
        for i, j, table in self.pairs:
            for k in (i, j):
                if k not in coarse:
                    coarse[k] = np.searchsorted(self.pair_cuts[k], x[:, k], "right")
            out += table[coarse[i], coarse[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of the bins (left side: bins before the place)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    ok = (hl >= least) & (hr >= least)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, gl**2 / (hl + 1) + gr**2 / (hr + 1), -np.inf) - g.sum() ** 2 / (h.sum() + 1)
    at = int(gain.argmax())
    return max(0.0, float(gain[at])), at + 1


def _tree(g: np.ndarray, h: np.ndarray, least: float, depth: int = 2) -> np.ndarray:
    """Leaf value for each bin of a shallow tree over ordered bins."""
    gain, at = _best_cut(g, h, least) if depth and len(g) > 1 else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], least, depth - 1), _tree(g[at:], h[at:], least, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    _, at = _best_cut(g.sum(axis=1), h.sum(axis=1), least)
    parts = [p for p in (slice(0, at), slice(at, None)) if g[p].size]
    return np.concatenate([np.tile(_tree(g[p].sum(axis=0), h[p].sum(axis=0), least, 1), (g[p].shape[0], 1)) for p in parts])


def train(x: np.ndarray, y: np.ndarray) -> PairwiseGAM:
    """Model of features ``x`` and labels ``y`` (0 and 1)."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-13
    model = PairwiseGAM(float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        model.intercept = 30.0 if len(y) and y.mean() == 1 else -30.0
        return model
    k, least = x.shape[1], max(1.0, 0.002 * len(y)) * 0.25
    model.cuts = [_cuts(x[:, i], BINS) for i in range(k)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(model.cuts)]
    margin = np.full(len(y), model.intercept)

    def slopes(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(at, weights=y - p, minlength=size), np.bincount(at, weights=p * (1 - p), minlength=size)

    for _ in range(ROUNDS):
        for i in range(k):
            step = STEP * _tree(*slopes(bins[i], len(model.tables[i])), least)
            model.tables[i] += step
            margin += step[bins[i]]
    model.pair_cuts = [_cuts(x[:, i], PAIR_BINS) for i in range(k)]
    coarse = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(model.pair_cuts)]
    wide = [len(c) + 1 for c in model.pair_cuts]
    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            g, h = (s.reshape(wide[i], wide[j]) for s in slopes(coarse[i] * wide[j] + coarse[j], wide[i] * wide[j]))
            leaf = _pair_tree(g, h, least)
            gains.append((-float((leaf * g - 0.5 * leaf**2 * h).sum()), i, j))
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for _, i, j in sorted(gains)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            at = coarse[i] * wide[j] + coarse[j]
            step = STEP * _pair_tree(*(s.reshape(wide[i], wide[j]) for s in slopes(at, wide[i] * wide[j])), least)
            table += step
            margin += step[coarse[i], coarse[j]]
    return model


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``features`` in place of ``text``."""
    kept = [c for c in docs.columns if c != "text"]
    schema = docs.drop("text").schema.add("features", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((len(batch), len(FEATURES)))
            for i, j, data, off in text_chunks(batch.column("text")):
                x[i:j] = features_of(data, off)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "features"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: PairwiseGAM) -> DataFrame:
    """``docs`` without ``text``, with score and predicted."""
    docs = docs.drop("score", "predicted")
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), [c for c in docs.columns if c != "text"]
    schema = docs.drop("text").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros(len(batch))
            for i, j, data, off in text_chunks(batch.column("text")):
                p[i:j] = shared.value.scores(features_of(data, off))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def fit_held_out(documents: DataFrame, labels: DataFrame) -> PairwiseGAM:
    """Model learned from the labels of rows whose crc32 mod 4 is not 2, on a hash sample of about SAMPLE_DOCS."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("label")).where((id_bucket(F.col("doc_id"), 4) != 2) & F.col("label").isin(0, 1))
    n = known.count()
    chosen = known.where(hash_share(F.col("doc_id"), SAMPLE_DOCS / max(1, n)))
    rows = with_features(documents.select("doc_id", "text").join(chosen, "doc_id")).toPandas().sort_values("doc_id")
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return train(x, rows["label"].to_numpy(np.float64))


def score_held_out(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held = F.coalesce(id_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return score(documents.select("doc_id", held, "text"), fit_held_out(documents, labels))
