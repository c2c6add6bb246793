"""Toxicity score: subword-bag embeddings averaged into a linear softmax.

A word is a run of ASCII letters, digits and non-ASCII bytes of the lower-cased text.  Its vector is the mean
of the vectors of its character n-grams (3 to 5 bytes, the word being framed by blanks), held in hashed
buckets, so that an unseen misspelling shares most n-grams with the word it stands for.  A window of
``WINDOW`` words is the mean of its word vectors and goes through a two-class softmax; embeddings and softmax
are trained together in numpy by Adam.  A document is as toxic as its most toxic window: toxic documents are mostly
harmless words, so after a start on all windows the loss of a document is that of its highest window at that step.

The sample is dealt to ``FOLDS`` parts.  One model is trained without each part and scores the documents of that part;
a logistic curve from margin to probability is fitted on these scores of all sampled documents, none of which its
model has seen, each class weighing as much as it does among all labelled rows, so that a score means the same whatever
share of a class was sampled.  The final margins are the mean of the models'.

After training, the two-class margin of an n-gram is one number, so a text is scored by table look-ups over
its bytes: whole texts, in memory bounded by a chunk.  Only the lower-cased text crosses to Python and only the
score comes back.

Defined results: null and empty texts, and texts without a word, get the score of a window with margin 0 and
no words (the curve at the bias), always below 0.7 on a model with both classes; without labelled rows of
both classes every score is the share of toxic labels learned (0 without any).  A label given twice counts as toxic if
one of the two does; labels without an id or value are not learned; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelab.llm.common import give_back, hash_share, id_bucket, text_chunks

#: Bounds of the fit: expected number of sampled documents of each class, their expected bytes, and the longest one that is sampled.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 1200
SAMPLE_BYTES, SAMPLE_LONGEST = 4 << 20, 1 << 17
FOLDS = 5
BUCKET_BITS = 18
SIZES = (3, 4, 5)
WINDOW = 3
DIMENSIONS = 4
#: An n-gram of fewer sampled documents has no vector of its own (the margin of its bucket is 0).
MIN_DOCS = 12
DECAY = 1e-6
#: Steps on all windows, and steps on the highest window of each document.
START_STEPS, STEPS = 30, 80
RATE = 0.05
THRESHOLD = 0.7

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True
_FOLD = np.where(_WORD, np.arange(256), 32).astype(np.uint8)
_FOLD[65:91] = np.arange(97, 123)


def framed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes with a blank before and after each text, and where each text starts (plus the total)."""
    docs = len(off) - 1
    out = np.full(len(data) + docs + 1, 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, docs + 1), np.diff(off))] = _FOLD[data]
    return out, off + np.arange(docs + 1)


def gram_buckets(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: start positions of the n-grams that lie within one framed word, and their buckets."""
    blank = text == 32
    h = text.astype(np.uint32)
    inner = np.ones(len(text), dtype=bool)
    hashed = h
    for n in range(2, max(SIZES) + 1):
        if len(text) < n:
            return
        hashed = hashed[:-1] * np.uint32(16777619) ^ h[n - 1 :]
        if n > 2:
            inner = inner[: len(hashed)] & ~blank[n - 2 : len(text) - 1]
        if n in SIZES:
            at = np.flatnonzero(inner[: len(hashed)])
            x = hashed[at]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(2246822519 + 2 * n)
            yield at, x >> np.uint32(32 - BUCKET_BITS)


def words_in(text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the word at each position (words counted from 0), starts of the words, first word of each text."""
    letter = text != 32
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = np.flatnonzero(first)
    return np.cumsum(first, dtype=np.int64) - 1, starts, np.searchsorted(starts, begin)


class SubwordModel:
    """Margins of the n-gram buckets, bias of the softmax and the curve from margin to probability."""

    def __init__(self, margins: np.ndarray, bias: float, slope: float, offset: float):
        self.margins, self.bias, self.slope, self.offset = margins.astype(np.float32), bias, slope, offset

    def highest(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Margin of the most toxic window of each text."""
        text, begin = framed(data, off)
        word_of, starts, first = words_in(text, begin)
        out = np.full(len(off) - 1, self.bias)
        if not len(starts):
            return out
        total, count = np.zeros(len(starts)), np.zeros(len(starts))
        for at, bucket in gram_buckets(text):
            word = word_of[at + 1]
            total += np.bincount(word, weights=self.margins[bucket], minlength=len(starts))
            count += np.bincount(word, minlength=len(starts))
        run = np.concatenate([[0.0], np.cumsum(total / np.maximum(count, 1))])
        sizes = np.diff(first)
        doc_end = np.repeat(first[1:], sizes)
        at = np.arange(len(starts))
        stop = np.minimum(at + WINDOW, doc_end)
        mean = (run[stop] - run[at]) / WINDOW
        full = np.flatnonzero(sizes)
        # a window that the end of the text cuts short is part of an earlier one, unless the text is short itself
        short = stop - at < np.minimum(WINDOW, np.repeat(sizes, sizes))
        mean[short] = -np.inf
        out[full] += np.maximum.reduceat(mean, first[:-1][full])
        return out

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.highest(data, off) + self.offset, -30, 30)))


class Sample:
    """The windows of some texts: words as numbers, and the n-grams of each distinct word."""

    def __init__(self, texts: list[bytes]):
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        text, begin = framed(np.frombuffer(b"".join(texts), dtype=np.uint8), off)
        letter = text != 32
        starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        ends = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
        first = np.searchsorted(starts, begin)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text[letter])]).dictionary_encode()
        self.docs, self.word_at, names = len(texts), words.indices.to_numpy(), words.dictionary.to_pylist()
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
        # windows that do not overlap; the last of a text may be shorter
        cut = np.ones(len(starts), dtype=bool)
        cut[1:] = (np.diff(doc) != 0) | ((np.arange(1, len(starts)) - first[doc[1:]]) % WINDOW == 0)
        self.window_at = np.cumsum(cut, dtype=np.int32) - 1
        self.doc_of = doc[cut]  # of each window
        spread = np.bincount(np.unique(self.word_at.astype(np.int64) * len(texts) + doc) // max(1, len(texts)), minlength=len(names))
        listed = np.frombuffer(b" " + b" ".join(names) + b" ", dtype=np.uint8)
        word_of, _, _ = words_in(listed, np.zeros(1, np.int64))
        grams, owners = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for at, bucket in gram_buckets(listed):
            grams.append(bucket)
            owners.append(word_of[at + 1].astype(np.int32))
        gram, owner = np.concatenate(grams), np.concatenate(owners)
        self.size = np.maximum(np.bincount(owner, minlength=len(names)), 1).astype(np.float64)
        # n-grams of few documents can only be learned by heart
        seen = np.bincount(gram, weights=spread[owner], minlength=1 << BUCKET_BITS)
        known = seen[gram] >= min(MIN_DOCS, max(1, len(texts) // 20))
        self.buckets, self.gram = np.unique(gram[known], return_inverse=True)
        self.owner = owner[known]

    def windows(self, margins: np.ndarray) -> np.ndarray:
        """Margin (less the bias) of each window from the margins of the known n-grams."""
        words = np.bincount(self.owner, weights=margins[self.gram], minlength=len(self.size)) / self.size
        return np.bincount(self.window_at, weights=words[self.word_at], minlength=len(self.doc_of)) / WINDOW

    def back(self, slopes: np.ndarray) -> np.ndarray:
        """Derivative by the margin of each n-gram from the derivatives by the windows."""
        words = np.bincount(self.word_at, weights=slopes[self.window_at], minlength=len(self.size)) / self.size / WINDOW
        return np.bincount(self.gram, weights=words[self.owner], minlength=len(self.buckets))


def _fitted(sample: Sample, labels: np.ndarray, used: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Margins of the buckets and bias, from the documents marked in ``used``."""
    doc, y = sample.doc_of, labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(sample.buckets), DIMENSIONS)), rng.normal(0, 0.3, (DIMENSIONS, 2)), np.zeros(2)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def balanced(each: np.ndarray) -> np.ndarray:
        return np.where(y[doc[each]] > 0, 0.5 / max(1.0, y[doc[each]].sum()), 0.5 / max(1.0, (1 - y[doc[each]]).sum()))

    begins = np.searchsorted(doc, np.unique(doc))
    counts = np.diff(np.append(begins, len(doc)))
    trained = np.flatnonzero(used[doc])
    for step in range(1, START_STEPS + STEPS + 1):
        e, w, b = params
        margin = sample.windows(e @ (w[:, 1] - w[:, 0])) + b[1] - b[0]
        if step > START_STEPS:
            highest = np.repeat(np.maximum.reduceat(margin, begins), counts) if len(begins) else margin
            trained = np.flatnonzero(used[doc] & (margin >= highest))
        slopes = np.zeros(len(doc))
        slopes[trained] = (1 / (1 + np.exp(-np.clip(margin[trained], -30, 30))) - y[doc[trained]]) * balanced(trained)
        g, total = sample.back(slopes), slopes.sum()
        direction = e.T @ g
        grads = [np.outer(g, w[:, 1] - w[:, 0]) + DECAY * e, np.stack([-direction, direction], axis=1), np.array([-total, total])]
        for i, (x, d) in enumerate(zip(params, grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            x -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    e, w, b = params
    margins = np.zeros(1 << BUCKET_BITS, np.float32)
    margins[sample.buckets] = e @ (w[:, 1] - w[:, 0])
    return margins, float(b[1] - b[0])


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7, weights: tuple[float, float] = (1.0, 1.0)) -> SubwordModel:
    """Fit embeddings, softmax and curve on lower-cased texts with labels 0 and 1 (both must occur).

    ``weights``: labelled rows that a text of class 0 and of class 1 stands for, used by the curve."""
    labels = np.asarray(labels, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(len(texts))
    fold = np.zeros(len(texts), dtype=np.int64)
    for label in (0, 1):
        own = order[labels[order] == label]
        fold[own] = np.arange(len(own)) % FOLDS
    sample, margins, bias = Sample(texts), np.zeros(1 << BUCKET_BITS), 0.0
    unseen = np.zeros(len(texts))
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), fold != k
        if len(set(labels[rest])) < 2:  # a class of one document
            rest = np.ones(len(texts), dtype=bool)
        part, part_bias = _fitted(sample, labels, rest, seed + k)
        margins += part / FOLDS
        bias += part_bias / FOLDS
        off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])]).astype(np.int64)
        unseen[own] = SubwordModel(part, part_bias, 1.0, 0.0).highest(np.frombuffer(b"".join(texts[i] for i in own), dtype=np.uint8), off)
    return SubwordModel(margins, bias, *_curve(unseen, labels, np.asarray(weights, dtype=np.float64)[labels]))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve by Newton steps (a small ridge keeps separable data finite)."""
    weight = weight / weight.mean()
    scale = float(x.std()) or 1.0
    a = np.stack([(x - x.mean()) / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        beta -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(2) * ridge, a.T @ (weight * (p - y)) + ridge * beta)
    slope = max(float(beta[0]), 0.0) / scale
    return slope, float(beta[1]) - slope * float(x.mean())


def _bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def fit(docs: DataFrame, label: str = "label") -> SubwordModel:
    """Model from (doc_id, text, label 0 or 1, perhaps the size of the text as bytes); reads a hash sample of about SAMPLE_TOXIC and SAMPLE_CLEAN documents and SAMPLE_BYTES bytes of each."""
    if "bytes" not in docs.columns:
        docs = docs.withColumn("bytes", _bytes())
    docs = docs.where(F.col(label).isin(0, 1) & (F.col("bytes") <= SAMPLE_LONGEST))
    found = {r[label]: r for r in docs.groupBy(label).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    if len(found) < 2:
        share = 0.0 if not found else float(next(iter(found)))
        return SubwordModel(np.zeros(1 << BUCKET_BITS), 0.0, 0.0, 30.0 * (2 * share - 1))
    shares = {k: min(most / found[k]["n"], SAMPLE_BYTES / max(1, found[k]["bytes"])) for k, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))}
    chosen = ((F.col(label) == 1) & hash_share(F.col("doc_id"), shares[1])) | ((F.col(label) == 0) & hash_share(F.col("doc_id"), shares[0]))
    rows = docs.where(chosen).select(F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.col(label).alias("label"), "doc_id").toPandas().sort_values(["doc_id", "text"])
    if rows["label"].nunique() < 2:
        return SubwordModel(np.zeros(1 << BUCKET_BITS), 0.0, 0.0, -30.0)
    sampled = rows["label"].value_counts()
    return train([t.encode() for t in rows["text"]], rows["label"].to_numpy(), weights=tuple(found[k]["n"] / int(sampled[k]) for k in (0, 1)))


def score_of(docs: DataFrame, model: SubwordModel, text: str = "text") -> Column:
    """Score of each text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(lowered: pa.Array) -> pa.Array:
        p = np.zeros(len(lowered))
        for i, j, data, off in text_chunks(lowered):
            p[i:j] = shared.value.scores(data, off)
        give_back()
        return pa.array(p)

    return scores(F.lower(F.col(text)))


def score(docs: DataFrame, model: SubwordModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from THRESHOLD on), which replace columns of these names."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, score_of(docs, model, text).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit_held_out(documents: DataFrame, labels: DataFrame) -> SubwordModel:
    """Model learned from the labels of rows whose crc32 mod 3 is not 1."""
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("label")).where(id_bucket(F.col("doc_id"), 3) != 1)
    # sizes are taken before the join, so that counting them moves no text
    return fit(documents.select("doc_id", "text", _bytes().alias("bytes")).join(known, "doc_id"))


def score_held_out(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held = F.coalesce(id_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return score(documents.select("doc_id", held, "text"), fit_held_out(documents, labels)).drop("text")
