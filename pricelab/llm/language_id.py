"""Language identification by prediction by partial matching (PPM, escape method C).

For every language a byte context tree of order 0 to 3 is kept as counts.  The counts are frozen after the
fit, so the code length of each byte after its three predecessors is a constant per language and a text's
exact code length is a sum of table look-ups:

* the symbols are the bytes of the lower-cased text, each its own, and one for "before the text"; bytes that the
  sample never shows share a code, as nothing is known of any of them;
* a symbol seen after its context costs -log2(n / (total + distinct)); otherwise the escape
  -log2(distinct / (total + distinct)) is paid and the next shorter context is asked; a context never seen
  costs nothing; below order 0 all 256 bytes are equally likely.

The strings of two to four symbols that were seen are numbered; the number of a longer one is found from that of
its beginning and the symbol after it, so the model needs memory for what was seen only.

The language with the shortest code wins (ties: the first in name order).  ``score`` is the share of that
language in 2**-length over all languages, i.e. the posterior with equal priors.

Only the lower-cased text crosses to Python and only the verdict comes back (``verdict`` is a column).

Defined results: null texts and texts without any letter get ``und`` and score 0; so does every text if no
labelled row can be learned from.  Null languages are not learned; repeated rows count repeatedly; an empty table
gives an empty result.  ``identify`` keeps extra columns, except those named like a result, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelab.llm.common import frugal, give_back, hash_share, id_bucket, text_chunks

UNDETERMINED = "und"
#: Bound of the fit: expected number of sampled documents for each language.
SAMPLE_DOCS = 400
#: Bits of a symbol in the keys of counted strings: 0 stands before the text, byte + 1 for a byte.
_BITS = 9
#: Entries of a table that numbers strings; a larger one gives way to bit masks.
TABLE = 1 << 23
#: Bytes of text scored at once.
CHUNK = 1 << 20
_RESULT = "lang_pred string, score double, bits_per_byte double"


def _padded(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes with three times 0 before each text, and where each code stands."""
    at = np.arange(len(codes)) + np.repeat(np.arange(1, len(off)) * 3, np.diff(off))
    out = np.zeros(len(codes) + 3 * (len(off) - 1), dtype=codes.dtype)
    out[at] = codes
    return out, at


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of strings of four symbols for each language of the batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            column = batch.column("text").take(pa.array(np.flatnonzero(langs == lang)))
            for _, _, data, off in text_chunks(column):
                codes, at = _padded(data.astype(np.int64) + 1, off)
                key = codes[at - 3] << 3 * _BITS | codes[at - 2] << 2 * _BITS | codes[at - 1] << _BITS | codes[at]
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class _Next:
    """Numbers of strings: the seen pairs (number of the beginning, last symbol), in order.

    A table of all pairs while it is small, else a bit mask of the symbols seen after each beginning."""

    def __init__(self, begin: np.ndarray, symbol: np.ndarray, begins: int, symbols: int):
        self.symbols, self.words, self.table = symbols, -(-symbols // 64), None
        if (begins + 1) * symbols <= TABLE:  # the last beginning is -1, which was never seen
            self.table = np.full((begins + 1) * symbols, -1, dtype=np.int32)
            self.table[begin * symbols + symbol] = np.arange(len(begin))
            return
        self.mask = np.zeros((begins + 1) * self.words, dtype=np.uint64)
        np.bitwise_or.at(self.mask, begin * self.words + (symbol >> 6), np.uint64(1) << (symbol & 63).astype(np.uint64))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.mask).astype(np.int64))[:-1]]).astype(np.int32)

    def __call__(self, begin: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Number of each string, -1 for one that was never seen (or whose beginning, -1, was not)."""
        if self.table is not None:
            return self.table[begin * np.int32(self.symbols) + symbol]
        flat = begin * np.int32(self.words) + (symbol >> 6)
        mask, bit = self.mask[flat], np.uint64(1) << (symbol & 63).astype(np.uint64)
        return np.where(mask & bit, self.before[flat] + np.bitwise_count(mask & (bit - np.uint64(1))).astype(np.int32), np.int32(-1))


class PPMModel:
    """Frozen code lengths of every language in ``langs``."""

    def __init__(self, langs: list[str], symbol: np.ndarray, symbols: int, strings: np.ndarray, counts: np.ndarray):
        """symbol: code of each byte; strings: distinct rows of four codes; counts: one row per string, one column per language."""
        self.langs, self.symbol, k = langs, symbol, symbols
        s = [strings[:, i].astype(np.int64) for i in range(4)]

        def lengths(context: np.ndarray, contexts: int, rows: np.ndarray, n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Code length of each string (rows of n: one per string, with its context), and the escape of each context."""
            total, distinct = np.zeros((contexts + 1, len(langs))), np.zeros((contexts + 1, len(langs)))
            np.add.at(total, context, n)
            np.add.at(distinct, context, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
                seen = np.log2((total + distinct)[context] / n)
            return np.where(n > 0, seen, escape[context] + below[rows]), escape

        def summed(number: np.ndarray, size: int) -> np.ndarray:
            out = np.zeros((size, len(langs)))
            np.add.at(out, number, counts)
            return out

        uniform = np.full((k, len(langs)), 8.0)
        zero, _ = lengths(np.zeros(k, dtype=np.int64), 1, np.arange(k), summed(s[3], k), uniform)
        pair = np.arange(k * k)
        one, _ = lengths(pair // k, k, pair % k, summed(s[2] * k + s[3], k * k), zero)
        # pairs and triples are numbered if seen, be it as a context or as a whole
        pairs = np.unique(np.concatenate([s[0] * k + s[1], s[1] * k + s[2], s[2] * k + s[3]]))
        self.pair_of = np.full(k * k, -1, dtype=np.int32)
        self.pair_of[pairs] = np.arange(len(pairs))
        triples = np.unique(np.concatenate([self.pair_of[s[i] * k + s[i + 1]].astype(np.int64) * k + s[i + 2] for i in (0, 1)]))
        self.triple = _Next(triples // k, triples % k, len(pairs), k)
        of_triple = (pairs[triples // k] % k) * k + triples % k  # the pair at its end
        two, self.escape2 = lengths(triples // k, len(pairs), of_triple, summed(self.triple(self.pair_of[s[1] * k + s[2]], s[3]), len(triples)), one)
        context = self.triple(self.pair_of[s[0] * k + s[1]], s[2]).astype(np.int64)
        order = np.lexsort((s[3], context))
        self.whole = _Next(context[order], s[3][order], len(triples), k)
        end = self.triple(self.pair_of[s[1] * k + s[2]], s[3])
        four, self.escape3 = lengths(context[order], len(triples), end[order], counts[order], two)
        self.one, self.two, self.four, self.escape2, self.escape3 = (np.ascontiguousarray(x.T) for x in (one, two, four, self.escape2, self.escape3))
        self.symbols = k

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not len(data):
            return out
        k = self.symbols
        codes, at = _padded(self.symbol[data], off)
        both = codes[:-1] * np.int32(k) + codes[1:]
        pair = self.pair_of[both]
        triple = self.triple(pair[:-1], codes[2:])
        bits = np.empty((len(at), len(self.langs)), dtype=np.float32)
        whole = self.whole(triple[:-1], codes[3:])[at - 3]
        place = np.flatnonzero(whole < 0)
        new = at[place]
        before, context, end, last = triple[new - 3], pair[new - 2], triple[new - 2], both[new - 1]
        full = np.flatnonzero(np.diff(off))
        for i in range(len(self.langs)):
            bits = self.four[i][whole]
            bits[place] = self.escape3[i][before] + np.where(end >= 0, self.two[i][end], self.escape2[i][context] + self.one[i][last])
            out[full, i] = np.add.reduceat(bits, off[full])
        return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> PPMModel | None:
    """Model of the non-null languages of ``docs`` (text, lang, doc_id), or None without rows.

    The fit reads a sample of about ``sample_docs`` documents for each language, chosen by the hash of
    their id; the counting itself is a Spark aggregate.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == F.lit(lang)) & hash_share(F.col("doc_id"), sample_docs / n))
    grams = (docs.where(chosen).select("lang", F.lower("text").alias("text"))
             .mapInArrow(frugal(_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    if not len(grams):
        return None
    return model_of(grams)


def model_of(grams: pd.DataFrame) -> PPMModel:
    """Model from the counts (lang, gram of four symbols, n)."""
    langs = sorted(grams["lang"].unique())
    raw, n = grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)
    mask = (1 << _BITS) - 1
    seen = np.unique(raw & mask)  # codes of the bytes that occur
    code = np.full(1 << _BITS, len(seen) + 1, dtype=np.int32)
    code[0] = 0
    code[seen] = np.arange(1, len(seen) + 1)
    uniq, at = np.unique(raw, return_inverse=True)
    strings = np.stack([code[uniq >> i * _BITS & mask] for i in (3, 2, 1, 0)], axis=1)
    counts = np.zeros((len(uniq), len(langs)))
    np.add.at(counts, (at, np.searchsorted(langs, grams["lang"].to_numpy())), n)
    return PPMModel(langs, code[1:257], len(seen) + 2, strings, counts)


def verdict(docs: DataFrame, model: PPMModel | None, text: str = "text") -> Column:
    """Struct (lang_pred, score, bits_per_byte) of each text of ``docs``."""
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def best(lowered: pa.Array) -> pa.Array:
        ppm = shared.value
        names = np.array(ppm.langs, dtype=object)
        ok = np.asarray(lowered.is_valid())
        pred = np.full(len(ok), UNDETERMINED, dtype=object)
        score, rate = np.zeros(len(ok)), np.full(len(ok), np.nan)
        for i, j, data, off in text_chunks(lowered, CHUNK):
            bits = ppm.code_lengths(data, off)
            win = bits.argmin(axis=1)
            least = bits[np.arange(len(win)), win]
            use = np.flatnonzero(ok[i:j])
            pred[i + use] = names[win[use]]
            score[i + use] = 1 / np.exp2(np.maximum(least[use, None] - bits[use], -1000)).sum(axis=1)
            rate[i + use] = least[use] / np.maximum(np.diff(off)[use], 1)
        give_back()
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score), pa.array(rate, mask=np.isnan(rate))], names=["lang_pred", "score", "bits_per_byte"])

    # a text without a letter stays in the JVM
    return best(F.when(F.col(text).rlike(r"\p{L}"), F.lower(F.col(text))))


def identify(docs: DataFrame, model: PPMModel | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte (of the best language; null where undetermined)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    found = f"verdict_{uuid.uuid4().hex[:8]}"
    return docs.withColumn(found, verdict(docs, model, text)).select(*kept, f"{found}.*")


def identify_held_out(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every document; learned where crc32 mod 3 is not 1."""
    fold = id_bucket(F.col("doc_id"), 3)
    model = fit(documents.where(fold != 1).select("doc_id", "lang", "text"))
    return identify(documents.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text"), model).drop("text")
