"""Phrase collocations from sorted streams of counts.

``count_stream`` holds the exact counts of all phrases of one to five words that reach the least count.  It is made
order by order: a task counts the phrases of a chunk and Spark adds the parts up.  A phrase can only be frequent
if its parts are, so the scan for pairs leaves out words, and the scans for longer phrases leave out pairs and triples,
that a filter of fixed size does not know; the filter may let others pass and never holds a frequent one back, so counts
are exact, with any amount of data.

The stream is then laid out twice, in prefix order (words from the left) and in suffix order (words from the right).
Each cut of a phrase asks for the counts of its first and last words: the cuts are sorted by first part and merged
in lockstep with the prefix stream, then sorted by last part from the right and merged with the suffix stream (sort-merge
joins; no look-up by hash).  The same merges show the extensions: a cut that takes off one word tells the shorter
phrase the count of a longer one.  All longer candidates are covered by one-word extensions, since a phrase between
the two is at least as frequent as the longer one.

The best rows of a language are found by a sort over all tasks and counts of the rows before each task's, so neither
a frequent word nor a frequent language is gathered anywhere.

Words are ``[^\\x20\\x09]+`` of the pieces of a text between ``[.,;:!?\\x0A-\\x0D]``, A-Z in lower case.  Scores are
computed in decimals of 38 digits and floored.  Defined results: null and empty texts have no words; a null language
counts as ``und``; repeated rows count repeatedly; an empty table gives no rows; columns other than lang and
text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelab.llm.common import LOWER, Scratch, mix, powers, stored, text_chunks, word_bounds

LONGEST = 5
LEAST = 100
LIMIT = 2000
#: Bytes of text whose phrases a task counts together.
CHUNK = 4 << 20
#: Bits of the filter of frequent words or pairs (8 MiB, whatever their number).
FILTER_BITS = 1 << 26
_BUCKET = 4096 * 8

#: Characters that end a piece, and those that only separate words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"

_ENDS, _SEPARATES = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ENDS[list(PIECE_ENDS)] = True
_SEPARATES[list(PIECE_ENDS + BLANKS)] = True
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Words:
    """The words of a chunk of texts: their numbers in ``names``, and whether each goes on to the next within its piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = LOWER[data]
        starts, ends, first = word_bounds(data, off, _SEPARATES)
        n = len(starts)
        lengths = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        letters = np.ascontiguousarray(data[~_SEPARATES[data]])
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(lengths), pa.py_buffer(letters)]).dictionary_encode()
        self.number, self.names = words.indices.to_numpy().astype(np.int64), words.dictionary
        ended = np.cumsum(_ENDS[data], dtype=np.int32)
        self.goes_on = np.zeros(n, dtype=bool)
        if n:
            self.goes_on[:-1] = ended[starts[1:]] == ended[ends[:-1] - 1]
            last = first[1:][np.diff(first) > 0] - 1
            self.goes_on[last] = False

    def hashes(self) -> np.ndarray:
        return name_hashes(self.names)

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The ``k`` words from each place on, joined by blanks."""
        words = [self.names.take(pa.array(self.number[at + i])) for i in range(k)]
        return (words[0] if k == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))).cast(pa.string())


def name_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (non-empty) binary value."""
    if not len(names):
        return np.zeros(0, np.uint64)
    _, offsets, data = names.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    size, begin = np.diff(off), off[:-1] - off[0]
    place = np.arange(len(raw)) - np.repeat(begin, size)
    return mix(np.add.reduceat(_VALUES[raw] * powers(int(size.max()) + 1)[place], begin))


def joined_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase and the word after it."""
    return mix(left * np.uint64(0xD1342543DE82EF95) + right)


def _counted(docs: DataFrame, count) -> DataFrame:
    """(lang, phrase, n) summed over all tasks; ``count`` yields (phrases, counts) of the words of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                for _, _, data, off in text_chunks(batch.column("text").take(pa.array(np.flatnonzero(langs == lang))), CHUNK):
                    for phrases, n in count(Words(data, off)):
                        key = pc.binary_join_element_wise(pa.scalar(lang), phrases, "\t")
                        yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64())], names=["key", "n"])

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    # language and phrase travel as one string: a phrase holds no tab, so the last one parts them
    sums = texts.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("key", "\t", -1)
    return sums.select(F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "n")


def _all_words(words: Words) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Counts of the words, and of all of them under the empty phrase."""
    if len(words.number):
        yield words.names.cast(pa.string()), np.bincount(words.number, minlength=len(words.names))
        yield pa.array([""]), np.array([len(words.number)])


def _known(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(FILTER_BITS)
    return (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def filter_of(phrases: DataFrame, k: int) -> np.ndarray:
    """Bits (FILTER_BITS of them) that are set for the hash of each phrase of ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column("phrase").cast(pa.large_string()), " ").flatten().cast(pa.large_binary())
            each = name_hashes(words).reshape(-1, k)
            hashes = each[:, 0]
            for i in range(1, k):
                hashes = joined_hashes(hashes, each[:, i])
            yield pa.RecordBatch.from_arrays([pa.array((hashes % np.uint64(FILTER_BITS)).astype(np.int64) + 1)], names=["at"])

    bits = phrases.select("phrase").mapInArrow(run, "at long").groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in bits.collect():  # at most FILTER_BITS / 32768 rows of 4 KiB
        a = (row["bucket"] - 1) * (_BUCKET // 8)
        out[a : a + _BUCKET // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def count_stream(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases that occur ``least`` times, and (lang, n) of all word occurrences."""
    spark = docs.sparkSession
    words = scratch.stored(_counted(docs, _all_words).where((F.col("n") >= least) | (F.col("phrase") == "")), "words")
    frequent = words.where("phrase <> ''").where(F.col("n") >= least)
    of_words = spark.sparkContext.broadcast(filter_of(frequent, 1))

    def pairs(words: Words) -> Iterator[tuple[pa.Array, np.ndarray]]:
        known = _known(of_words.value, words.hashes())[words.number]
        at = np.flatnonzero(words.goes_on[:-1] & known[:-1] & known[1:])
        if len(at):
            _, one, n = np.unique(words.number[at] * len(words.names) + words.number[at + 1], return_index=True, return_counts=True)
            yield words.phrases(at[one], 2), n

    def chained(filter_: np.ndarray, k: int, longest: int) -> Callable[[Words], Iterator[tuple[pa.Array, np.ndarray]]]:
        """Counts the phrases of ``k`` + 1 to ``longest`` words all of whose parts of ``k`` words the filter knows."""

        def count(words: Words) -> Iterator[tuple[pa.Array, np.ndarray]]:
            number, each = words.number, words.hashes()[words.number]
            at, hashes, name = np.arange(len(number)), each, number
            for size in range(2, k + 1):  # places where k words are in one piece, and those that the filter knows
                inside = at[at + size - 1 < len(number)]
                inside = inside[words.goes_on[inside + size - 2]]
                hashes = joined_hashes(hashes[np.searchsorted(at, inside)], each[inside + size - 1])
                at = inside
            at = at[_known(filter_, hashes)]
            known = np.zeros(len(number), dtype=bool)
            known[at] = True
            name = number[at]
            for size in range(2, longest + 1):
                if size > k:
                    on = known[np.minimum(at + size - k, len(number) - 1)] & (at + size - k < len(number))
                    at, name = at[on], name[on]
                if not len(at):
                    return
                _, one, name, n = np.unique(name * len(words.names) + number[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
                if size > k:
                    yield words.phrases(at[one], size), n

        return count

    streams = [frequent, scratch.stored(_counted(docs, pairs).where(F.col("n") >= least), "pairs")]
    for k, longest in ((2, 3), (3, LONGEST)):
        of_shorter = spark.sparkContext.broadcast(filter_of(streams[-1], k))
        streams.append(scratch.stored(_counted(docs, lambda words, f=of_shorter, k=k, longest=longest: chained(f.value, k, longest)(words)).where(F.col("n") >= least), "longer"))
    return reduce(DataFrame.union, streams), words.where("phrase = ''").select("lang", F.col("n").alias("total"))


def scored(stream: DataFrame, totals: DataFrame, scratch: Scratch, absorbed: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more that no extension absorbs.

    A phrase goes if an extension has ``absorbed`` per cent of its count."""
    words = scratch.stored(stream.select("lang", F.split("phrase", " ").alias("w"), F.col("n").alias("a")), "stream")
    size = F.size("w")
    cuts = words.where(size > 1).withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("first"), F.reverse(F.slice("w", F.col("k") + 1, size - F.col("k"))).alias("tser"))
    prefix_order = words.select("lang", F.col("w").alias("first"), F.col("a").alias("l"))
    suffix_order = words.select("lang", F.reverse("w").alias("tser"), F.col("a").alias("r"))
    merged = scratch.stored(cuts.join(prefix_order.hint("merge"), ["lang", "first"]), "prefix-merged")
    merged = scratch.stored(merged.join(suffix_order.hint("merge"), ["lang", "tser"]).select("lang", "w", "a", "k", "l", "r"), "merged")
    # a cut of one word at the end or the start tells the rest the count of its extension
    by_right = merged.where((F.col("k") == size - 1) & (F.col("k") > 1) & (100 * F.col("a") >= absorbed * F.col("l"))).select("lang", F.slice("w", F.lit(1), size - 1).alias("w"))
    by_left = merged.where((F.col("k") == 1) & (size > 2) & (100 * F.col("a") >= absorbed * F.col("r"))).select("lang", F.slice("w", F.lit(2), size - 1).alias("w"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "total")}
    thousand = F.lit(1000).cast("decimal(4,0)")
    with_totals = merged.join(F.broadcast(totals), "lang").withColumns({"up": thousand * wide["a"] * wide["total"], "down": wide["l"] * wide["r"]})
    best = with_totals.withColumn("score", F.expr("up div down")).groupBy("lang", "w", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    alive = best.join(scratch.stored(by_right.union(by_left).distinct(), "absorbed"), ["lang", "w"], "left_anti")
    return alive.select("lang", F.array_join("w", " ").alias("phrase"), "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def best_of_each(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each language by score and count descending, then phrase, with their rank."""
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    placed = stored(placed, "ordered")
    part = F.shiftright("row", 33).alias("part")
    parts = placed.groupBy("lang", part).agg(F.min("row").alias("begin"), F.count("*").alias("m"))
    before = parts.withColumn("earlier", F.sum("m").over(Window.partitionBy("lang").orderBy("part")) - F.col("m")).drop("m")  # a row for each task
    ranked = placed.withColumn("part", part).join(before, ["lang", "part"]).withColumn("rank", F.col("row") - F.col("begin") + F.col("earlier") + 1)
    return ranked.where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language of ``docs`` (lang, text)."""
    scratch = Scratch(docs.sparkSession)
    out = best_of_each(scored(*count_stream(docs, scratch, least), scratch), limit)
    scratch.drop()
    return out
