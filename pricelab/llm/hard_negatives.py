"""Hard negatives of anchors, scored exactly by the method of the Four Russians.

Components are quantised to floor(256 x).  A vector's integers are cut into bit planes (two's complement), and eight
neighbouring dimensions of a plane form one byte.  For a batch of anchors, a table holds for each group of eight
dimensions the sums of the anchor's integers over all 256 subsets; a candidate's byte names the subset of
dimensions whose bit is set, so the inner product is a sum of look-ups, shifted by one bit from plane to plane (the
sign plane counts negatively).  Scores are exact integers.

The packed candidates are stored once.  Anchors are dealt to batches of about ``BATCH``; each batch is broadcast
and all candidates are scanned twice: for the anchors' positives (best rows of the same label), then for the
negatives inside the score range of each positive.  A task keeps the best few rows of each anchor while it
reads, so it ships no more than those, and no row is dealt by label or anchor.  Batches bound what the driver and a task hold;
the number of scans follows the number of anchors.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; rows
with a component of 2**54 or more in magnitude take no part either (a score must fit in 64 bits).  Vectors of
different length are never compared.  Repeated rows count once; rows that share an id but not the vector or the
label are separate candidates and separate anchors, and never each other's partners.  Ties go to the smaller id.
Empty tables and tables without anchors give no rows.  Columns other than the id, vector and label are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelab.llm.common import Scratch
from pricelab.plans.session import scratch_path

#: Anchors that are scored in one scan (expected number; a batch is what hashing deals to it).
BATCH = 1024
#: Anchors and candidates whose scores are held at once.
ANCHORS, CANDIDATES = 256, 2048
SCALE = 256
LARGEST = float(1 << 54)
_LOWEST = np.iinfo(np.int64).min


def quantised(x: Column) -> Column:
    """floor(256 x) of each component, x as double."""
    return F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(SCALE))).cast("long"))


def bit_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """Rows of integers as bytes (row, plane from the sign down, group of eight dimensions)."""
    rows, d = q.shape
    groups = -(-d // 8)
    wide = np.zeros((rows, groups * 8), dtype=np.int64)
    wide[:, :d] = q
    shifts = np.arange(planes - 1, -1, -1)
    bits = (wide[:, None, :] >> shifts[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits.reshape(rows, planes, groups, 8), axis=3, bitorder="little").reshape(rows, planes, groups)


def subset_sums(q: np.ndarray) -> np.ndarray:
    """(group, byte, anchor): sum of the anchor's integers over the dimensions whose bit is set in the byte."""
    anchors, d = q.shape
    groups = -(-d // 8)
    wide = np.zeros((groups * 8, anchors), dtype=np.int64)
    wide[:d] = q.T
    sums = np.zeros((groups, 256, anchors), dtype=np.int64)
    for bit in range(8):
        half = 1 << bit
        sums[:, half : 2 * half] = sums[:, :half] + wide[bit::8][:, None, :]
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Exact inner products (candidate, anchor) from packed planes and subset sums."""
    rows, depth, groups = planes.shape
    out = np.zeros((rows, sums.shape[2]), dtype=np.int64)
    for p in range(depth):
        if p == 1:
            np.negative(out, out=out)  # the sign plane
        if p:
            out <<= 1
        for g in range(groups):
            out += sums[g][planes[:, p, g]]
    return out if depth != 1 else -out


class Best:
    """The best ``k`` rows (score descending, then id) seen so far for each of several lists."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score = np.full((lists, k), _LOWEST, dtype=np.int64)
        self.id = np.full((lists, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.filled = np.zeros((lists, k), dtype=bool)

    def add(self, first: int, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Offer candidates (rows) to the lists from ``first`` on (columns) where ``allowed``."""
        own = slice(first, first + score.shape[1])
        worst, full = self.score[own, -1], self.filled[own, -1]
        allowed = allowed & (~full | (score > worst) | ((score == worst) & (ids[:, None] < self.id[own, -1])))
        many = np.flatnonzero(allowed.sum(axis=0) > 8 * self.k)
        if len(many):  # the k-th best of the block bounds what can enter
            block = np.where(allowed[:, many], score[:, many], _LOWEST)
            kth = np.partition(block, len(block) - self.k, axis=0)[len(block) - self.k]
            allowed[:, many] &= score[:, many] >= kth
        at, column = np.nonzero(allowed)
        touched = np.unique(column)
        if not len(touched):
            return
        old_list, old_place = np.nonzero(self.filled[own][touched])
        lists = np.concatenate([touched[old_list], column])
        value = np.concatenate([self.score[own][touched[old_list], old_place], score[at, column]])
        name = np.concatenate([self.id[own][touched[old_list], old_place], ids[at]])
        order = np.lexsort((name, ~value, lists))  # ~value = -value - 1: no overflow
        lists, value, name = lists[order], value[order], name[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        keep = place < self.k
        lists, place = lists[keep] + first, place[keep]
        self.score[lists, place], self.id[lists, place], self.filled[lists, place] = value[keep], name[keep], True


def participants(table: DataFrame, vec_id: str, embedding: str, label: Column) -> DataFrame:
    """(id, label, d, q) of the distinct rows that take part; q holds the integers."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LARGEST / SCALE)))
    rows = table.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))
    return rows.select("id", "label", F.size("x").alias("d"), quantised(F.col("x")).alias("q")).distinct()


def planes_needed(rows: DataFrame) -> int:
    """Bits of the two's complement of all integers."""
    low, high = rows.agg(F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    return 1 + max((-1 - min(-1, low or 0)).bit_length(), max(0, high or 0).bit_length())


def packed(rows: DataFrame, planes: int) -> DataFrame:
    """(id, label, d, planes): the integers of each row as bytes of bit planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, q in (x for batch in batches for x in _by_length(batch)):
            for a in range(0, len(own), CANDIDATES):
                flat = [r.tobytes() for r in bit_planes(q[a : a + CANDIDATES], planes)]
                part = own.slice(a, len(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "d")), pa.array(flat, pa.binary())], names=["id", "label", "d", "planes"])

    return rows.select("id", "label", "d", "q").mapInArrow(run, "id long, label long, d int, planes binary")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each vector length, with their integers as a matrix."""
    lengths = np.asarray(batch.column("d"))
    for d in np.unique(lengths):
        own = batch.take(pa.array(np.flatnonzero(lengths == d)))
        yield own, own.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)


def _scan(candidates: DataFrame, planes: int, anchors: dict[int, tuple[np.ndarray, ...]], k: int, lists: int, ranged: bool) -> DataFrame:
    """(anchor, place, id, score): the best ``k`` candidates of each list as each task sees them.

    ``anchors`` by vector length: numbers, ids, labels and integers of the anchors and, if ``ranged``, the lowest and highest
    score of each of an anchor's ``lists``, which take rows of other labels; without ranges an anchor has one list of its own label."""
    shared = candidates.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: [Best(len(own[0]), k) for _ in range(lists)] for d, own in shared.value.items()}
        for batch in batches:
            lengths = np.asarray(batch.column("d"))
            for d in best.keys() & set(lengths.tolist()):
                own = batch.take(pa.array(np.flatnonzero(lengths == d)))
                ids, labels = (np.asarray(own.column(c)) for c in ("id", "label"))
                bytes_ = np.frombuffer(b"".join(own.column("planes").to_pylist()), dtype=np.uint8).reshape(len(own), planes, -(-d // 8))
                _, anchor_id, anchor_label, q, *span = shared.value[d]
                for a in range(0, len(q), ANCHORS):
                    part, sums = slice(a, a + ANCHORS), subset_sums(q[a : a + ANCHORS])
                    for c in range(0, len(own), CANDIDATES):
                        rows = slice(c, c + CANDIDATES)
                        value = scores(bytes_[rows], sums)
                        other = ids[rows, None] != anchor_id[None, part]
                        same = labels[rows, None] == anchor_label[None, part]
                        for j, found in enumerate(best[d]):
                            fits = other & ~same & (value >= span[0][None, part, j]) & (value <= span[1][None, part, j]) if ranged else other & same
                            found.add(a, value, fits, ids[rows])
        for d, all_lists in best.items():
            for j, found in enumerate(all_lists):
                row, at = np.nonzero(found.filled)
                columns = (shared.value[d][0][row], np.full(len(row), j), found.id[row, at], found.score[row, at])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["anchor", "place", "id", "score"])

    return candidates.mapInArrow(run, "anchor long, place long, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each list with their rank from 1; a list has at most ``k`` rows from each task."""
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_of(score: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The smallest integers not below the share (a fraction up to 1) of each score, without overflow."""
    num, den = share
    return num * (score // den) - (-num * (score % den)) // den


def mine(table: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (4, 5), vec_id: str = "vec_id", embedding: str = "embedding", batch: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors``: condition on the id (column ``id``); ``label``: expression over ``table``.  A negative of a positive with score s
    has a score from the share ``least`` of s up to s."""
    spark, scratch = table.sparkSession, Scratch(table.sparkSession)
    rows = scratch.stored(participants(table, vec_id, embedding, label), "quantised")
    planes = planes_needed(rows)
    candidates = scratch.stored(packed(rows, planes), "packed")
    chosen = rows.where(anchors)
    batches = -(-chosen.count() // batch)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not batches:
        scratch.drop()
        return spark.createDataFrame([], schema)
    path = scratch_path(spark, f"negatives-{uuid.uuid4().hex}")
    for b in range(batches):
        own = chosen.where(F.pmod(F.xxhash64("id", "label", "q"), F.lit(batches)) == b).orderBy("id", "label", "q").toPandas()  # one batch of anchors
        if not len(own):
            continue
        by_length = {int(d): (x.index.to_numpy(np.int64), x["id"].to_numpy(np.int64), x["label"].to_numpy(np.int64), np.array(x["q"].tolist(), dtype=np.int64).reshape(len(x), int(d))) for d, x in own.groupby("d")}
        best = scratch.stored(_ranked(_scan(candidates, planes, by_length, positives, 1, ranged=False), positives), "positives")
        of = best.select("anchor", "rank", "score").toPandas()  # a few rows for each anchor of the batch
        lo, hi = np.ones((len(own), positives), np.int64), np.zeros((len(own), positives), np.int64)  # nothing fits where a positive is missing
        at, score = (of["anchor"].to_numpy(), of["rank"].to_numpy() - 1), of["score"].to_numpy(np.int64)
        lo[at], hi[at] = share_of(score, least), score
        spans = {d: (*x, lo[x[0]], hi[x[0]]) for d, x in by_length.items()}
        found = _ranked(_scan(candidates, planes, spans, negatives, positives, ranged=True), negatives)
        names = spark.createDataFrame(own.reset_index()[["index", "id"]].set_axis(["anchor", "anchor_id"], axis=1))
        pairs = best.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "place"]).join(names, "anchor")
        out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    scratch.drop()
    return spark.read.schema(schema).parquet(path)


def default_mine(table: DataFrame) -> DataFrame:
    """Five negatives for each of five positives of the rows whose id is divisible by 100; ids divisible by 7 have moved labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table, F.col("id") % 100 == 0, label)
