"""Near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosine.

A normalised vector x gets, in each of several tables, the bucket made of ``floor((a.x + b) / WIDTH)`` for a
number of Gaussian directions a and offsets b.  The number of directions grows with the logarithm of the
number of vectors, so that a bucket holds about one unrelated vector, and the number of tables follows from
the wanted recall at the threshold.  Vectors that share a bucket are compared by cosine in double precision.

Equal vectors are one class first, with its number of copies as weight.  A bucket's members are dealt to blocks
of bounded size and every pair of blocks is one unit of work, so a hot bucket is split; pairs never leave a
unit: it returns, for each member, the weight linked in it and one edge towards its local component.  A pair
that meets in several tables is counted in the first one only.

Defined results: null vectors, zero vectors and vectors with null or non-finite components link with nothing;
vectors of different lengths never link; repeated rows (equal id and vector) count as one vector; different
vectors under one id are vectors of their own, each with its own links and component; a null id has no
component and is not kept, and connects no others; an empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelab.llm.common import mix, stored
from pricelab.llm.components import components

THRESHOLD = 0.95
WIDTH = 2.0
#: Expected share of the pairs at the threshold that meet in a bucket (closer pairs meet more often).
RECALL = 0.97
BLOCK = 512
SEED = 911


def meeting_chance(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for vectors at this Euclidean distance."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def table_shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(directions in a table, tables) for n vectors; unrelated ones are taken as orthogonal."""
    near, far = meeting_chance(sqrt(2 - 2 * threshold)), meeting_chance(sqrt(2))
    directions = max(4, ceil(log(max(2, n)) / log(1 / far)))
    return directions, ceil(log(1 - recall) / log(1 - near**directions))


def bucket_keys(x: np.ndarray, directions: int, tables: int) -> np.ndarray:
    """Bucket of each normalised vector (rows) in each table (columns)."""
    rng = np.random.default_rng([SEED, x.shape[1], directions, tables])
    a, b = rng.normal(size=(x.shape[1], directions * tables)), rng.uniform(0, WIDTH, directions * tables)
    cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, directions)
    key = np.broadcast_to(mix(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(x.shape[1] + 1)), (len(x), tables)).copy()
    for k in range(directions):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, k])
    return key


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.asarray(batch.column("d"))
        for d in np.unique(size):
            yield batch.take(pa.array(np.flatnonzero(size == d)))


def _bucketed(vectors: DataFrame, directions: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches):
            keys = bucket_keys(_normalised(_rows(batch.column("x"))), directions, tables)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("rep")), tables)), pa.array(keys.ravel().view(np.int64))], names=["rep", "bucket"])

    return vectors.select("rep", "d", "x").mapInArrow(run, "rep long, bucket long")


def _unit(ids: np.ndarray, weight: np.ndarray, side: np.ndarray, x: np.ndarray, keys: np.ndarray, bucket: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, linked weight, local component) of the members of one pair of blocks; side 2 marks a block paired with itself."""
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side == 1) if (side != 2).all() else left
    link = x[left] @ x[right].T >= threshold
    if right is left:
        np.fill_diagonal(link, False)
    r, c = np.nonzero(link)
    # count a pair in the first table in which it meets
    first = keys[left[r]] == keys[right[c]]
    mine = keys[left[r]].view(np.int64)[np.arange(len(r)), first.argmax(axis=1)] == bucket if len(r) else np.zeros(0, bool)
    linked = np.zeros(len(ids), dtype=np.int64)
    np.add.at(linked, left[r[mine]], weight[right[c[mine]]])
    if right is not left:
        np.add.at(linked, right[c[mine]], weight[left[r[mine]]])
    label = ids.copy()
    while len(r):  # smallest id over the links, until nothing changes
        a, b = left[r], right[c]
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            break
        label = new
    return ids, linked, label


def _compared(units: DataFrame, directions: int, tables: int, threshold: float) -> DataFrame:
    """(rep, linked, label) for each member of each unit; rows arrive sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solve(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            unit = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
            x = _normalised(_rows(rows.column("x").combine_chunks()))
            keys = bucket_keys(x, directions, tables)
            ids, weight, side = (rows.column(c).to_numpy() for c in ("rep", "weight", "side"))
            cut = np.concatenate([[0], np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1, [len(unit)]])
            parts = [_unit(ids[a:b], weight[a:b], side[a:b], x[a:b], keys[a:b], unit[a, 0], threshold) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1]
            columns = [np.concatenate(p) if parts else np.zeros(0, np.int64) for p in (zip(*parts, strict=True) if parts else [[], [], []])]
            keep = (columns[1] > 0) | (columns[2] < columns[0])
            return pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in columns], names=["rep", "linked", "label"])

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            last = [rows.column(c)[rows.num_rows - 1].as_py() for c in ("bucket", "d", "i", "j")]
            open_ = np.ones(rows.num_rows, dtype=bool)
            for c, v in zip(("bucket", "d", "i", "j"), last, strict=True):
                open_ &= rows.column(c).to_numpy() == v
            at = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
            rest = rows.slice(at)
            done = rows.slice(0, at)
            d = done.column("d").to_numpy()
            for part in np.unique(d):
                yield solve(done.take(pa.array(np.flatnonzero(d == part))))
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return units.mapInArrow(run, "rep long, linked long, label long")


def linked_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``table``."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    rows = table.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).withColumn("good", F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    # sign1 and sign2: 128 bits of the exact components (-0.0 equals 0.0)
    zeroed = F.transform("x", lambda v: v + F.lit(0.0))
    good = rows.where("good").select("id", "x", F.xxhash64(zeroed).alias("sign1"), F.xxhash64(F.lit(1), zeroed).alias("sign2"))
    members = good.select("id", "sign1", "sign2")
    # a class of equal vectors has a number of its own, fixed by storing it: an id may hold several vectors
    classes = members.distinct().groupBy("sign1", "sign2").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    directions, tables = table_shape(n, threshold)
    vectors = good.join(classes, ["sign1", "sign2"]).where("id = first")
    vectors = stored(vectors.select("rep", "weight", F.size("x").alias("d"), "x").dropDuplicates(["rep"]), "vectors")
    keys = stored(_bucketed(vectors, directions, tables), "buckets")
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    live = keys.join(sizes, "bucket").select("rep", "bucket", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = live.select("rep", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    units = spread.select("rep", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    units = units.join(vectors, "rep").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "d", "i", "j")
    found = stored(_compared(units.select("bucket", "d", "i", "j", "side", "rep", "weight", "x"), directions, tables, threshold), "compared")
    links = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    groups = components(found.where("label < rep").select(F.col("rep").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("rep"), "component")
    joined = groups.join(classes.select("rep", "first"), "rep")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "component").select("rep", "component_id")
    of_class = classes.join(links, "rep", "left").join(named, "rep", "left").select(
        "sign1", "sign2", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    # stored, so that the rows look their class up in a plain join, whose hot classes Spark can split
    of_class = stored(of_class, "of-class")
    linked = members.join(of_class, ["sign1", "sign2"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(vec_id), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)).alias("kept"))
