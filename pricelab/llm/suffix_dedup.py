"""Removal of long repeated byte strings by suffix sorting.

A window is a string of ``WINDOW`` bytes inside one document.  Every byte covered by a window that also starts
anywhere else goes.  Three steps, all keyed by content, find those windows:

1. anchors: each window is named by the smallest hash among its ``GRAM``-byte strings, so equal windows have equal
   anchors and a run of neighbouring windows shares one.  Anchors that occur once are done.  The others are
   grouped by (anchor, content of the whole run), copies being combined map-side: a run whose content
   occurs twice is repeated as a whole, whatever its number of copies.
2. suffix sorting: the distinct runs of an anchor are laid together in shards; a shard's suffixes are put in
   order by external induced sorting with common prefixes (``induced_sorting``), and windows whose common
   prefix with a neighbour reaches ``WINDOW`` repeat.
3. hot anchors: where more than ``HOT_RUNS`` different runs share an anchor (a passage in very many
   surroundings), their windows are dealt by 128 bits of content and counted, which splits such a group over
   all tasks: blocks of ``BLOCK`` windows first (by their shared core and by their whole), then the windows
   of the blocks that this leaves open.

Hashes are polynomials of the bytes with random values, 64 bits for anchors and 128 bits where equality
decides.  Nothing is cut or sampled; documents never join each other.

Rows are told apart by two numbers (``named``): the doc_id, and a hash of the text where several rows may share the
doc_id; for a null doc_id both come from the text.  Only rows equal in doc_id and text have equal names, and these
lose the same bytes.

Defined results: null and empty texts have no bytes and nothing removed; repeated rows repeat each other; rows
with a null doc_id, and different texts under one doc_id, are compared like all others; documents shorter than a
window keep everything; an empty table gives an empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelab.llm.common import CHUNK_BYTES, Scratch, bit_filter, frugal, give_back, marked, mix, powers, stored, text_chunks
from pricelab.llm.induced_sorting import MEMORY, SHORT, suffix_order

WINDOW = 400
GRAM = 96
HOT_RUNS = 256
SHARD_BYTES = 3 << 20
#: Windows that are first compared together where an anchor is hot.
BLOCK = 12
#: Bits of the filter that names ids which several rows share (8 MiB at most).
SHARED_BITS = 1 << 26
#: The two numbers that name a row.
NAME = ["doc_id", "row"]

_BASES = (0xD1342543DE82EF95, 0x9E6C63D0876A9A63)
_VALUES = [mix(np.arange(256, dtype=np.uint64) + np.uint64(salt)) | np.uint64(1) for salt in (0x243F6A88, 0x85A308D3)]


def named(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with doc_id and row as the row's name.

    Ids that several rows share are known by a filter of fixed size; an id that it wrongly holds only gets a longer name."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    shared = scratch.stored(bit_filter(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "doc_id", SHARED_BITS), "shared-ids")
    flag = f"shared_{uuid.uuid4().hex[:8]}"
    found = marked(docs.withColumn("doc_id", F.col("doc_id").cast("long")), F.col("doc_id"), shared, SHARED_BITS, flag)
    row = F.when(F.col(flag) | F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    return found.withColumn("row", row.cast("long")).withColumn("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit(7), "text"))).drop(flag)


def _sums(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte values times powers, and the inverse powers that make a difference independent of its place."""
    inverse = pow(_BASES[which], -1, 1 << 64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[which][data] * powers(len(data), _BASES[which]), dtype=np.uint64)]), powers(len(data) + 1, inverse)


def _content(sums: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[0][b] - sums[0][a]) * sums[1][a])


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: prefix minima of blocks from both sides."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs_of(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, content1, content2) of the runs of windows that share an anchor."""
    long = np.flatnonzero(np.diff(off) >= window)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    one, two = _sums(data, 0), _sums(data, 1)
    at = np.arange(len(data) - gram + 1)
    grams = _content(one, at, at + gram)
    least = _window_minimum(grams, window - gram + 1)  # by first byte of the window
    docs, firsts, counts = [], [], []
    # a new run where the anchor changes, or where its first place drops out of the window and a later equal one stays
    change = np.flatnonzero((least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])) + 1
    for d in long:
        a, b = int(off[d]), int(off[d + 1]) - window + 1
        lo, hi = np.searchsorted(change, [a + 1, b])
        cut = np.concatenate([[a], change[lo:hi], [b]])
        docs.append(np.full(len(cut) - 1, d))
        firsts.append(cut[:-1])
        counts.append(np.diff(cut))
    doc, first, count = np.concatenate(docs), np.concatenate(firsts), np.concatenate(counts)
    end = first + count + window - 1
    return doc, first - off[doc], count, least[first], _content(one, first, end), _content(two, first, end)


def _all_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy() for c in NAME)
            for i, j, data, off in text_chunks(batch.column("text")):
                doc, first, count, anchor, one, two = runs_of(data, off, window, gram)
                columns = (ids[i:j][doc], rows[i:j][doc], first, count, anchor.view(np.int64), one.view(np.int64), two.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*NAME, "first", "n", "anchor", "c1", "c2"])

    return docs.where(F.octet_length("text") >= window).mapInArrow(frugal(run), "doc_id long, row long, first long, n long, anchor long, c1 long, c2 long")


def _sorted_windows(parts: DataFrame, window: int, shard_bytes: int, memory: int, short: int) -> DataFrame:
    """(doc_id, row, first, n): runs of windows of ``parts`` (anchor, doc_id, row, first, n, bytes) that repeat within their anchor."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        size = pc.binary_length(rows.column("bytes")).to_numpy().astype(np.int64)
        begin = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), dtype=np.int64)  # 0 separates the runs
        for i, j, data, _ in text_chunks(rows.column("bytes")):
            place = np.arange(begin[i], begin[i] + len(data)) + np.repeat(np.arange(j - i), size[i:j])
            text[place] = data.astype(np.int64) + 1
        order, common, _ = suffix_order(text, window, memory, short)
        again = np.zeros(len(text) + 1, dtype=bool)
        near = np.flatnonzero(common >= window)
        again[order[near]] = True
        again[order[near - 1]] = True
        windows = rows.column("n").to_numpy()
        own = np.repeat(np.arange(len(size)), windows)  # the windows of all runs, one after the other
        place = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        flags = again[begin[own] + place]
        new = flags & ~(np.concatenate([[False], flags[:-1]]) & (place > 0))
        last = flags & ~(np.concatenate([flags[1:], [False]]) & (place < windows[own] - 1))
        a, z = np.flatnonzero(new), np.flatnonzero(last)
        names = [rows.column(c).to_numpy()[own[a]] for c in NAME]
        columns = (*names, rows.column("first").to_numpy()[own[a]] + place[a], z - a + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*NAME, "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in (x for x in batches if x.num_rows):
            anchor = batch.column("anchor").to_numpy()
            upto = size + np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())
            begin = 0
            # a shard may close where a new anchor begins: an anchor's runs stay together
            for k in np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])):
                before = size if k == 0 else int(upto[k - 1])
                if before >= shard_bytes and (k > 0 or last is not None and anchor[0] != last):
                    held.append(batch.slice(begin, k - begin))
                    yield solve(pa.Table.from_batches([x for x in held if x.num_rows]))
                    held, begin = [], int(k)
                    upto -= before
                    size = 0
            held.append(batch.slice(begin))
            size, last = int(upto[-1]), anchor[-1]
        rest = [x for x in held if x.num_rows]
        if rest:
            yield solve(pa.Table.from_batches(rest))

    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(frugal(run), "doc_id long, row long, first long, n long")


def _with_runs(docs: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, row, text and the list of the given columns of the document's ``runs`` (bounded by the document)."""
    own = runs.groupBy(*NAME).agg(F.collect_list(F.struct(*columns)).alias("runs"))
    return docs.join(own, NAME).select(*NAME, "text", "runs")


def _cut_out(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, row, first, n, bytes) of the given runs (doc_id, row, anchor, first, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column("text")):
                own = batch.column("runs").slice(i, j - i)
                anchor, first, n = (own.flatten().field(c).to_numpy() for c in ("anchor", "first", "n"))
                doc = np.repeat(np.arange(j - i), pc.list_value_length(own).to_numpy())
                size, begin = n + window - 1, off[doc] + first
                upto, a = np.cumsum(size), 0
                while a < len(doc):
                    part = slice(a, max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + CHUNK_BYTES, "right"))))
                    ends = np.concatenate([[0], np.cumsum(size[part])])
                    at = np.arange(ends[-1]) + np.repeat(begin[part] - ends[:-1], size[part])
                    cut = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])
                    names = [batch.column(c).to_numpy()[i:j][doc[part]] for c in NAME]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), *map(pa.array, names), pa.array(first[part]), pa.array(n[part]), cut], names=["anchor", *NAME, "first", "n", "bytes"])
                    a = part.stop

    return _with_runs(docs, runs, "anchor", "first", "n").mapInArrow(frugal(run), "anchor long, doc_id long, row long, first long, n long, bytes binary")


def _blocks(docs: DataFrame, runs: DataFrame, window: int, gram: int) -> DataFrame:
    """Blocks of up to BLOCK neighbouring windows of the given runs (doc_id, row, anchor, first, n), aligned to the anchor's place.

    ``core`` is the content that all windows of the block share, ``whole`` the content of all of them together
    (null where the run holds a part of the block only); both 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*NAME, "first", "n", "block", "core1", "core2", "whole1", "whole2"]
        for batch in batches:
            for doc_id, row, text, own in zip(*(batch.column(c).to_pylist() for c in NAME), batch.column("text"), batch.column("runs"), strict=True):
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                one, two = _sums(data, 0), _sums(data, 1)
                out: list[tuple[np.ndarray, ...]] = []
                for x in own.as_py():
                    first, last = x["first"], x["first"] + x["n"] - 1
                    place = np.arange(last, first + window - gram + 1)
                    anchor = int(place[np.argmax(_content(one, place, place + gram).view(np.int64) == x["anchor"])])
                    block = np.arange((anchor - last) // BLOCK, (anchor - first) // BLOCK + 1)
                    lo, hi = anchor - block * BLOCK - BLOCK + 1, anchor - block * BLOCK  # windows of the full block
                    out.append((np.maximum(lo, first), np.minimum(hi, last), block, hi, lo + window, np.where((lo >= first) & (hi <= last), lo, -1)))
                a, b, block, core_from, core_to, whole = (np.concatenate(c) for c in zip(*out, strict=True))
                full = whole >= 0
                lo = np.where(full, whole, 0)
                hashes = [_content(s, core_from, core_to).view(np.int64) for s in (one, two)]
                wholes = [_content(s, lo, np.where(full, lo + BLOCK + window - 1, 0)).view(np.int64) for s in (one, two)]
                arrays = [*(pa.array(np.full(len(a), x)) for x in (doc_id, row)), pa.array(a), pa.array(b - a + 1), pa.array(block), *map(pa.array, hashes), *(pa.array(w, mask=~full) for w in wholes)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return _with_runs(docs, runs, "anchor", "first", "n").mapInArrow(frugal(run), "doc_id long, row long, first long, n long, block long, core1 long, core2 long, whole1 long, whole2 long")


def _hot_windows(docs: DataFrame, runs: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """(doc_id, row, first, n): the windows of the given runs (doc_id, row, anchor, first, n) that repeat.

    Blocks of windows come first: where the whole block occurs twice, all its windows repeat; where their shared
    core occurs once, none does.  Only the windows of the other blocks are dealt one by one."""
    blocks = scratch.stored(_blocks(docs, runs, window, gram), "blocks")
    wholes = blocks.where("whole1 is not null").groupBy("whole1", "whole2").agg(F.count("*").alias("m")).where("m > 1").select("whole1", "whole2", F.lit(True).alias("again"))
    cores = blocks.groupBy("block", "core1", "core2").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    # parts of blocks have no whole to look up; the stored side makes a plain join, whose hot contents Spark can split
    columns = [*NAME, "first", "n", "block", "core1", "core2", "whole1", "whole2", "again"]
    looked_up = blocks.where("whole1 is not null").join(scratch.stored(wholes, "wholes"), ["whole1", "whole2"], "left").select(*columns)
    parts = blocks.where("whole1 is null").withColumn("again", F.lit(None).cast("boolean")).select(*columns)
    settled = scratch.stored(looked_up.union(parts), "marked-blocks")
    repeated = settled.where("again").select(*NAME, "first", "n")
    undecided = settled.where("again is null").join(cores, ["block", "core1", "core2"], "left_semi")
    return repeated.union(_counted_windows(docs, undecided, settled.where("again"), window))


def _counted_windows(docs: DataFrame, runs: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, first, n = 1) of the windows of ``runs`` whose content occurs twice in them or in a block of ``repeated`` with the same core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text, own in zip(*(batch.column(c).to_pylist() for c in NAME), batch.column("text"), batch.column("runs"), strict=True):
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                one, two = _sums(data, 0), _sums(data, 1)
                own = own.as_py()
                at = np.concatenate([np.arange(x["first"], x["first"] + x["n"]) for x in own])
                asked = np.repeat([x["asked"] for x in own], [x["n"] for x in own])
                columns = (*(pa.array(np.full(len(at), x)) for x in (doc_id, row)), pa.array(at), pa.array(_content(one, at, at + window).view(np.int64)), pa.array(_content(two, at, at + window).view(np.int64)), pa.array(asked))
                yield pa.RecordBatch.from_arrays(list(columns), names=[*NAME, "first", "w1", "w2", "asked"])

    # a partner may lie in a block that repeats as a whole: one block of each such content is enough
    contents = repeated.groupBy("block", "core1", "core2", "whole1", "whole2").agg(F.min(F.struct(*NAME, "first", "n")).alias("r")).select("block", "core1", "core2", "r.*")
    partners = contents.join(runs.select("block", "core1", "core2").distinct(), ["block", "core1", "core2"], "left_semi")
    asked = runs.select(*NAME, "first", "n", F.lit(True).alias("asked")).union(partners.select(*NAME, "first", "n", F.lit(False).alias("asked")))
    windows = _with_runs(docs, asked, "first", "n", "asked").mapInArrow(frugal(run), "doc_id long, row long, first long, w1 long, w2 long, asked boolean")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("m")).where("m > 1")
    return windows.where("asked").join(twice, ["w1", "w2"]).select(*NAME, "first", F.lit(1).cast("long").alias("n"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_runs: int = HOT_RUNS, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY, short: int = SHORT) -> DataFrame:
    """(doc_id, row, spans): for each document (doc_id, row, text; see ``named``) with repeats, the runs [(first, n)] of repeated windows."""
    scratch = Scratch(docs.sparkSession)
    runs = scratch.stored(_all_runs(docs, window, gram), "runs")
    contents = runs.groupBy("anchor", "c1", "c2", "n").agg(F.count("*").alias("copies"))
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).where("total > 1")
    contents = scratch.stored(contents.join(anchors, "anchor").select("anchor", "c1", "c2", "copies", "kinds"), "contents")
    # runs whose whole content repeats
    known = scratch.stored(runs.join(contents, ["anchor", "c1", "c2"]).select(*NAME, "first", "n", "anchor", "c1", "c2", "copies", "kinds"), "shared-runs")
    scratch.drop(keep_last=1)
    whole = known.where("copies > 1").select(*NAME, "first", "n")
    # one run of each content of the other anchors
    several = known.where("kinds > 1")
    single = several.where("copies = 1").select(*NAME, "first", "n", "anchor", "kinds")
    sample = several.where("copies > 1").groupBy("anchor", "c1", "c2").agg(F.min(F.struct(*NAME, "first", "n")).alias("r"), F.max("kinds").alias("kinds")).select("r.*", "anchor", "kinds")
    distinct = scratch.stored(single.union(sample), "distinct-runs")
    shards = _cut_out(docs, distinct.where(F.col("kinds") <= hot_runs).drop("kinds"), window)
    hot = _hot_windows(docs, distinct.where(F.col("kinds") > hot_runs).drop("kinds"), window, gram, scratch)
    found = whole.union(_sorted_windows(shards, window, shard_bytes, memory, short)).union(hot)
    spans = stored(found.groupBy(*NAME).agg(F.collect_list(F.struct("first", "n")).alias("spans")), "spans")
    scratch.drop()
    return spans


def merged(spans: list[dict], size: int, window: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges from runs of windows."""
    ranges = np.array(sorted((s["first"], s["first"] + s["n"] + window - 1) for s in spans), dtype=np.int64).reshape(-1, 2)
    if not len(ranges):
        return []
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return list(zip(ranges[at, 0].tolist(), np.minimum(reach[np.append(at[1:], len(ranges)) - 1], size).tolist(), strict=True))


def _with_spans(docs: DataFrame, window: int, **options) -> DataFrame:
    """``docs`` (doc_id, text and others) with doc_id, row as names (the id itself as ``given``) and their spans."""
    scratch = Scratch(docs.sparkSession)
    rows = named(docs, scratch)
    spans = repeated_windows(rows.select(*NAME, "text"), window, **options)
    return rows.join(spans, NAME, "left")


def removed_spans(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch.column("given").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                data = (text.as_py() or "").encode()
                gone = merged(spans.as_py() or [], len(data), window)
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                out.append((doc_id, len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("given"))
    return _with_spans(own, window, **options).select("given", "text", "spans").mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (a character that loses a byte goes as a whole)."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if not text.is_valid:
                out.append(None)
                continue
            data, at, rest = text.as_py().encode(), 0, []
            for a, b in merged(own.as_py(), len(data), window):
                rest.append(data[at:a])
                at = b
            out.append(b"".join([*rest, data[at:]]).decode(errors="ignore"))
        give_back()
        return pa.array(out, pa.string())

    # the columns of docs under private names: only their text is touched
    mark = uuid.uuid4().hex[:8]
    private = {c: f"c{i}_{mark}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in private.items())).withColumns({"doc_id": F.col(private["doc_id"]), "text": F.col(private["text"])})
    found = _with_spans(own, window, **options)
    # texts without spans do not cross to Python
    text = F.coalesce(cut(F.when(F.col("spans").isNotNull(), F.col("text")), "spans"), F.col("text"))
    return found.select(*((text if c == "text" else F.col(n)).alias(c) for c, n in private.items()))
