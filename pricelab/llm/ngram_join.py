"""N-gram Jaccard self-join by a size-aware heavy-light method, and the groups it forms.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Equal sets are one class from the
start (its representative is the smallest doc_id), so copies cost one row each.  Classes are joined by size:

* light sets (up to a boundary) enumerate fixed-size subsets.  Two sets of sizes n and m link exactly if
  they share a subset of ceil(0.8 (n + m) / 1.8) shingles, so equal keys are links and nothing is verified;
* heavy sets scan inverted lists.  Only the rarest 20 % of a set (and one more) need lists, in an order that
  puts shingles frequent in a sample last.  A shingle at a certain place of the order serves only partners up to a
  certain size (``largest_partner``): linked sets of n and m shingles share one of the first n - overlap + 1 of the
  one and the first m - overlap + 1 of the other.  Entries that no member of a list can use are left out of it, and
  two entries meet only if each serves the other's size.  Lists with the same members (named by sums of 128 bits of their
  ids' hashes) are one list, whose entries serve what any of theirs did.  Where two entries meet, ``PARITY`` bits of each set are compared: a bit
  is the parity of the number of shingles that hash to it, so sets differ in at least as many shingles as bits.
  Pairs whose prefixes have too few shingles in common for 0.8 are pruned.  The exact Jaccard value of the remaining pairs is computed from the whole texts.

The boundary is the largest size whose subset rows cost no more than its list rows and checks by the measured
list lengths.  Sets a little below it also enter the lists, as partners of heavy ones.

Lists are not expanded to all pairs.  First every set is checked against one other, the smallest member that
most of its lists have; members of lists that stay crowded, against a few more.  After the groups of these links are known, only pairs of a list whose members are
still in different groups are checked.  Any link lies inside a group or is checked, so groups are exact.

Defined results: null, empty and wordless texts have no shingles and group alone; fewer words than a shingle
form one shingle of all words; repeated rows share a class; a row with a null doc_id has a null component and
connects no others; different texts under one doc_id are joined into one group with all that links to either; an empty
table gives an empty result; the sample only steers the order of shingles, results never depend on it.  Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelab.llm.common import LOWER, Scratch, frugal, hash_share, mix, powers, stored, text_chunks, word_bounds, word_hashes
from pricelab.llm.components import components

SHINGLE_WORDS = 5
#: Similarity threshold as a fraction; must be 4/5 for the sizes below.
NUMERATOR, DENOMINATOR = 4, 5
#: Bound of the sample that estimates shingle frequencies (documents).
SAMPLE_DOCS = 12_000
SAMPLE_MIN = 2
MAX_LIGHT = 14
#: Cost of checking a pair, in rows of an inverted list.
CHECK_ROWS = 20
#: Parity bits of a set (a multiple of 64).
PARITY = 512
#: A list is crowded where its members have more others of different groups in it, on average.
CROWD = 64
#: Most members that a crowded list tries as pivots, one after the other.
TURNS = 3
#: Lists of a set that its entries name, for a pair to come out of the first of its lists only.
FIRSTS = 32
_PARITIES = [f"p{i}" for i in range(PARITY // 64)]


def overlap_needed(n, m):
    """Smallest overlap at which sets of sizes n and m reach the threshold."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def prefix_length(n):
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = LOWER[data]
    starts, _, first = word_bounds(data, off)
    hashes = word_hashes(data, starts)
    factor = powers(words + 1, 0x2545F4914F6CDD1D)
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(words):
        rolled[: max(0, len(hashes) - k)] += hashes[k:] * factor[k + 1]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif n:
            out.append(mix((hashes[a:b] * factor[1 : n + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(rolled[:0])
    return out


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in text_chunks(batch.column("text")):
            for s in shingle_sets(data, off):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["h"])


def frequent_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, sample counts) of shingles frequent in a sample of distinct texts, and the mean length of a list."""
    share = SAMPLE_DOCS / max(1, n_docs)
    sample = docs.where(hash_share(F.col("text"), share)).select(F.xxhash64("text").alias("k"), "text").dropDuplicates(["k"]).select("text")
    counts = sample.mapInArrow(frugal(_sample_rows), "h long").groupBy("h").agg(F.count("*").alias("n"))
    counts = stored(counts.where(F.col("n") > 1), "sample-counts")
    total = counts.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first()
    rows = counts.where(F.col("n") >= SAMPLE_MIN).toPandas().sort_values("h")  # bounded by the sample
    h, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order], 1 + float(total["pairs"]) / max(1.0, float(total["n"])) / min(1.0, share)


def partners(n: int, most: int) -> range:
    """Sizes up to ``most`` that a set of size n can link with."""
    return range(-(-NUMERATOR * n // DENOMINATOR), min(most, DENOMINATOR * n // NUMERATOR) + 1)


def light_boundary(list_length: float) -> int:
    """Largest size whose subset enumeration costs no more than scanning and checking its lists."""
    best = 0
    for n in range(1, MAX_LIGHT + 1):
        light = sum(comb(n, overlap_needed(n, m)) for m in partners(n, MAX_LIGHT))
        if light > prefix_length(n) * (1 + (list_length - 1) * CHECK_ROWS):
            break
        best = n
    return best


def shapes(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray, boundary: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit signature of the set, its tokens (all of a light set, the prefix of a heavy one) and its parity bits."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column("text")):
                n, one, two, tokens, size, parity = [], [], [], [], [], []
                for s in shingle_sets(data, off):
                    at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
                    weight = np.where(frequent[at] == s, counts[at], 0) if len(frequent) else np.zeros(len(s))
                    keep = s[np.argsort(weight, kind="stable")]  # one order for all sets: rare first, then by hash
                    if len(s) > boundary:
                        keep = keep[: prefix_length(len(s))]
                    n.append(len(s))
                    one.append(s.sum(dtype=np.uint64))
                    two.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    tokens.append(keep)
                    size.append(len(keep))
                    odd = np.bincount((mix(s ^ np.uint64(0x14057B7EF767814F)) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                flat = np.concatenate(tokens).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), lists, *map(pa.array, np.ascontiguousarray(np.stack(parity).T))],
                    names=["doc_id", "n_shingles", "sign1", "sign2", "tokens", *_PARITIES])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), "doc_id long, n_shingles long, sign1 long, sign2 long, tokens array<long>, " + ", ".join(f"{p} long" for p in _PARITIES))


def _light_links(reps: DataFrame, boundary: int) -> DataFrame:
    """Links (a, b) among sets up to the boundary: members of equal subsets, tied to the smallest of the other size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, small = [], [], []
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                s = np.array(tokens, dtype=np.int64).view(np.uint64)
                n = len(s)
                for m in partners(n, boundary):
                    t = overlap_needed(n, m)
                    if t > n:
                        continue
                    subsets = np.array(list(combinations(range(n), t)), dtype=np.int64)
                    key = mix(s[subsets].sum(axis=1, dtype=np.uint64) ^ mix(np.array([min(n, m) * 64 + max(n, m)], dtype=np.uint64)))
                    keys.append(key)
                    ids.append(np.full(len(key), doc_id))
                    small.append(np.full(len(key), n < m))
                    if n == m:
                        keys.append(key)
                        ids.append(ids[-1])
                        small.append(~small[-1])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(small))], names=["id", "key", "small"])

    rows = reps.where(F.col("n_shingles") <= boundary).select("doc_id", "tokens").mapInArrow(frugal(run), "id long, key long, small boolean")
    least = rows.groupBy("key").agg(F.min(F.when(F.col("small"), F.col("id"))).alias("lo"), F.min(F.when(~F.col("small"), F.col("id"))).alias("hi"), F.max("id").alias("most"))
    least = least.where("lo is not null and hi is not null and most > least(lo, hi)")
    linked = rows.join(least, "key").select(F.col("id").alias("a"), F.when(F.col("small"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
    return linked.where("a <> b").distinct()


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts (doc_id long, text) reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for i, j, data, off in text_chunks(batch.column("left")):
                one = shingle_sets(data, off)
                for k, m, other, at in text_chunks(batch.column("right").slice(i, j - i)):
                    keep = []
                    for r, t in enumerate(shingle_sets(other, at), i + k):
                        s = one[r - i]
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if both and DENOMINATOR * both >= NUMERATOR * (len(s) + len(t) - both):
                            keep.append(r)
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    return left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right").mapInArrow(frugal(run), "a long, b long")


def _sizes_fit(n: Column, m: Column) -> Column:
    return DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)


def _shared_prefix(n: Column, m: Column) -> Column:
    """Fewest tokens that the prefixes of linked sets share.

    The shared tokens outside a prefix are the last ones in the common order, at most ceil(0.8 n) - 1 of them."""
    need = F.ceil(NUMERATOR * (n + m) / F.lit(float(NUMERATOR + DENOMINATOR)))
    return need - F.ceil(NUMERATOR * F.greatest(n, m) / F.lit(float(DENOMINATOR))) + 1


def largest_partner(n: Column, at: Column) -> Column:
    """Largest set that a set of size n can link with if the token at this place (from 0) is the first they share.

    At most n - at tokens are left to share, which must reach ceil(4 (n + m) / 9)."""
    return F.floor((DENOMINATOR + NUMERATOR) * (n - at) / F.lit(float(NUMERATOR))) - n


def _parities_fit(x: str, y: str) -> Column:
    """Whether sets may be linked by their sizes and parity bits: they differ in at least as many shingles as bits."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in _PARITIES])
    return differ <= both - 2 * F.ceil(NUMERATOR * both / F.lit(float(NUMERATOR + DENOMINATOR)))


def _open_lists(shared: DataFrame, links: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(f1, f2, id, n, g, most, parity bits): entries of the lists whose members are in different groups g of the links so far."""
    groups = components(links).select(F.col("node").alias("id"), F.col("component").alias("g"))
    known = scratch.stored(shared.where("most >= least").select("token", "id", "n", "most").join(groups, "id", "left").select("token", "id", "n", "most", F.coalesce("g", "id").alias("g")), "grouped-postings")
    # lists with the same members are one: a pair meets once for all tokens that only they share
    member, other = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    low = F.lit((1 << 32) - 1)
    sums = [F.sum(part).alias(f"s{i}") for i, part in enumerate(part for h in (member, other) for part in (h.bitwiseAND(low), F.shiftright(h, 32)))]
    split = known.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("size"), *sums).where("g0 <> g1")
    names = ["size", "s0", "s1", "s2", "s3"]
    split = scratch.stored(split.select("token", F.xxhash64(*names).alias("f1"), F.xxhash64(F.lit(1), *names).alias("f2")), "open-tokens")
    open_lists = known.join(split, "token").groupBy("f1", "f2", "id", "n", "g").agg(F.max("most").alias("most"))
    return scratch.stored(open_lists.join(reps.select(F.col("doc_id").alias("id"), *_PARITIES), "id"), "open-lists")


def _near_pivots(open_lists: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of the members of crowded lists, those with many pairs of different groups, with one member of the list.

    Each list takes another member in each turn, and the lists of near copies have many members in common, so
    a set meets a few others of its kind; what links them leaves fewer pairs to the join."""
    parts = open_lists.groupBy("f1", "f2", "g").agg(F.count("*").alias("c")).withColumn("c", F.col("c").cast("double"))
    crowded = parts.groupBy("f1", "f2").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("own")).where(F.col("size") * F.col("size") - F.col("own") > 2 * CROWD * F.col("size"))
    entry = F.struct("id", "n", "g", "most", *_PARITIES)
    pivots = open_lists.join(crowded, ["f1", "f2"], "left_semi").groupBy("f1", "f2").agg(F.min_by(entry, F.xxhash64("id", "f1", F.lit(turn))).alias("p")).select("f1", "f2", "p.*")
    # stored, so that the members look it up in a plain join, whose hot lists Spark can split
    x, y = open_lists.alias("x"), scratch.stored(pivots, "pivots").alias("y")
    meet = (F.col("x.f1") == F.col("y.f1")) & (F.col("x.f2") == F.col("y.f2")) & (F.col("x.g") != F.col("y.g")) & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    return x.join(y, meet & _parities_fit("x", "y")).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def _with_earlier(open_lists: DataFrame) -> DataFrame:
    """``open_lists`` with ``earlier``: which of the set's lists (the FIRSTS of them with the smallest names) come before the row's in the common order.

    A list's place in the order is that of its first token; a set's tokens stand in this order, so an earlier list
    has a larger ``most``, for all its members alike, and holds a pair that a later one holds.  Ids of several rows
    have no earlier lists: their pairs come out of every list."""
    own = open_lists.groupBy("id").agg(F.collect_list(F.struct("f1", "most")).alias("all"))
    firsts = own.select("id", F.when(F.size("all") == F.size(F.array_distinct("all.f1")), F.slice(F.array_sort("all"), 1, FIRSTS)).alias("firsts"))
    earlier = F.transform(F.filter("firsts", lambda e: e["most"] > F.col("most")), lambda e: e["f1"])
    return open_lists.join(firsts, "id").withColumn("earlier", F.coalesce(earlier, F.array().cast("array<long>"))).drop("firsts")


def _meetings(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a list that may be linked, out of the first list in the common order that both name."""
    x, y = entries.alias("x"), entries.alias("y")
    meet = (F.col("x.f1") == F.col("y.f1")) & (F.col("x.f2") == F.col("y.f2")) & (F.col("x.g") < F.col("y.g")) & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    meet = meet & _parities_fit("x", "y") & ~F.arrays_overlap("x.earlier", "y.earlier")
    return x.join(y, meet).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))


def _heavy_links(reps: DataFrame, docs: DataFrame, boundary: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all sets above the boundary, and those near it, as their full links would."""
    prefix = F.col("n_shingles") - F.ceil(F.col("n_shingles") * NUMERATOR / F.lit(float(DENOMINATOR))) + 1
    prefixes = reps.where(F.col("n_shingles") * DENOMINATOR > boundary * NUMERATOR).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.slice("tokens", F.lit(1), prefix.cast("int")).alias("tokens"))
    postings = prefixes.select("id", "n", F.posexplode("tokens").alias("at", "token")).select("id", "n", "token", largest_partner(F.col("n"), F.col("at")).cast("long").alias("most"))
    lists = postings.groupBy("token").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.min("n").alias("least")).where("last > pivot").select("token", "pivot", "least")
    # stored sides make plain joins, whose hot tokens Spark can split
    shared = scratch.stored(postings.join(scratch.stored(lists, "lists"), "token"), "shared-postings")
    # texts of the members of lists, cut out once for both checks
    texts = scratch.stored(docs.select(F.col("doc_id").cast("long"), "text").join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    # each set is first checked against the smallest member that most of its lists name
    named = shared.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    best = named.groupBy(F.col("id").alias("a"), "n").agg(F.max_by("pivot", "c").alias("b"), F.max("c").alias("c"))
    sizes = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m"))
    best = best.join(sizes, "b").where(_sizes_fit(F.col("n"), F.col("m")) & (2 * F.col("c") >= _shared_prefix(F.col("n"), F.col("m"))))
    # no distinct here: an aggregate on the join's partitioning would keep Spark from splitting a hot pivot
    tried = scratch.stored(best.select("a", "b"), "tried")
    links = scratch.stored(checked(tried, texts), "links")
    open_lists = _open_lists(shared, links, reps, scratch)
    for turn in range(TURNS):
        near = scratch.stored(_near_pivots(open_lists, turn, scratch).join(tried, ["a", "b"], "left_anti"), "near")
        if not near.head(1):
            break
        tried = scratch.stored(tried.union(near), "tried")
        links = scratch.stored(links.union(checked(near, texts)), "links")
        open_lists = _open_lists(shared, links, reps, scratch)
    pairs = scratch.stored(_meetings(scratch.stored(_with_earlier(open_lists), "earlier-lists")).distinct(), "open-pairs")
    # a link has enough common tokens in the prefixes; a passage in common is not enough
    left, right = (prefixes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    pairs = pairs.join(tried, ["a", "b"], "left_anti").join(left, "a").join(right, "b").where(common >= _shared_prefix(F.col("n_a"), F.col("n_b"))).select("a", "b")
    return links.union(checked(scratch.stored(pairs, "likely-pairs"), texts))


def groups_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    frequent, counts, length = frequent_shingles(docs, docs.count())
    boundary = light_boundary(length)
    scratch = Scratch(docs.sparkSession)
    shaped = scratch.stored(shapes(docs, frequent, counts, boundary), "shapes")
    own = shaped.select("doc_id", "n_shingles", "sign1", "sign2")
    # stored, so that the members look their class up in a plain join, whose hot classes Spark can split
    classes = scratch.stored(own.where("n_shingles > 0 and doc_id is not null").groupBy("sign1", "sign2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    members = stored(own.join(classes, ["sign1", "sign2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    first = members.where("doc_id = rep and n_shingles > 0").select("doc_id", "n_shingles").distinct()
    reps = scratch.stored(shaped.join(first, ["doc_id", "n_shingles"], "left_semi").select("doc_id", "n_shingles", "tokens", *_PARITIES), "representatives")
    scratch.drop(keep_last=1)
    links = _light_links(reps, boundary).union(_heavy_links(reps, docs, boundary, scratch))
    found = components(links).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    scratch.drop()  # the components are stored
    return members.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
