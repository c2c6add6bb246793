"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal if they are identical after lower-casing A-Z (null counts as empty).  Every step looks only at
the rows that the step before could not settle:

1. the length in bytes is counted; a text whose length is its own is settled;
2. among the others the hash of the first ``PREFIX`` characters is counted together with the length;
3. only texts whose length and prefix occur again are lower-cased and hashed as a whole (SHA-256), and rows are
   grouped by that.

Which rows survive a step is told to the next one by a filter of bits (``bit_filter``), whose size is fixed: it is
joined by broadcast, and no text is ever shuffled.  Two different keys may share a bit; that costs a hash of a
text that was unique after all and changes no result, as the groups are formed by (length, prefix, full hash).
Groups are counted with map-side sums and stored before the members look them up, so that a group with a third of
all rows is a plain join that Spark can split.

Only DataFrame functions are used.  Defined results: null and empty texts are equal; a row with a null doc_id ranks
behind all ids; of rows that share the largest doc_id, one stays; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelab.llm.common import Scratch, bit_filter, marked, stored

PREFIX = 64
#: Bits of the filters that name the surviving lengths and prefixes (128 KiB and 8 MiB at most).
LENGTH_BITS, PREFIX_BITS = 1 << 20, 1 << 26

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters beyond ASCII that lower() might change.
_CASED = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are (lower() is faster and does where nothing else is cased)."""
    return F.when(text.rlike(_CASED), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def exact_groups(docs: DataFrame, digests: bool = False, prefix: int = PREFIX, length_bits: int = LENGTH_BITS, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, full_hash of every row of ``docs`` (doc_id, text).

    ``full_hash`` is the hex SHA-256 of the normalised text where the last step took place; with ``digests`` it is
    given for every row."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    size, start = F.octet_length(text).cast("long"), lowered(F.substring(text, 1, prefix))
    rows = docs.select("doc_id", text.alias("text"))
    shapes = scratch.stored(rows.select(size.alias("size"), F.xxhash64(start).alias("prefix")), "text-shapes")
    lengths = shapes.groupBy("size").agg(F.count("*").alias("n")).where("n > 1")
    # the filters are stored: a broadcast then has a file of known size behind it
    lengths = scratch.stored(bit_filter(lengths, "size", length_bits), "lengths")
    again = marked(shapes, F.col("size"), lengths, length_bits, "shared").where("shared")
    prefixes = again.groupBy("size", "prefix").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("size", "prefix").alias("key"))
    prefixes = scratch.stored(bit_filter(prefixes, "key", prefix_bits), "prefixes")
    shaped = rows.withColumns({"size": size, "prefix": F.xxhash64(start)})
    digest = F.sha2(lowered(F.col("text")), 256)
    candidates = marked(shaped, F.xxhash64("size", "prefix"), prefixes, prefix_bits, "again")
    full = digest if digests else F.when(F.col("again"), digest)
    # a row number fixed by storing it tells rows apart that share their id and text
    hashed = stored(candidates.select("doc_id", "size", "prefix", "again", full.alias("full_hash"), F.monotonically_increasing_id().alias("row")), "hashed-texts")
    scratch.drop()
    key = ["size", "prefix", "full_hash"]
    groups = hashed.where("again").groupBy(*key).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")).where("group_size > 1")
    groups = stored(groups.select(*key, "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row")), "groups")
    members = hashed.where("again").join(groups, key, "left")
    alone = hashed.where("not again").withColumns({"group_size": F.lit(None).cast("long"), "keep_id": F.lit(None).cast("long"), "keep_row": F.lit(None).cast("long")})
    columns = ["doc_id", "row", "full_hash", "group_size", "keep_id", "keep_row"]
    both = members.select(*columns).unionByName(alone.select(*columns))
    grouped = F.col("group_size").isNotNull()
    return both.select(
        "doc_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"), "full_hash")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in id and text, one stays.

    Rows are told apart by id and full hash, so that a text which shares its id with another one is judged alone."""
    mark = uuid.uuid4().hex[:8]
    key = [f"id_{mark}", f"hash_{mark}"]
    keep = exact_groups(docs, digests=True).where("kept").select(F.col("doc_id").alias(key[0]), F.col("full_hash").alias(key[1]))
    named = docs.withColumns({key[0]: F.col("doc_id"), key[1]: F.sha2(lowered(F.coalesce("text", F.lit(""))), 256)})
    named = named.dropDuplicates(key)
    on = named[key[0]].eqNullSafe(keep[key[0]]) & (named[key[1]] == keep[key[1]])
    return named.join(keep, on, "left_semi").select(docs.columns)


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) of every row of ``docs``."""
    return exact_groups(docs, digests=True).withColumnRenamed("full_hash", "text_sha256")
