"""Chat formatting by quotation linking.

Leading ``>`` marks (blanks between them allowed) give every line of a message its quote level.  Runs of lines
of one level above 0 are quoted passages, runs of level 0 the message's own paragraphs (also cut at empty
lines).  A passage is normalised (lower case, white space collapsed) and hashed; a quoted passage of any length
links its message to an earlier message of the same conversation that has that passage as an own run, paragraph
or whole body (however its lines are broken), or that has the passage's lines one after the other in one of its
own runs (empty lines don't count).  The original is the first message with the passage; of a message's quotes that link, the
shallowest decides its parent (the latest original, if several are as shallow).

Messages without a link are the main line.  A message's thread is found by pointer jumping over parents, and
messages are ordered by (turn of the thread's first message, own turn), so each reply follows what it answers.
The formatted row holds the body without quotes; lines after the last own text (a trailing quote) vanish too.

Nothing is gathered by conversation: passages are joined by hash, ranks come from a range partitioning and
counts of its partitions, so one conversation may hold any share of the rows.

Defined results: null texts are empty bodies; messages of a null conversation form no links and have no
position; equal (conv_id, turn) rows are ordered by role and text; repeated rows keep a position each; a quote
of nothing known leaves the message on the main line.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelab.llm.common import stored

_MARKS = r"^[ \t]*(?:>[ \t]*)+"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _passage_hash(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _line_hashes(text: Column) -> Column:
    """Hashes of the normalised lines that are not empty."""
    return F.transform(F.filter(F.transform(F.split(text, "\n"), _normal), lambda s: s != ""), _passage_hash)


def parsed(messages: DataFrame) -> DataFrame:
    """row (a hash of the whole row), conv_id, turn, role, body, quotes [(level, text)], own runs (null: the body is the only one)."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "\r\n?", "\n")
    base = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), text.alias("text"))
    base = base.withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))
    line = F.transform(F.split("text", "\n"), lambda s: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(s, _MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(s, _MARKS, "").alias("s")))
    base = base.withColumn("lines", line)
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    # a passage is a run of lines of one level: join lines with \n, and a change of level with a mark and the new level
    level = F.col("lines")
    marked = F.array_join(F.transform("lines", lambda x, k: F.concat(
        F.when(F.get(level, k - 1)["level"] == x["level"], "\n").otherwise(F.concat(F.lit("\x00"), x["level"].cast("string"), F.lit("\x01"))),
        F.regexp_replace(x["s"], "[\x00\x01]", " "))), "")
    runs = F.transform(F.filter(F.split(marked, "\x00"), lambda r: r != ""), lambda r: F.struct(F.substring_index(r, "\x01", 1).cast("int").alias("level"), F.substring_index(r, "\x01", -1).alias("s")))
    base = base.withColumn("runs", F.when(quoted, runs))
    quotes = F.filter("runs", lambda r: (r["level"] > 0) & (_normal(r["s"]) != ""))
    own = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["s"])
    body = F.when(quoted, F.array_join(own, "\n")).otherwise(F.col("text"))
    return base.select("row", "conv_id", "turn", "role", F.regexp_replace(body, r"^\n+|\s+$", "").alias("body"), F.coalesce(quotes, F.array().cast("array<struct<level:int,s:string>>")).alias("quotes"), own.alias("own"))


def _links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, level): the parent of each turn with a quotation that is found."""
    quotes = messages.where((F.size("quotes") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = quotes.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", F.col("q.level").alias("level"), _passage_hash(_normal(F.col("q.s"))).alias("whole"), _line_hashes(F.col("q.s")).alias("lines"))
    quotes = stored(quotes.select("conv_id", "turn", "level", "whole", F.size("lines").alias("n"), F.xxhash64("lines").alias("run")).distinct(), "quotes")
    # a passage is looked up as a whole (size 0) and as a run of its number of lines
    keys = F.explode(F.array(F.struct(F.lit(0).alias("size"), F.col("whole").alias("h")), F.struct(F.col("n").alias("size"), F.col("run").alias("h")))).alias("key")
    wanted = quotes.select("conv_id", "turn", "level", "whole", "run", keys).select("conv_id", "turn", "level", "whole", "run", "key.size", "key.h")
    asked = wanted.select("conv_id", "size", "h").distinct()
    sizes = stored(quotes.select("conv_id", "n").distinct().groupBy("conv_id").agg(F.collect_set("n").alias("sizes")), "quote-sizes")
    # only conversations with quotations are cut into passages
    sources = messages.where(F.col("turn").isNotNull()).join(sizes, "conv_id")
    sources = sources.select("conv_id", F.col("turn").alias("parent_turn"), "body", F.coalesce("own", F.array("body")).alias("own"), "sizes")
    wholes = F.array_distinct(F.transform(F.concat(F.array("body"), F.col("own"), F.flatten(F.transform("own", lambda s: F.split(s, r"\n\s*\n")))), _normal))
    wholes = sources.select("conv_id", "parent_turn", F.explode(F.filter(wholes, lambda s: s != "")).alias("s")).select("conv_id", "parent_turn", F.lit(0).alias("size"), _passage_hash(F.col("s")).alias("h"))
    runs = sources.select("conv_id", "parent_turn", "sizes", F.explode("own").alias("s")).select("conv_id", "parent_turn", "sizes", _line_hashes(F.col("s")).alias("lines"))
    runs = runs.select("conv_id", "parent_turn", "lines", F.explode(F.filter("sizes", lambda k: k <= F.size("lines"))).alias("size"))
    windows = F.transform(F.sequence(F.lit(1), F.size("lines") - F.col("size") + 1), lambda i: F.xxhash64(F.slice("lines", i, F.col("size"))))
    runs = runs.select("conv_id", "parent_turn", "size", F.explode(F.array_distinct(windows)).alias("h"))
    sources = wholes.union(runs).join(asked, ["conv_id", "size", "h"], "left_semi")
    originals = sources.groupBy("conv_id", "size", "h").agg(F.min("parent_turn").alias("parent_turn"))
    found = wanted.join(originals, ["conv_id", "size", "h"]).where("parent_turn < turn")
    found = found.groupBy("conv_id", "turn", "level", "whole", "run").agg(F.min("parent_turn").alias("parent_turn"))
    return found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("parent_turn")).alias("p"))).alias("best")).select(
        "conv_id", "turn", (-F.col("best.p")).alias("parent_turn"), F.col("best.level").alias("quote_level"))


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, quote_level, root, depth) by pointer jumping."""
    state = stored(links.select("*", F.col("parent_turn").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = state.join(up, ["conv_id", "root"], "left")
        new = stored(moved.select("conv_id", "turn", "parent_turn", "quote_level", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        state = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return state


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with the place of each row in its conversation, from a range partitioning and its counts."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for c in batch.column("conv_id").to_pylist():
                n = n + 1 if c == last else 0
                last = c
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(places, pa.int64())], names=[*kept, "part", "place"])

    ordered = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    ranked = stored(ordered.mapInArrow(run, rows.schema.add("part", "integer").add("place", "long")), "ranked")
    counts = ranked.groupBy("conv_id", "part").agg((F.max("place") + 1).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    # only conversations that reach over several partitions need an offset
    offsets = counts.withColumn("earlier", earlier).where("earlier > 0").select("conv_id", "part", "earlier")
    return ranked.join(offsets, ["conv_id", "part"], "left").withColumn("position", F.col("place") + F.coalesce("earlier", F.lit(0))).drop("part", "place", "earlier")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, parent_turn, quote_level, thread_turn, depth, body of every message."""
    rows = stored(parsed(messages), "messages")
    threads = _threads(_links(rows))
    rows = rows.drop("quotes", "own").join(threads, ["conv_id", "turn"], "left")
    rows = rows.select("row", "conv_id", "turn", "role", "parent_turn", "quote_level", F.coalesce("root", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "body")
    placed = _positions(rows, ["thread_turn", "turn", "role", "row"])
    return placed.select("conv_id", F.when(F.col("conv_id").isNotNull(), F.col("position")).alias("position"), "turn", "role", "parent_turn", "quote_level", "thread_turn", "depth", "body")
