"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack.

A document becomes its token ids and an end id; only documents longer than a sequence are cut, into pieces of
the full length and a shorter last one.  Bins are then formed one kind at a time: the longest remaining length
seeds a bin, a bitset subset-sum recurrence over the lengths still available (a bit for each reachable sum)
finds the fullest feasible completion, and the combination is removed as often as its lengths last.

The recurrence needs the number of pieces of each length only, a table of at most ``capacity`` rows whatever
the corpus, so the plan is made on the driver while pieces stay distributed: each piece has a rank among those
of its length (place within its input partition plus the pieces of earlier partitions) and the plan says which
ranks of a length go to which bins.  No sequence is ever gathered in one place, and a hot length is no
hot key: ranks come from partition counts, not from a window over the length.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelab.llm.common import frugal, stored, text_chunks

CAPACITY = 4096
END_ID = 1
#: Entries of a worker's cache of encoded words; it is emptied when full (speed only).
CACHE_WORDS = 700_000
_SLICE = 1 << 18
_RANK_BITS = 45

# The tokenizer's split pattern, spelled out for the Latin-1 range.
_LETTER = "a-zªµºß-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_BLANK = r"\t-\r \x85\xa0"
_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+".replace(r"\x85\xa0", r"\x{85}\x{a0}")
# texts outside Latin-1, with separators that only some libraries take for white space, or with special tokens go the plain way
_NOT_PLAIN = r"[\x1c-\x1f\x{85}\x{a0}]|[^\x00-\x{ff}]|<\|"


class WordTokenizer:
    """Token ids as little-endian 32-bit bytes; words of Latin-1 texts are encoded once and kept."""

    loaded: dict[str, WordTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The worker's tokenizer for this file: its tasks share vocabulary and caches."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.ends, self.words = ends, {"": b""}

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words (matches of the split pattern), many in one call; a word ends where a token does."""
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            done = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.asarray(done.ids, dtype="<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(part) and (not len(stop) or stop[-1] == len(ids)):
                raw, at = ids.tobytes(), [0, *(4 * stop).tolist()]
                self.words.update((w, raw[a:b]) for w, a, b in zip(part, at[:-1], at[1:], strict=True))
            else:
                self.words.update((w, self.plain(w)) for w in part)

    def _blocks(self, blocks: pa.Array) -> list[bytes]:
        """Ids of distinct lower-cased Latin-1 strings without white space."""
        split = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(blocks, _SPLIT, r"\0 ")))
        coded = split.flatten().dictionary_encode()
        words = _strings(coded.dictionary)
        if len(self.words) > CACHE_WORDS:
            self.words = {"": b""}
        self._learn([w for w in words if w not in self.words])
        known = list(map(self.words.__getitem__, words))
        parts = list(map(known.__getitem__, np.asarray(coded.indices).tolist()))
        at = np.asarray(split.offsets) - split.offsets[0].as_py()
        first, several = at[:-1], np.flatnonzero(np.diff(at) > 1)  # a string has a word at least, the empty one the empty word
        out = list(map(parts.__getitem__, first.tolist()))
        for i, a, b in zip(several.tolist(), at[several].tolist(), at[several + 1].tolist(), strict=True):
            out[i] = b"".join(parts[a:b])
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Same ids as encoding each text whole: white space separates tokens, so words are independent."""
        texts = texts.fill_null("")
        out: list[bytes | None] = [None] * len(texts)
        special = pc.match_substring_regex(texts, _NOT_PLAIN)
        for i in np.flatnonzero(special):
            out[i] = b"".join(self.plain(p) for p in _slices(texts[int(i)].as_py()))
        rows = np.flatnonzero(~np.asarray(special))
        blocks = pc.ascii_split_whitespace(pc.utf8_lower(texts.take(pa.array(rows))))
        coded = blocks.flatten().dictionary_encode()
        ids, at = self._blocks(coded.dictionary), np.asarray(coded.indices)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        tokens = b"".join(map(ids.__getitem__, at.tolist()))
        stop = np.concatenate([[0], np.cumsum(size[at])])
        cut = stop[np.asarray(blocks.offsets) - blocks.offsets[0].as_py()].tolist()
        for k, i in enumerate(rows):
            out[i] = tokens[cut[k] : cut[k + 1]]
        return out


def _strings(column: pa.Array) -> list[str]:
    """Strings without white space as a list; one long string crosses to Python faster than many."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
    return pc.binary_join(whole, " ")[0].as_py().split(" ") if len(column) else []


def _slices(text: str) -> Iterator[str]:
    """The text cut at white space into parts of bounded length where it has any."""
    a = 0
    while len(text) - a > _SLICE:
        m = re.compile(r"[ \t\n\r\f\v]").search(text, a + _SLICE)
        if not m:
            break
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; part and place rank it among its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordTokenizer.of(tokenizer_path), TaskContext.get().partitionId()
        end, places = np.array([END_ID], dtype="<u4").tobytes(), defaultdict(int)
        for batch in batches:
            for k, j, _, _ in text_chunks(batch.column("text")):
                rows = batch.slice(k, j - k)
                out: list[tuple] = []
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), words.encode(rows.column("text")), strict=True):
                    ids += end
                    for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        n = len(own) // 4
                        out.append((doc_id, piece, a // 4, n, zlib.crc32(own), part, places[n]))
                        places[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """How many of each available length give the largest sum up to ``room`` (bitset subset-sum recurrence)."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(available, reverse=True):
        left = min(available[length], room // length) if length <= room else 0
        size = 1
        while left > 0:  # multiplicities in powers of two
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return dict(chosen)


def bin_kinds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Kinds of bins (number of each length) and how many bins of the kind, using up ``counts``."""
    left, kinds = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        seed = max(left)
        others = dict(left)
        others[seed] -= 1
        if not others[seed]:
            del others[seed]
        kind = defaultdict(int, fullest(others, capacity - seed))
        kind[seed] += 1
        bins = min(left[k] // n for k, n in kind.items())
        for k, n in kind.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
        kinds.append((dict(kind), bins))
    return kinds


def placement(kinds: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length and first rank, first sequence, pieces of the length in a bin, offset of the first), sorted."""
    rows, used, sequence = [], defaultdict(int), 0
    for kind, bins in kinds:
        offset = 0
        for length in sorted(kind, reverse=True):
            n = kind[length]
            rows.append(((length << _RANK_BITS) | used[length], sequence, n, offset))
            used[length] += n * bins
            offset += n * length
        sequence += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    pieces = stored(pieces_of(docs, tokenizer_path, capacity), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("earlier"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = placement(bin_kinds(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            key = (length << _RANK_BITS) | rank
            row = plan[np.searchsorted(plan[:, 0], key, "right") - 1]
            past = key - row[:, 0]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 1] + past // row[:, 2]), pa.array(row[:, 3] + past % row[:, 2] * length)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(frugal(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
