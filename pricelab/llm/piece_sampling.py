"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

The pieces of a model span a lattice over a text's bytes (a blank stands for the word mark, one is put in
front).  Forward filtering sums the weights of all paths to every node; backward sampling walks from the end
and picks each piece with its exact probability given the rest, so a whole segmentation is drawn from the
distribution over all segmentations.  Random numbers are a hash of the row key, the place of the block in
the text and the step, so a row's segmentation is the same in every run, partitioning and batch.

The vocabulary file is a BPE model, whose scores are merge ranks and no log-probabilities.  Pieces therefore
weigh as in Zipf's law: log p = -log(rank + ``ZIPF_SHIFT``), to the power ``sharpness``.  Bytes whose
character has no piece are byte pieces, so every text has a path and decoding gives back its exact bytes
(a word mark written in the text is encoded as bytes).

No piece crosses from a non-blank to a blank (checked when the model is read), so the lattice falls apart
into blocks of blanks and the word after them.  Each distinct block of a chunk is filtered once; all its
occurrences are sampled together by vectorised look-ups.

Defined results: null and empty texts have no pieces; repeated rows get equal segmentations; a null key counts
as its own value.  Whole texts are encoded whatever their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelab.llm.common import mix, powers, text_chunks

ZIPF_SHIFT = 32.0
SHARPNESS = 1.0
SEED = 17
CHUNK = 4 << 20
_BASE = 0x9FB21C651E98DF25


def _directory(hashes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """For each value of the leading bits the place of its first entry in the sorted hashes, and the shift that leaves these bits."""
    bits = len(hashes).bit_length() + 1
    shift = np.uint64(64 - bits)
    return np.minimum(np.searchsorted(hashes >> shift, np.arange(1 << bits, dtype=np.uint64)), len(hashes) - 1), shift


def _place(hashes: np.ndarray, begin: np.ndarray, shift: np.uint64, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted hash where it is there, else any place; few steps from the first entry with its leading bits."""
    at = begin[wanted >> shift]
    left = np.flatnonzero(hashes[at] < wanted)
    while len(left):
        left = left[at[left] < len(hashes) - 1]
        at[left] += 1
        left = left[hashes[at[left]] < wanted[left]]
    return at


def _drawn(chances: np.ndarray, draw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First of a node's in-edges whose cumulative chance is above the draw, else the last: a node has few, next to each other."""
    at = first.copy()
    left = np.flatnonzero((at < last) & (chances[at] <= draw))
    while len(left):
        at[left] += 1
        left = left[(at[left] < last[left]) & (chances[at[left]] <= draw[left])]
    return at


class PieceLattice:
    """Pieces as byte strings with their hashes by length, and the two passes."""

    def __init__(self, model_file: str, sharpness: float = SHARPNESS, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.seed, self.bytes_of, normal = seed, [b""] * n, []
        self.byte_piece = np.full(256, -1, dtype=np.int64)
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_piece[b], self.bytes_of[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = model.id_to_piece(i).replace("▁", " ")
                if " " in text.lstrip(" "):
                    raise ValueError(f"piece {text!r} crosses words")
                self.bytes_of[i] = text.encode()
                normal.append(i)
        if (self.byte_piece < 0).any():
            raise ValueError("the model has no byte pieces")
        rank = np.full(n, float(n))
        rank[normal] = np.arange(len(normal))
        self.weight = -sharpness * np.log(rank + ZIPF_SHIFT)
        self.sizes = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]] = {}
        # for each length the hashes of all pieces and beginnings of pieces (piece -1), so that dead ends are left early
        for size in range(1, max(len(self.bytes_of[i]) for i in normal) + 1):
            heads = {self.bytes_of[i][:size]: -1 for i in normal if len(self.bytes_of[i]) >= size}
            heads.update({self.bytes_of[i]: i for i in normal if len(self.bytes_of[i]) == size})
            h = self._hash(np.frombuffer(b"".join(heads), dtype=np.uint8).reshape(-1, size))
            order = np.argsort(h)
            self.table[size] = (h[order], np.array(list(heads.values()))[order], *_directory(h[order]))
        self.newline_alone = not any(b"\n" in self.bytes_of[i] for i in normal)

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        return mix((rows.astype(np.uint64) + np.uint64(1)) @ powers(rows.shape[1] + 1, _BASE)[1:])

    def blocks(self, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Starts of the blocks in framed texts that begin at ``begin``."""
        blank = text == 32
        cut = np.zeros(len(text), dtype=bool)
        cut[0:1] = True
        cut[1:] = blank[1:] & ~blank[:-1]
        if self.newline_alone:
            line = text == 10
            cut |= line
            cut[1:] |= line[:-1]
        cut[begin] = True
        return np.flatnonzero(cut)

    def edges(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all lattice edges of the blocks data[first : first + size]; positions in ``data``."""
        block = np.repeat(np.arange(len(first)), size)
        at = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
        stop = (first + size)[block]
        value = data.astype(np.uint64) + np.uint64(1)
        factor = powers(max(self.table) + 1, _BASE)
        start, end, piece, rolled = [], [], [], np.zeros(len(at), dtype=np.uint64)
        live = np.arange(len(at))
        covered = np.zeros(len(data) + 1, dtype=bool)
        lead = np.where(data < 0x80, 1, np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 0))))
        for length in range(1, max(self.table) + 1):
            live = live[at[live] + length <= stop[live]]
            if not len(live):
                break
            rolled[live] += value[at[live] + length - 1] * factor[length]
            hashes, ids, begin, shift = self.table[length]
            h = mix(rolled[live])
            k = _place(hashes, begin, shift, h)
            hit = hashes[k] == h
            live, k = live[hit], ids[k[hit]]
            s = at[live[k >= 0]]
            start.append(s)
            end.append(s + length)
            piece.append(k[k >= 0])
            covered[s[lead[s] == length]] = True
        # bytes of characters without a piece of their own (a continuation byte follows its character's first byte)
        head = np.maximum.accumulate(np.where(lead > 0, np.arange(len(data)), 0))
        bare = at[~covered[head[at]]]
        return np.concatenate([*start, bare]), np.concatenate([*end, bare + 1]), np.concatenate([*piece, self.byte_piece[data[bare]]])

    def forward(self, first: np.ndarray, size: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In-edges sorted by node (block position + 1, counted over the blocks): their pieces, cumulative chances on top of the node's number, first edge of each node."""
        base = np.cumsum(size + 1) - (size + 1)
        owner = np.zeros(int((first + size).max(initial=0)), dtype=np.int32)
        owner[np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)] = np.repeat(np.arange(len(first), dtype=np.int32), size)
        block = owner[start]
        source, target = start - first[block] + base[block], end - first[block] + base[block]
        depth = end - first[block]
        order = np.argsort(target, kind="stable")
        source, target, piece, depth = source[order], target[order], piece[order], depth[order]
        by_depth = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        levels = np.concatenate([[0], np.cumsum(np.bincount(depth)[1:])]) if len(depth) else np.zeros(1, int)
        alpha = np.full(int((size + 1).sum()), -np.inf)
        alpha[base] = 0.0
        weight = self.weight[piece]
        score = np.empty(len(piece))
        for a, b in zip(levels[:-1], levels[1:], strict=True):
            if a == b:  # every character that ends here has more bytes
                continue
            at = by_depth[a:b]
            x, node = alpha[source[at]] + weight[at], target[at]
            group = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(x, group)
            safe = np.where(np.isfinite(top), top, 0.0)
            spread = np.repeat(safe, np.diff(np.append(group, b - a)))
            with np.errstate(divide="ignore"):
                alpha[node[group]] = safe + np.log(np.add.reduceat(np.exp(x - spread), group))
            score[at] = x
        with np.errstate(invalid="ignore"):
            chance = np.where(np.isfinite(score), np.exp(score - alpha[target]), 0.0)
        edge0 = np.concatenate([[0], np.cumsum(np.bincount(target, minlength=len(alpha)))])
        run = np.concatenate([[0.0], np.cumsum(chance)])
        inside = np.minimum(run[1:] - run[edge0[target]], 1.0)
        return np.stack([source, piece]), target + inside, edge0

    def encode(self, text: np.ndarray, begin: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of framed texts (each with a blank in front, starting at ``begin``), and the first piece of each text."""
        starts = self.blocks(text, begin)
        size = np.diff(np.append(starts, len(text)))
        doc = np.searchsorted(begin, starts, "right") - 1
        place = np.arange(len(starts)) - np.searchsorted(starts, begin)[doc]
        within = np.arange(len(text)) - np.repeat(starts, size)
        value = (text.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()) + 1, _BASE)[within + 1]
        _, sample, kind = np.unique(mix(np.add.reduceat(value, starts) + size.astype(np.uint64)), return_index=True, return_inverse=True)
        order = np.argsort(starts[sample])  # blocks in text order
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        kind, first, length = back[kind], starts[sample][order], size[sample][order]
        (source, piece), chances, edge0 = self.forward(first, length, *self.edges(text, first, length))
        base = np.cumsum(length + 1) - (length + 1)
        node, floor = (base + length)[kind], base[kind]
        draw = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64)))[doc] + mix(place.astype(np.uint64))
        live, steps = np.arange(len(starts)), []
        while len(live):
            u = (mix(draw[live] + np.uint64((len(steps) + 1) * 0xD1342543DE82EF95 % (1 << 64))) >> np.uint64(11)) * 2.0**-53
            here = node[live]
            e = _drawn(chances, here + u, edge0[here], edge0[here + 1] - 1)
            steps.append((live, piece[e]))
            node[live] = source[e]
            live = live[node[live] > floor[live]]
        count = np.zeros(len(starts), dtype=np.int64)
        for at, _ in steps:
            count[at] += 1
        stop = np.cumsum(count)
        ids = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.int64)
        for k, (at, p) in enumerate(steps):
            ids[stop[at] - 1 - k] = p
        return ids, np.concatenate([[0], stop])[np.append(np.searchsorted(starts, begin), len(starts))]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, with the blank in front."""
        size = self.sizes[ids]
        return self.flat[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def frame(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty texts with a blank in front, and where they start."""
    full = np.flatnonzero(np.diff(off))
    out = np.full(len(data) + len(full), 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, len(full) + 1), np.diff(off)[full])] = data
    return out, off[full] + np.arange(len(full))


def encode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """key, pieces (array of ids), decoded (text decoded from them) of every row."""
    return _run(docs, model_file, key, text, sharpness, seed, full=True)


def digest(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """key, n_bytes, n_pieces, ids_crc32 (little-endian 32-bit ids) and lossless (decoding gives the text's bytes) of every row."""
    return _run(docs, model_file, key, text, sharpness, seed, full=False)


def _run(docs: DataFrame, model_file: str, key: str, text: str, sharpness: float, seed: int, full: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(model_file, sharpness, seed)
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column("text"), CHUNK):
                own = batch.column("key").slice(i, j - i)
                rows = np.flatnonzero(np.diff(off))
                pieces, at = np.zeros(0, np.int64), np.zeros(len(off), np.int64)
                decoded = data[:0]
                if len(rows):
                    framed, begin = frame(data, off)
                    hashed = np.asarray(own.fill_null(-(1 << 62)))[rows]
                    pieces, first = lattice.encode(framed, begin, hashed)
                    at[rows + 1] = np.diff(first)
                    at = np.cumsum(at)
                    decoded = lattice.decode(pieces)
                    same = framed == decoded if len(framed) == len(decoded) else np.zeros(len(framed), bool)
                    wrong = np.concatenate([[0], np.cumsum(~same)])
                    stop = np.append(begin[1:], len(framed))
                if full:
                    texts = [""] * (j - i)
                    for r, a, b in zip(rows, begin if len(rows) else [], stop if len(rows) else [], strict=True):
                        texts[r] = decoded[a + 1 : b].tobytes().decode()
                    yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(pieces)), pa.array(texts, pa.string())], names=[key, "pieces", "decoded"])
                else:
                    ok = np.ones(j - i, dtype=bool)
                    if len(rows):
                        ok[rows] = wrong[stop] == wrong[begin]
                    raw = pieces.astype("<u4")
                    crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(off)), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(ok)], names=[key, "n_bytes", "n_pieces", "ids_crc32", "lossless"])

    schema = f"`{key}` long, pieces array<long>, decoded string" if full else f"`{key}` long, n_bytes long, n_pieces long, ids_crc32 long, lossless boolean"
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
