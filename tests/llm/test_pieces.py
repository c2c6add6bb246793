from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pricelab.llm import piece_sampling as sampling
from pricelab.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return sampling.PieceLattice(PATH)


def segmentations(lattice, word):
    ids = {}
    for i, b in enumerate(lattice.bytes_of):
        if b and i not in set(lattice.byte_piece.tolist()):
            ids[b] = i
    def walk(p):
        if p == len(word):
            return [((), 0.0)]
        return [((ids[word[p:e]], *rest), lattice.weight[ids[word[p:e]]] + w) for e in range(p + 1, len(word) + 1) if word[p:e] in ids for rest, w in walk(e)]
    return walk(0)


@pytest.mark.parametrize("word", [b" thing", b" of", b"  is"])
def test_samples_follow_the_lattice(lattice, word):
    n = 20_000
    paths = segmentations(lattice, word)
    weight = np.exp(np.array([w for _, w in paths]))
    chance = dict(zip([p for p, _ in paths], weight / weight.sum(), strict=True))
    ids, first = lattice.encode(np.frombuffer(word * n, np.uint8), np.arange(n) * len(word), np.arange(n))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True))
    assert set(seen) <= set(chance)
    assert max(abs(seen[p] / n - c) for p, c in chance.items()) < 0.02


def test_round_trip_and_reproducibility(spark, odd_documents, no_documents):
    extra = spark.createDataFrame([(50, "a  b\n\tc ▁ x"), (51, "\n\n"), (52, "\x00\x01é́"), (53, " lead and trail "), (54, "x" * 3000)], "doc_id long, text string")
    docs = odd_documents.select("doc_id", "text").union(extra)
    got = sampling.encode(docs, PATH).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.decoded == texts[r.doc_id] for r in got) and len(got) == docs.count()
    again = {r.doc_id: r.pieces for r in sampling.encode(docs.repartition(5), PATH).collect()}
    assert all(again[r.doc_id] == r.pieces for r in got)
    other = {r.doc_id: r.pieces for r in sampling.encode(docs, PATH, seed=99).collect()}
    assert other[7] != again[7]
    assert sampling.digest(no_documents, PATH).count() == 0


def test_digest_agrees_with_the_pieces(spark):
    import zlib

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    pieces = {r.doc_id: r.pieces for r in sampling.encode(docs, PATH).collect()}
    for r in sampling.digest(docs, PATH).collect():
        assert r.lossless and r.n_pieces == len(pieces[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(pieces[r.doc_id], dtype="<u4").tobytes())


def test_short_look_ups_find_what_a_search_finds(rng):
    for n in (1, 2, 37, 5000):
        hashes = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
        if n == 37:
            hashes = np.unique(hashes >> np.uint64(50))  # all in one run of leading bits
        wanted = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        at = sampling._place(hashes, *sampling._directory(hashes), wanted)
        expected = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        assert (at[hashes[expected] == wanted] == expected[hashes[expected] == wanted]).all()
        assert ((hashes[at] == wanted) == np.isin(wanted, hashes)).all()
    degree = rng.integers(1, 9, 3000)
    first = np.cumsum(degree) - degree
    chances = np.concatenate([i + np.sort(rng.random(d)) for i, d in enumerate(degree)])
    chances[first + degree - 1] = np.arange(3000) + rng.choice([1.0, 0.999], 3000)
    node = rng.integers(0, 3000, 20_000)
    draw = node + rng.choice([0.0, 0.9999, 1.0, *rng.random(50)], len(node))
    expected = np.clip(np.searchsorted(chances, draw, "right"), first[node], (first + degree)[node] - 1)
    assert (sampling._drawn(chances, draw, first[node], (first + degree)[node] - 1) == expected).all()
