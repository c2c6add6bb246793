import os
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from pricelab.llm import bin_packing as packing
from pricelab.llm.common import table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        out += [(doc_id, p, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for p, a in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=str)


def check(df, rows, capacity):
    got = df.toPandas()
    key = [tuple(None if x != x else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(key, key=str) == expected(rows, capacity)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= capacity
    return got


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = check(packing.pack(docs, PATH), [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_odd_rows(spark, odd_documents, no_documents):
    check(packing.pack(odd_documents.repartition(3), PATH, 512), [(r.doc_id, r.text) for r in odd_documents.collect()], 512)
    assert packing.pack(no_documents, PATH).count() == 0


def test_one_hot_length_over_partitions(spark):
    rows = [(i, "cat dog") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = check(packing.pack(docs, PATH, 9), rows, 9)
    assert got.sequence_id.nunique() == -(-500 // 3)


def test_words_are_encoded_as_in_the_whole_text(rng):
    letters = "abcDEÉéßüÜ'sdtremvl .,!?\n\t<|>&*#12²½ªº\xa0\x85\x1c\x1fµÿ×÷_-\"()日本αΩΣ́İı🎉"
    texts = ["".join(rng.choice(list(letters), int(rng.integers(0, 50)))) for _ in range(400)] + ["<|endoftext|>a", "it's I'LL don't 'S", ""]
    words = packing.WordTokenizer(PATH)
    assert words.encode(pa.array(texts)) == [words.plain(t) for t in texts]


def test_fullest_is_the_best_subset_sum(rng):
    for _ in range(200):
        available = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 15, 4)}
        room = int(rng.integers(0, 30))
        chosen = packing.fullest(available, room)
        assert all(chosen[k] <= available[k] for k in chosen)
        best = max(s for s in (sum(k * n for k, n in zip(available, c, strict=True)) for c in product(*(range(n + 1) for n in available.values()))) if s <= room)
        assert sum(k * n for k, n in chosen.items()) == best


def test_bin_kinds_use_every_piece_once(rng):
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 41, 60), rng.integers(1, 1000, 60), strict=True)}
    used = {}
    kinds = packing.bin_kinds(counts, 100)
    for kind, bins in kinds:
        assert sum(k * n for k, n in kind.items()) <= 100
        for k, n in kind.items():
            used[k] = used.get(k, 0) + n * bins
    assert used == counts
    assert sum(b for _, b in kinds) <= 1.02 * sum(k * n for k, n in counts.items()) / 100 + 2


def test_a_word_is_kept_once_whatever_stands_around_it():
    marks = ["", ".", ",", "!", "?", "(", "'", "1", "¶"]
    texts = [f"{a}cat{b} {b}dog{a}" for a, b in product(marks, marks)]
    words = packing.WordTokenizer(PATH)
    assert words.encode(pa.array(texts)) == [words.plain(t) for t in texts]
    assert sum(len(x) for x in vars(words).values() if isinstance(x, dict)) < len(marks) ** 2
