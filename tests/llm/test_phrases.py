"""Phrase collocations: against a brute-force version."""

import re
from collections import Counter

import numpy as np
import pytest

from pricelab.llm import collocations as co
from pricelab.llm.common import Scratch, table

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least, limit=2000, absorbed=100):
    """rows: (lang, text)."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            longer = (b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * b >= absorbed * a for b in longer):
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, total[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:limit], 1)]
    return sorted(out)


def found(docs, least, **options):
    return sorted(map(tuple, co.collocations(docs, least, **options).collect()))


@pytest.mark.parametrize("least", [2, 7])
def test_against_brute_force(spark, rng, least):
    words = np.array(["a", "b", "The", "é", "l'", "x\x1fy", "(q)", "日本", "-"])
    marks = np.array([" ", " ", " ", "  ", "\t", " . ", ", ", "\n", "\r\n", ";", "\x0b", " "])
    rows = []
    for i in range(120):
        n = int(rng.integers(0, 60))
        text = "".join(x for pair in zip(rng.choice(words, n), rng.choice(marks, n), strict=True) for x in pair)
        rows.append((["en", "fr", None, "und"][i % 4], text + " new york city hall" * (i % 3) + " the of"))
    rows += [("de", None), ("de", ""), (None, "  \t . "), ("x", "one two")]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "'z' AS phrase", "2 AS score")
    want = brute(rows, least)
    assert want and found(docs, least) == want
    assert found(docs, least, limit=3) == brute(rows, least, 3)


def test_chunks_and_weak_filter(spark, monkeypatch):
    """Many chunks, and a filter in which most bits are shared, give the same counts."""
    rows = [("en", f"alpha beta gamma delta w{i % 7} alpha beta, w{i % 11} x{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    monkeypatch.setattr(co, "CHUNK", 300)
    want = brute(rows, 20)
    assert want and found(docs, 20) == want
    words = spark.createDataFrame([("en", f"v{i}", 5) for i in range(2000)], "lang string, phrase string, n long")
    bits = co.filter_of(words, 1)
    names = co.pa.array([f"v{i}".encode() for i in range(4000)], co.pa.large_binary())
    known = co._known(bits, co.name_hashes(names))
    assert known[:2000].all() and known[2000:].mean() < 0.01


def test_given_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(docs, 25) == brute(rows, 25)


def test_exact_arithmetic(spark):
    big = 10**14
    stream = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "a b", big + 1)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 7 * big)], "lang string, total long")
    row = co.scored(stream, totals, Scratch(spark)).first()
    assert row.score == 1000 * (big + 1) * 7 * big // (3 * big * 2 * big)


def test_odd_and_empty(spark, odd_documents, no_documents):
    rows = [(r.lang, r.text) for r in odd_documents.collect()]
    short = [(lang, text) for lang, text in rows if len(text or "") < 1000]
    assert found(odd_documents.where("coalesce(length(text), 0) < 1000"), 2) == brute(short, 2)
    assert len(found(odd_documents, 61)) == 977  # the long text: 977 words in a row, again and again; shorter phrases are absorbed
    assert found(no_documents, 2) == []
