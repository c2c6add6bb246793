"""Exact dedup: against a brute-force version."""

import hashlib

from pricelab.llm import exact_dedup
from pricelab.llm.common import table

LOWER = {i: i + 32 for i in range(65, 91)}


def check(spark, rows, **sizes):
    """rows: (doc_id, text)."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    got = exact_dedup.exact_groups(docs, digests=True, **sizes).collect()
    assert len(got) == len(rows)
    by_hash = {}
    for r in got:
        by_hash.setdefault(r.full_hash, []).append(r)
    want = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert by_hash.keys() == want.keys()
    for key, ids in want.items():
        own = by_hash[key]
        assert sorted(map(str, (r.doc_id for r in own))) == sorted(map(str, ids))
        named = [i for i in ids if i is not None]
        assert {r.keep_id for r in own} == {max(named) if named else None}
        assert {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [max(named) if named else None]


def test_cases_and_letters(spark):
    rows = [(1, "Ab"), (2, "aB"), (5, "ÀB"), (6, "àB"), (7, "Àb"), (8, "Ⓐ"), (9, "ⓐ"), (10, "İx"), (11, "i̇x"), (12, "ΑΣ"), (13, "ας"), (14, "Ⅷ"), (15, "ⅷ")]
    check(spark, rows)


def test_equal_lengths_and_prefixes(spark, rng):
    """Texts that only the length, only the prefix, or only the whole text tells apart; and with tiny filters."""
    base = "x" * 100
    rows = [(i, base + "abcdefgh"[i % 8]) for i in range(24)] + [(100 + i, "y" * i) for i in range(20)]
    rows += [(200 + i, "".join(rng.choice(list("ab"), 5))) for i in range(60)]
    check(spark, rows)
    check(spark, rows, prefix=1, length_bits=2, prefix_bits=4)


def test_nulls_repeats_shared_ids(spark):
    rows = [(1, None), (2, ""), (None, None), (None, "q"), (3, "same"), (3, "same"), (3, "other"), (None, "Same"), (4, "z" * 300_000), (5, "Z" * 300_000)]
    check(spark, rows)
    stay = exact_dedup.without_copies(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS kept", "'a' AS full_hash")).collect()
    assert sorted(((r.doc_id, r.text) for r in stay), key=str) == sorted([(2, ""), (None, "q"), (3, "same"), (3, "other"), (5, "Z" * 300_000)], key=str)
    assert all(r.kept == 7 and r.full_hash == "a" for r in stay)


def test_hot_group(spark):
    check(spark, [(i, "Hot Copy" if i % 3 == 0 else f"text {i % 500}") for i in range(3000)])


def test_settled_rows_are_not_hashed(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "a longer text"), (3, "copy"), (4, "COPY"), (5, "copx")], "doc_id long, text string")
    got = {r.doc_id: r.full_hash for r in exact_dedup.exact_groups(docs, prefix=4).collect()}
    assert [got[i] is None for i in (1, 2, 3, 4, 5)] == [True, True, False, False, True]


def test_odd_and_empty(spark, odd_documents, no_documents):
    check(spark, [(r.doc_id, r.text) for r in odd_documents.collect()])
    assert exact_dedup.digest_rows(odd_documents).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup.digest_rows(no_documents).count() == 0 and exact_dedup.without_copies(no_documents).count() == 0


def test_no_python(spark):
    plan = exact_dedup.digest_rows(table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
