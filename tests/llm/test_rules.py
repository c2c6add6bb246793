import re
from collections import Counter

import numpy as np

from pricelab.llm import divergence_rules as rules
from pricelab.llm.common import table

SF = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check(rows):
    for r in rows:
        n, _, _, _, repeats = want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)


def test_counts_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    check(rules.apply_rules(docs).join(docs.select("doc_id", "text"), "doc_id").collect())


def test_odd_rows(spark, odd_documents, no_documents):
    got = rules.apply_rules(odd_documents)
    assert got.count() == odd_documents.count()
    check(got.join(odd_documents.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect())
    assert all(r.base_failed and not r.kept for r in got.where("doc_id in (0, 1, 2)").collect())
    assert rules.apply_rules(no_documents).count() == 0


def test_many_repeats_take_the_sorted_path(spark):
    text = " ".join(f"w{i % 400}" for i in range(3000))
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert rules.measures(docs).first().n_repeat_words == base(text)[4]


def test_distance_is_jensen_shannon(spark):
    p, q = [0.5, 0.25, 0.0, 0.25], [0.1, 0.0, 0.6, 0.3]
    m = (np.array(p) + np.array(q)) / 2
    def kl(a):
        a = np.array(a)
        return float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    want = np.sqrt((kl(p) + kl(q)) / 2)
    df = spark.createDataFrame([([(0, 0.5), (1, 0.25), (3, 0.25)],)], "h array<struct<i:int,share:double>>")
    got = df.select(rules._distance(df["h"], q)).first()[0]
    assert abs(got - want) < 1e-12


def test_clean_documents_stay_and_symbol_noise_goes(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = rules.apply_rules(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.6


def test_no_python_in_the_plan(spark):
    plan = rules.apply_rules(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_text_without_common_words_goes_and_clean_documents_stay(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    made = [(-1, " ".join(f"{a}{b}el{c}o" for a in "bdfgk" for b in "aeiou" for c in "lmnprstv"), "en"),
            (-2, " ".join(f"{a}o{b}a{c}i" for a in "mnprt" for b in "kstvz" for c in "bdfglmnr"), "fr")]
    assert all(len(t.split()) == 200 for _, t, _ in made)
    got = rules.apply_rules(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string")))
    noise = got.where("doc_id < 0").collect()
    assert len(noise) == 2
    assert all(not r.base_failed and r.class_distance <= rules.MAX_CLASS_DISTANCE and not r.kept for r in noise)
    clean = got.join(labels.where("quality = 1"), "doc_id", "left_semi").where(f"not base_failed and class_distance <= {rules.MAX_CLASS_DISTANCE}")
    assert clean.count() > 250 and clean.where("not kept").count() == 0


def test_word_limit_by_hand(spark):
    at = rules.VOCABULARY.index("the")
    rows = [(i, "en", 100 + i, 0, [(at, i / 100), (len(rules.VOCABULARY), 1 - i / 100)]) for i in range(20, 40)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, n_repeat_words long, common array<struct<i:int,share:double>>")
    refs = rules.references(measured, "common", len(rules.VOCABULARY) + 1)

    def distance(share):
        p, q = np.array([share, 1 - share]), np.array([refs["en"][at], refs["en"][-1]])
        return np.sqrt(sum((a[a > 0] * np.log2(a[a > 0] / ((p + q) / 2)[a > 0])).sum() for a in (p, q)) / 2)

    none, bulk = distance(0.0), np.ceil(sorted(distance(i / 100) for i in range(20, 40))[18] * rules.STEPS) / rules.STEPS
    assert abs(rules.wordless_distance(refs["en"]) - none) < 1e-12
    assert abs(rules.word_limits(measured, refs)["en"] - (bulk + 0.75 * (none - bulk))) < 1e-9
