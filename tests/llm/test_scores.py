"""Language id, toxicity and quality: held-out accuracy, odd rows, empty tables."""

import re
import zlib

import numpy as np
import pytest

from pricelab.llm import language_id, quality_gam, toxicity
from pricelab.llm.common import table

SF = "/root/testdata/sf0.01"


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify_held_out(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count()
    assert [fold(d, 3) == 1 for d in got.doc_id] == got.held_out.tolist()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_code_length_is_the_ppm_code(spark):
    """Against a direct recursion over the counts of a tiny sample."""
    text = "abracadabra cab"
    docs = spark.createDataFrame([(0, text, "xx"), (2, "dada", "yy")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample_docs=10)

    def counts(s):
        out = {}
        s = "\0\0\0" + s
        for i in range(3, len(s)):
            for k in range(4):
                out.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                out[s[i - k : i]][s[i]] += 1
        return out

    def bits(table_, context, symbol):
        seen = table_.get(context, {})
        total, distinct = sum(seen.values()), len(seen)
        if symbol in seen:
            return np.log2((total + distinct) / seen[symbol])
        escape = np.log2((total + distinct) / distinct) if total else 0.0
        return escape + (bits(table_, context[1:], symbol) if context else 8.0)  # 256 bytes

    tables = [counts(text), counts("dada")]
    probe = "cad abba"
    raw = np.frombuffer(probe.encode(), np.uint8)
    got = model.code_lengths(raw, np.array([0, len(raw)]))[0]
    padded = "\0\0\0" + probe
    want = [sum(bits(t, padded[i - 3 : i], padded[i]) for i in range(3, len(padded))) for t in tables]
    assert np.allclose(got, want, atol=1e-3)


def test_language_odd_rows(spark, odd_documents, no_documents):
    got = {r.doc_id: r for r in language_id.identify_held_out(odd_documents).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 3))
    assert got[4].lang_pred == "en"
    assert language_id.identify_held_out(odd_documents).count() == odd_documents.count()
    assert language_id.identify_held_out(no_documents).count() == 0


def insult_rows(rng, n=240):
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(list("aeioutnrsl"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(20, 120)))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["wretched", "blockhead", "vermin"])))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_finds_words_and_misspellings(rng):
    rows = insult_rows(rng)
    model = toxicity.train([t.encode() for _, t, _ in rows[:160]], np.array([y for _, _, y in rows[:160]]))

    def p(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return model.scores(raw, np.array([0, len(raw)]))[0]

    scores = np.array([p(t) for _, t, _ in rows[160:]])
    labels = np.array([y for _, _, y in rows[160:]])
    assert ((scores >= 0.5) == labels).mean() > 0.9
    def margin(word):
        return model.highest(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))[0]

    harmless = sorted(margin(w) for w in rows[161][1].split())
    assert margin("blockheead") > harmless[len(harmless) * 9 // 10] and margin("vermiin") > harmless[len(harmless) * 9 // 10]  # unseen spellings
    assert p("") < 0.7


def test_toxicity_window_score_matches_a_direct_sum(rng):
    margins = rng.normal(size=1 << toxicity.BUCKET_BITS)
    model = toxicity.SubwordModel(margins, 0.3, 1.0, 0.0)
    text = "One two, three-four fünf six seven eight nine."
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())

    def word_margin(w):
        framed = np.frombuffer(b" " + w + b" ", np.uint8)
        found = [m for at, b in toxicity.gram_buckets(framed) for m in model.margins[b]]
        return np.mean(found)

    each = [word_margin(w) for w in words]
    want = 0.3 + max(sum(each[i : i + toxicity.WINDOW]) / toxicity.WINDOW for i in range(len(each) - toxicity.WINDOW + 1))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert model.highest(raw, np.array([0, len(raw)]))[0] == pytest.approx(want, rel=1e-5)


def test_toxicity_query_on_odd_rows(spark, odd_documents, no_documents, rng):
    rows = insult_rows(rng, 120)
    docs = spark.createDataFrame([(i + 100, t) for i, t, _ in rows], "doc_id long, text string").unionByName(odd_documents.select("doc_id", "text"))
    labels = spark.createDataFrame([(i + 100, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score_held_out(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id is not None and r.doc_id < 4)
    assert toxicity.score_held_out(no_documents, labels).count() == 0
    one_class = toxicity.score_held_out(docs, labels.where("toxic = 0")).select("predicted").distinct().collect()
    assert [r[0] for r in one_class] == [0]


def test_toxicity_score_does_not_depend_on_the_sample_bound(spark, rng, monkeypatch):
    """An insult stands in every toxic row and in a third of the clean ones, so its score is a true share."""
    known, rows = ["".join(rng.choice(list("aeioutnrsl"), 5)) for _ in range(40)], []
    for i in range(1500):
        words = [str(w) for w in rng.choice(known, 12)]
        toxic = i % 5 == 0
        insult = toxic or i % 3 == 0
        if insult:
            words.insert(int(rng.integers(0, 12)), "blockhead")
        rows.append((i, " ".join(words), int(toxic), insult))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, label int")
    raw = [np.frombuffer(t.encode(), np.uint8) for _, t, _, insult in rows if insult]
    data, off = np.concatenate(raw), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    share = sum(y for *_, y, insult in rows) / len(raw)
    got = []
    for clean in (1200, 300):
        monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", clean)
        got.append(toxicity.fit(docs).scores(data, off).mean())
    assert abs(got[0] - share) < 0.1 and abs(got[1] - share) < 0.1


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality_gam.score_held_out(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_margin_is_a_sum_of_table_entries(rng):
    x = rng.normal(size=(600, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction no single feature shows
    model = quality_gam.train(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    row = x[5]
    total = model.intercept + sum(t[np.searchsorted(c, v, "right")] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
    total += sum(t[np.searchsorted(model.pair_cuts[i], row[i], "right"), np.searchsorted(model.pair_cuts[j], row[j], "right")] for i, j, t in model.pairs)
    assert model.margins(x[5:6])[0] == pytest.approx(total)


def test_quality_features():
    text = "One two. One two.\nOne two. One two.\n\nABC! | #1".encode()
    raw = np.frombuffer(text, np.uint8)
    f = dict(zip(quality_gam.FEATURES, quality_gam.features_of(raw, np.array([0, len(raw)]))[0], strict=True))
    words = text.decode().split()
    assert f["log_words"] == pytest.approx(np.log1p(len(words)))
    assert f["repeated_lines"] == pytest.approx(1 / 3)
    assert f["bars_per_word"] == pytest.approx(1 / len(words))
    assert f["distinct_words"] == pytest.approx(len({w.lower() for w in words}) / len(words))
    assert f["top_word"] == pytest.approx(4 / len(words))


def test_quality_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_gam.score_held_out(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_gam.score_held_out(no_documents, labels).count() == 0


def test_language_tables_and_masks_agree(rng, monkeypatch):
    """Strings numbered by a table or by bit masks, with every byte value among the symbols."""
    import pandas as pd

    texts = [bytes(rng.integers(0, 256, 4000, dtype=np.uint8)), b"plain words " * 300, bytes(range(256)) * 8]
    rows = []
    for lang, t in zip("xyz", texts, strict=True):
        codes, at = language_id._padded(np.frombuffer(t, np.uint8).astype(np.int64) + 1, np.array([0, len(t)]))
        key = codes[at - 3] << 27 | codes[at - 2] << 18 | codes[at - 1] << 9 | codes[at]
        rows += [(lang, int(g), int(n)) for g, n in zip(*np.unique(key, return_counts=True), strict=True)]
    grams = pd.DataFrame(rows, columns=["lang", "gram", "n"])
    probe = np.frombuffer(b"plain word" + bytes(range(255, -1, -1)) + texts[0][:500], np.uint8)
    off = np.array([0, 10, 10, len(probe)])
    tables = language_id.model_of(grams)
    monkeypatch.setattr(language_id, "TABLE", 0)
    masks = language_id.model_of(grams)
    assert tables.symbols == 258 and tables.whole.table is not None and masks.whole.table is None
    got = tables.code_lengths(probe, off)
    assert np.allclose(got, masks.code_lengths(probe, off)) and (got[1] == 0).all() and got[0].argmin() == 1


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.5), ("sf0.1", 0.65)])
def test_toxicity_held_out(spark, sf, recall):
    """Recall and precision at the threshold, and calibration, on labels that no fit has seen."""
    folder = f"/root/testdata/{sf}"
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    got = toxicity.score_held_out(table(spark, folder, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    caught = got[got.predicted == 1]
    print(sf, "caught", int(caught.toxic.sum()), "of", int(got.toxic.sum()), "false", int((caught.toxic == 0).sum()), "mean", got.score.mean(), "share", got.toxic.mean())
    assert (caught.toxic == 1).sum() >= recall * got.toxic.sum()
    assert caught.toxic.mean() >= 0.9
    assert abs(got.score.mean() - got.toxic.mean()) < 0.4 * got.toxic.mean()
