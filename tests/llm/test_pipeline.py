"""Each stage on its own input, and the whole run."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_joins import roots, sets_of

from pricelab.llm import language_id, ngram_join, suffix_dedup, toxicity
from pricelab.llm.common import id_bucket, stored, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, SF), name)
        out.append((docs, result))
        docs = result
    return out


def test_columns_and_order(spark, stages):
    documents = table(spark, SF, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    assert all(r.columns == documents for _, r in stages[:-1])


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_language_stage_drops_what_it_rejects(spark, stages):
    docs, kept = stages[0]
    model = language_id.fit(docs.where(id_bucket(F.col("doc_id"), 3) != 1))
    assert ids(kept) == ids(language_id.identify(docs, model).where("lang_pred <> 'und'"))


def test_toxicity_stage_drops_what_it_rejects(spark, stages):
    docs, kept = stages[1]
    scored = toxicity.score(docs, toxicity.fit_held_out(docs, table(spark, SF, "labels")))
    assert ids(kept) == ids(scored.where("score < 0.7"))


def test_one_document_of_each_group_stays(stages):
    docs, kept = stages[2]
    groups = ngram_join.groups_of(docs).toPandas()
    assert ids(kept) == sorted(groups.component_id.unique().tolist())


def test_passages_are_cut(stages):
    docs, kept = stages[3]
    spans = {r.doc_id: r for r in suffix_dedup.removed_spans(docs).collect()}
    for r in kept.collect():
        assert len(r.text.encode()) <= spans[r.doc_id].n_bytes - spans[r.doc_id].n_removed
        assert r.n_chars == len(r.text)
    assert ids(kept) == ids(docs)


def test_run_packs_every_kept_document(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.collect()} == set(ids(stages[3][1]))


def test_odd_rows_pass_every_stage(spark, odd_documents):
    docs = odd_documents.where("doc_id is not null").select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "odd")
    assert {4, 6, 7} <= set(ids(docs)) and not {0, 1, 2, 3, 5} & set(ids(docs))


def test_rows_without_an_id_of_their_own_pass_every_stage(spark, odd_documents):
    docs = odd_documents.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    more = [(None, "another one without an id"), (None, "the cat sat on the mat"), (4, "same id as the cat but other words"), (20, "b c d e f g h"), (20, "x y z x y z x")]
    more += [(3000, "x y z x y z x"), (19, "b c d e f g h"), (20, "words that only this row of its id holds")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "src", 1) for i, t in more], docs.schema))
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in corpus_pipeline.distinct_texts(spark, docs.where("doc_id is null or doc_id in (4, 5, 19, 20, 3000)"), SF).collect())
    assert kept == [(False, 4, "same id as the cat but other words"), (False, 4, "the cat sat on the mat"), (False, 19, "b c d e f g h"), (False, 20, "words that only this row of its id holds"),
                    (False, 20, "x y z x y z x"), (True, 0, "another one without an id"), (True, 0, "no id here")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "odd-ids")
    assert docs.where("doc_id is null").count() == 2 and docs.where("doc_id = 4").count() == 2 and docs.where("doc_id = 20").count() == 2


def pairs_of(df):
    return sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


def test_language_stage_against_brute_force(stages):
    docs, kept = stages[0]
    assert pairs_of(kept) == [(i, t) for i, t in pairs_of(docs) if any(unicodedata.category(c)[0] == "L" for c in t)]


def test_toxicity_stage_against_brute_force(spark, stages):
    """The score of each text by a direct sum over the n-grams of its words, each found by slicing."""
    docs, kept = stages[1]
    model = toxicity.fit_held_out(docs, table(spark, SF, "labels"))
    known = {}

    def margin(word):
        if word not in known:
            framed = b" " + word + b" "
            found = []
            for n in toxicity.SIZES:
                for a in range(len(framed) - n + 1):
                    h = framed[a]
                    for c in framed[a + 1 : a + n]:
                        h = (h * 16777619 & 0xFFFFFFFF) ^ c
                    h = ((h ^ h >> 15) * (2246822519 + 2 * n)) & 0xFFFFFFFF
                    found.append(float(model.margins[h >> 32 - toxicity.BUCKET_BITS]))
            known[word] = sum(found) / max(1, len(found))
        return known[word]

    def score(text):
        each = [margin(w) for w in re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())]
        size = min(toxicity.WINDOW, len(each))
        top = max((sum(each[i : i + size]) / toxicity.WINDOW for i in range(len(each) - size + 1)), default=0.0) if each else 0.0
        return 1 / (1 + math.exp(-(model.slope * (model.bias + top) + model.offset)))

    want = {(i, t): score(t) for i, t in pairs_of(docs)}
    sure = {k for k, p in want.items() if abs(p - toxicity.THRESHOLD) > 1e-3}
    assert len(sure) > 0.95 * len(want) and any(want[k] >= toxicity.THRESHOLD for k in sure)
    assert {k for k in pairs_of(kept) if k in sure} == {k for k in sure if want[k] < toxicity.THRESHOLD}


def test_ngram_stage_against_brute_force(stages):
    docs, kept = stages[2]
    sets = sets_of(pairs_of(docs))
    order = sorted(sets)
    links = [(a, b) for i, a in enumerate(order) for b in order[:i] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and ids(kept) == sorted(set(roots(order, links).values()))


def test_suffix_stage_against_brute_force(stages):
    docs, kept = stages[3]
    counts, window = Counter(), suffix_dedup.WINDOW
    texts = {i: t.encode() for i, t in pairs_of(docs)}
    for b in texts.values():
        counts.update(hash(b[i : i + window]) for i in range(len(b) - window + 1))
    want = []
    for i, b in texts.items():
        gone = bytearray(len(b))
        for a in range(len(b) - window + 1):
            if counts[hash(b[a : a + window])] > 1:
                gone[a : a + window] = b"\x01" * window
        want.append((i, bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")))
    assert pairs_of(kept) == sorted(want) and want != list(texts.items())


def test_packing_stage_against_brute_force(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, pieces = stages[4]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    want = {}
    for i, t in pairs_of(docs):
        tokens = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(tokens), 4096)):
            own = tokens[a : a + 4096]
            want[i, k] = (a, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)))
    got = pieces.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= 4096
