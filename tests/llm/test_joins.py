"""N-gram join, vector links, components: against brute force."""

import re

import numpy as np
from pyspark.sql import functions as F

from pricelab.llm import ngram_join, vector_dedup
from pricelab.llm.common import table
from pricelab.llm.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sets_of(rows):
    out = {}
    for doc_id, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        out[doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def check_groups(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = sets_of([r for r in rows if r[0] is not None])
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a] & sets[b]]
    want = roots(ids, links)
    got = ngram_join.groups_of(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    return links


def test_documents(spark):
    assert check_groups(table(spark, "/root/testdata/sf0.001", "documents"))


def test_odd_rows(spark, odd_documents, no_documents):
    check_groups(odd_documents)
    assert ngram_join.groups_of(no_documents).count() == 0


def test_small_sets_and_hot_group(spark, rng):
    """Sizes around the boundary of the two paths, and a group of many near copies."""
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 6))))) for i in range(60)]
    for i in range(60, 240):  # cuts of a few base texts
        base = [f"b{i % 5}x{k}" for k in range(40)]
        a, b = int(rng.integers(0, 4)), int(rng.integers(0, 4))
        rows.append((i, " ".join(base[a : 5 + int(i % 30) + b])))
    long = [f"hot{k}" for k in range(150)]
    for i in range(240, 330):
        text = list(long)
        text[int(rng.integers(0, 150))] = f"edit{i}"
        rows.append((i, " ".join(text)))
    assert len(check_groups(spark.createDataFrame(rows, "doc_id long, text string"))) > 1000


def test_near_copies_meet_once_and_seldom(spark, rng, monkeypatch):
    """Near copies whose smallest id is a poor pivot, and texts that share passages, whose lists are many."""
    base, rows = [f"hot{k}" for k in range(150)], []
    for i in range(160):
        text = list(base)
        for k in rng.choice(150, 3 if i < 3 else int(rng.integers(1, 4)), replace=False):
            text[int(k)] = f"edit{i}x{k}"
        rows.append((i, " ".join(text)))
    passages = [[f"p{j}x{k}" for k in range(30)] for j in range(12)]
    for i in range(200, 260):
        own = [passages[int(j)] for j in rng.choice(12, 10, replace=False)]
        rows.append((i, " ".join(w for p in own for w in p)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met, meetings = [], ngram_join._meetings

    def counted(entries):
        found = [tuple(r) for r in meetings(entries).collect()]
        everywhere = meetings(entries.withColumn("earlier", F.array().cast("array<long>"))).collect()
        assert set(found) == {tuple(r) for r in everywhere}
        met.append((len(found), len(set(found)), len(everywhere)))
        return meetings(entries)

    monkeypatch.setattr(ngram_join, "_meetings", counted)
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    assert len(check_groups(docs)) > 500
    monkeypatch.setattr(ngram_join, "TURNS", 3)
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    check_groups(docs)
    (rows, pairs, everywhere), (fewer, fewer_pairs, _) = met
    assert rows == pairs < everywhere / 2 and fewer == fewer_pairs < pairs / 2


def test_overlap_and_prefix_sizes():
    for n in range(1, 60):
        for m in range(1, 60):
            need = next(t for t in range(1, 200) if 5 * t >= 4 * (n + m - t))
            assert ngram_join.overlap_needed(n, m) == need
        assert ngram_join.prefix_length(n) == n - int(np.ceil(0.8 * n - 1e-9)) + 1


def brute_links(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            good[i] = x / np.sqrt((x * x).sum())
    ids = sorted(good)
    return good, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(good[a]) == len(good[b]) and float(good[a] @ good[b]) >= threshold]


def check_vectors(df, recall=1.0):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    good, links = brute_links(rows)
    want = {i: 0 for i, _ in rows}
    for a, b in links:
        want[a] += 1
        want[b] += 1
    component = roots([i for i, _ in rows if i is not None], links)
    got = vector_dedup.linked_vectors(df).collect()
    assert len(got) == len(rows)
    total = sum(want[i] for i in good)
    assert sum(r.n_links for r in got if r.vec_id in good) >= recall * total
    for r in got:
        assert r.n_links <= want[r.vec_id]
        if recall == 1.0 and r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (want[r.vec_id], component[r.vec_id], component[r.vec_id] == r.vec_id)
    return len(links)


def test_vectors_of_the_table(spark):
    assert check_vectors(table(spark, "/root/testdata/sf0.1", "embeddings").limit(700)) >= 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.01, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [nan, 1.0, 0.0]), (7, [inf, 0.0, 0.0]),
            (8, [1.0, None, 0.0]), (9, [1.0, 0.0]), (10, [0.0, 1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, []), (13, [-1.0, 0.0, 0.0]), (14, [1e300, 1e299, 0.0]), (15, [1.0, 0.1, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 5) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")
    check_vectors(df)
    assert vector_dedup.linked_vectors(df.limit(0)).count() == 0
    repeated = vector_dedup.linked_vectors(df.where("vec_id in (1, 11)").union(df.where("vec_id = 1"))).collect()
    assert sorted((r.vec_id, r.n_links) for r in repeated) == [(1, 1), (1, 1), (11, 1)]
    null_id = vector_dedup.linked_vectors(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<double>")).first()
    assert (null_id.n_links, null_id.component_id, null_id.kept) == (0, None, False)


def test_hot_bucket_is_split(spark, rng, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    center = rng.normal(size=24)
    rows = [(i, (center + rng.normal(size=24) * 0.05).tolist()) for i in range(90)] + [(100 + i, rng.normal(size=24).tolist()) for i in range(60)] + [(200 + i, center.tolist()) for i in range(40)]
    assert check_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) > 5000


def test_recall_at_the_threshold(spark, rng):
    rows = []
    for i in range(300):
        a = rng.normal(size=32)
        a /= np.linalg.norm(a)
        b = rng.normal(size=32)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.9501 * a + np.sqrt(1 - 0.9501**2) * b).tolist())]
    check_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9)


def test_components(spark, rng):
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    df = spark.createDataFrame(links, "a long, b long")
    want = roots({x for p in links for x in p}, links)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {n: want[n] for p in links if p[0] != p[1] for n in p}
    assert components(df.limit(0)).count() == 0


def test_ids_with_several_vectors(spark, rng):
    """Each vector of an id has its own links; repeated rows are one vector."""
    e = np.eye(6)
    near = lambda v: [float(x) for x in v + rng.normal(0, 0.02, 6)]
    rows = [(5, near(e[0])), (5, near(e[1])), (3, near(e[0])), (4, near(e[1])), (7, near(e[2])), (None, near(e[0])), (8, [0.0] * 6), (9, None), (9, near(e[3]))]
    rows += [rows[2], rows[2], (10, rows[0][1]), (11, [1.0, 0.0]), (12, [2.0, 0.0])]
    got = vector_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    distinct = {(i, tuple(v)) for i, v in rows if i is not None and v and any(v)}
    nodes = sorted(distinct)

    def cosine(a, b):
        return len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.95

    links = [(a, b) for k, a in enumerate(nodes) for b in nodes[:k] if cosine(a[1], b[1])]
    root = roots(nodes, links)
    want = []
    for i, v in rows:
        node = (i, tuple(v or ()))
        n = sum(node in link for link in links) if node in distinct else 0
        component = root[node][0] if node in distinct else i
        want.append((i, n, component, i is not None and component == i))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert vector_dedup.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
