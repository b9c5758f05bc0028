import collections

import numpy as np
import pytest

from terrane.llm import _graph, _store, neardup
from terrane.llm._text import distinct, gathered, shingle_hashes, word_hashes

from .helpers import clashing, empty, odd_docs, prose, sorted_rows, table


def brute_classes(texts):
    """Components of all pairs with a weighted Jaccard similarity of 0.8."""
    n = len(texts)
    words = [w for _, w in word_hashes(texts)]
    found = [distinct(shingle_hashes(w)) for w in words]
    df = collections.Counter(k for keys, _ in found for k in keys.tolist())
    worded = sum(len(w) > 0 for w in words)
    sets = [(keys, counts * neardup.idf_weight(np.array([df[k] for k in keys.tolist()]), worded)) for keys, counts in found]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (len(sets[i][0]) and len(sets[j][0]) and neardup.weighted_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def variants(seed, n, edits, words=150):
    base = prose(seed, words).split()
    r = np.random.default_rng(seed)
    out = [" ".join(base)]
    for k in range(n):
        w = list(base)
        for at in r.choice(words, edits, replace=False):
            w[at] = f"new{k}x{at}"
        out.append(" ".join(w))
    return out


def test_classes_match_brute_force(spark):
    texts = [*variants(1, 12, 2), *variants(2, 8, 5), *variants(3, 6, 1), *[prose(100 + k, 60) for k in range(60)], prose(7), prose(7), None, "", "one two", "one two"]
    want = brute_classes(texts)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 15


def classes_of(spark, texts):
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    return [got[i] for i in range(len(texts))]


def test_chains_of_versions_match_brute_force(spark):
    texts = []
    for seed in range(60):
        words = prose(seed, 250).split()
        r = np.random.default_rng(seed)
        for version in range(12):
            texts.append(" ".join(words))
            for at in r.choice(250, 4, replace=False):
                words[at] = f"edit{seed}x{version}x{at}"
    want = brute_classes(texts)
    assert len(set(want)) < len(texts) / 4
    assert classes_of(spark, texts) == want


def test_pairs_on_one_template_match_brute_force(spark):
    form, texts = prose(77, 300).split(), []
    for pair in range(150):
        own = [f"case{pair}x{k}" for k in range(28)]
        for copy in range(2):
            words = form[:150] + own + form[150:]
            words[(37 * pair + 50 * copy) % 300] = f"edit{pair}x{copy}"
            texts.append(" ".join(words))
    want = brute_classes(texts)
    assert len(set(want)) == 150
    assert classes_of(spark, texts) == want


def test_samples_agree_like_the_similarity():
    r = np.random.default_rng(5)
    keys = np.sort(r.integers(0, 1 << 62, 600).astype(np.uint64))
    wa, wb = r.uniform(1, 4, 600), r.uniform(1, 4, 600)
    wb[:100] = 0
    a = neardup.icws(keys, wa, 2000)
    b = neardup.icws(keys[wb > 0], wb[wb > 0], 2000)
    want = neardup.weighted_jaccard((keys, wa), (keys[wb > 0], wb[wb > 0]))
    assert (a == b).mean() == pytest.approx(want, abs=0.04)


def test_odd_rows(spark):
    out = sorted_rows(neardup.near_duplicates(spark, odd_docs(spark)))
    classes = {r[0]: r[1] for r in out}
    assert len(out) == 11 and classes[2] == 1 and classes[5] == 4 and classes[6] == 6 and classes[None] is None
    assert sum(r[0] == 7 for r in out) == 2
    assert sorted_rows(neardup.near_duplicates(spark, clashing(odd_docs(spark)))) == out
    assert neardup.near_duplicates(spark, empty(spark)).isEmpty()


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 400)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7), (1000, 1001)]
    for task_edges in (100, 500_000):
        out = _graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7), _store.Scratch(spark, "t"), task_edges=task_edges)
        assert {r.node: r.root for r in out.collect()} == {**dict.fromkeys(range(1, 401), 1), 1000: 1000, 1001: 1000, 1002: 1000}
    assert _graph.components(spark.createDataFrame([], "a long, b long"), _store.Scratch(spark, "t")).isEmpty()


def random_sets(r, n):
    out = []
    for _ in range(n):
        keys = np.unique(r.integers(0, 300, 300).astype(np.uint64))
        out.append((keys, r.integers(1, 4, len(keys)) * float(r.choice([1.0, 1.25, 2.0]))))
    return out


def test_tiles_match_pairs():
    r = np.random.default_rng(1)
    for n, m in ((30, 25), (5, 4)):
        a, b = random_sets(r, n), random_sets(r, m)
        for similarity in (0.2, 0.25, 0.3):
            near = {(i, j) for i in range(n) for j in range(m) if neardup.weighted_jaccard(a[i], b[j]) >= similarity}
            assert set(zip(*(x.tolist() for x in neardup.tile_links(a, b, similarity)), strict=True)) == near
            near = {(i, j) for i in range(n) for j in range(i + 1, n) if neardup.weighted_jaccard(a[i], a[j]) >= similarity}
            assert set(zip(*(x.tolist() for x in neardup.tile_links(a, None, similarity)), strict=True)) == near


def test_idf_counts_all_documents(spark):
    texts = [f"{prose(5, 30)} {prose(k + 900, 20)}" if k % 3 else prose(k + 900, 50) for k in range(300)]
    idf = neardup.shingle_idf(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(5), _store.Scratch(spark, "t"))
    df = collections.Counter(k for _, w in word_hashes(texts) for k in distinct(shingle_hashes(w))[0].tolist())
    want = {k: v for k, v in df.items() if v > 3}
    assert want and dict(zip(idf.common.tolist(), idf.weight.tolist(), strict=True)) == pytest.approx({k: float(neardup.idf_weight(np.array([v]), 300)[0]) for k, v in want.items()})


def test_large_group_among_others_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 10)
    texts = [*variants(11, 60, 6, 200), *variants(11, 30, 14, 200), *[prose(300 + k, 80) for k in range(20)]]
    want = brute_classes(texts)
    assert classes_of(spark, texts) == want


def test_one_of_each_class_stays(spark):
    docs = odd_docs(spark).union(table(spark, [(20, prose(2, 3000) + " more", "en", "z"), (7, "another text of the id seven", "en", "z"), (30, "another text of the id seven", "fr", "z")]))
    kept = neardup.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    rows = sorted(((r.doc_id, r.source) for r in kept.collect()), key=repr)
    assert [i for i, _ in rows].count(7) == 2 and {20, 30, 2, 5}.isdisjoint({i for i, _ in rows}) and (None, "a") in rows
    assert sorted_rows(neardup.drop_near_duplicates(spark, clashing(docs)).select(*docs.columns)) == sorted_rows(kept)
    assert neardup.drop_near_duplicates(spark, empty(spark)).isEmpty()


def test_lots_are_large_and_whole():
    r = np.random.default_rng(2)
    for sizes in ([], [1], [5, 5, 5], [100], *(r.integers(0, 8, 40).tolist() for _ in range(30))):
        lots = list(gathered(iter(sizes), int, 10))
        assert [x for lot in lots for x in lot] == sizes
        assert all(sum(lot) >= 10 for lot in lots) or len(lots) <= 1
        assert all(sum(lot) < 40 for lot in lots) or 100 in sizes


def test_words_of_long_texts_are_whole():
    text = prose(1, 300_000)
    (_, one), (_, two) = word_hashes([text, "ka"])
    assert len(one) == len(text.split()) and len(two) == 1
