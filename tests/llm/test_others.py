import collections
import math
import os
import random
import textwrap
import time

import duckdb
import numpy as np
import pytest

from terrane.llm import ann, license_scan, lm_score, mixing, queries
from terrane.llm._text import word_hashes

from .helpers import clashing, empty, odd_docs, prose, sorted_rows, table

DATA = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


# Nearest neighbours.


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def brute_nearest(rows, every, k, dtype=np.float32):
    good = [(i, np.array(v, dtype=dtype).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            best = {}
            for i, y in good:
                if i != q and len(x) == len(y):
                    d = math.sqrt(float(((x - y) ** 2).sum()))
                    best[i] = min(d, best.get(i, math.inf))
            merged = {**best}
            for i, d in out.get(q, []):
                merged[i] = min(d, merged.get(i, math.inf))
            out[q] = sorted(merged.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


@data
def test_recall_on_the_table(spark):
    got = collections.defaultdict(list)
    for r in queries.op1_nearest_neighbours(spark, DATA).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 100, 10)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    for q, best in got.items():
        assert len(best) == 10 and best == sorted(best, key=lambda x: (x[1], x[0]))
        exact = {i: d for i, d in brute_nearest([r for r in rows if r[0] in {q, *(i for i, _ in best)}], 1, 500)[q]}
        assert all(exact[i] == pytest.approx(d, abs=1e-12) for i, d in best)


def test_many_shards_and_recall(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=16).tolist()) for i in range(1500)]
    got = collections.defaultdict(set)
    for x in ann.nearest(spark, vectors(spark, rows), query_every=50, shard_vectors=300).collect():
        got[x.query_id].add(x.vec_id)
    want = brute_nearest(rows, 50, 10)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.95


def test_odd_vectors_and_copies(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 40)] + [(100, [1.0, 2.0, 3.5]), (101, None), (102, [0.0, -0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [1.0, float("nan"), 2.0]), (105, [1.0, float("inf"), 2.0]), (None, same), (7, same), (200, [1.0, 2.0]), (201, [1.5, 2.0]), (300, [9.0])]
    out = ann.nearest(spark, vectors(spark, rows)).orderBy("query_id", "rank").collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert [x[1] for x in by[0]] == list(range(1, 11)) and all(x[2] == 0.0 for x in by[0])
    assert [x[1] for x in by[100]] == list(range(10)) and [x[1] for x in by[200]] == [201] and 300 not in by
    wide = vectors(spark, rows).selectExpr("*", "1 as id", "2 as v", "3 as shard", "4 as dim")
    assert sorted_rows(ann.nearest(spark, wide)) == sorted(map(tuple, out), key=repr)
    assert ann.nearest(spark, vectors(spark, [])).isEmpty()


def test_double_vectors_keep_their_components(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=8)
    rows = [(i, (base + i * 1e-12 * r.normal(size=8)).tolist()) for i in range(30)] + [(100, (base * 1e200).tolist()), (200, (base * 1.5e200).tolist()), (300, [1e-200, *[0.0] * 7])]
    out = ann.nearest(spark, vectors(spark, rows, "double")).orderBy("query_id", "rank").collect()
    want = brute_nearest(rows[:30], 100, 10, np.float64)[0]
    assert [(r_.vec_id, r_.score) for r_ in out if r_.query_id == 0 and r_.rank <= 3] == want[:3]
    wide = [r_ for r_ in out if r_.query_id == 100][0]
    assert wide.vec_id in (200, 300) or math.isfinite(wide.score)


def test_recall_at_the_least_shipped_shard():
    r = np.random.default_rng(8)
    v = r.normal(size=(ann.SHARD_VECTORS[0], 64)).astype(np.float32)
    graph = ann.build(v, np.arange(len(v), dtype=np.uint64))
    queries = v[::80]
    want = np.argsort((queries**2).sum(1)[:, None] + (v**2).sum(1) - 2 * queries @ v.T, axis=1)[:, :11]
    found = graph.search(queries)
    assert np.mean([len(set(a) & set(b[:11])) / 11 for a, b in zip(want.tolist(), found.tolist(), strict=True)]) >= 0.95


def test_graph_round_trip():
    r = np.random.default_rng(0)
    v = r.normal(size=(400, 8)).astype(np.float32)
    g = ann.build(v, np.arange(400, dtype=np.uint64))
    levels, flat = ann.dumps(g)
    h = ann.loads(v, levels, flat)
    assert h.entry == g.entry and all((a == b).all() for a, b in zip(g.links, h.links, strict=True))
    assert all((x < 400).all() and (np.sort(row[row >= 0])[1:] != np.sort(row[row >= 0])[:-1]).all() for x in g.links for row in x)


# Licenses.


def test_licenses_are_found_and_told_apart(spark):
    mit = license_scan.TEMPLATES[0][1]
    gpl3, gpl2 = (next(w for n, w in license_scan.TEMPLATES if n == name) for name in ("GPL-3.0", "GPL-2.0"))
    changed = mit.replace("free of charge", "at no charge")
    docs = [
        (1, f"{prose(1)}\n{mit}\n{prose(2)}"), (2, f"{prose(3)} {gpl2} {prose(4)}"), (3, f"{prose(5)}\n" + gpl3.replace(" ", "\n", 6)), (4, changed.upper()),
        (5, "a license to drive, a copyright notice, all of it in prose"), (6, "Licensed under CC BY-NC 4.0.\nx\ny\nReleased under the MIT License."),
        (7, "Licensed under CC BY-SA 4.0."), (8, "Released under the BSD License."), (9, gpl3.replace("version 3", "version 4")),
    ]
    out = sorted((r.doc_id, r.license, len(r.differences)) for r in license_scan.scan_licenses(table(spark, [(i, t, "en", "s") for i, t in docs])).collect())
    assert [(i, n) for i, n, _ in out] == [(1, "MIT"), (2, "GPL-2.0"), (3, "GPL-3.0"), (4, "MIT"), (6, "CC-BY-NC-4.0"), (6, "MIT")]
    assert [d for i, _, d in out if i in (1, 2, 3, 6)] == [0] * 5 and [d for i, _, d in out if i == 4] == [4]


@data
def test_short_notices_match_a_text_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    notices = {"Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3": "GPL-3.0", "Released under the MIT License": "MIT", "All rights reserved": "All-Rights-Reserved"}
    want = collections.Counter((i, name) for i, t in docs.items() for s, name in notices.items() for _ in range(t.lower().count(s.lower())))
    got = collections.Counter((r.doc_id, r.license) for r in queries.op3_license_scan(spark, DATA).collect())
    assert got == want and len(want) > 20


def test_notices_in_a_long_line_are_found():
    scanner = license_scan.Scanner()
    for name, notice in license_scan.TEMPLATES:
        text = f"{prose(31, 10_000)} {notice} {prose(32, 10_000)}"
        assert [(f.license, f.differences) for f in scanner.scan(text)] == [(name, [])], notice


def test_notices_are_found_at_any_width_and_after_decoys():
    scanner = license_scan.Scanner()
    mit, isc = license_scan.TEMPLATES[0][1], next(w for n, w in license_scan.TEMPLATES if n == "ISC")
    for width in (*range(10, 81, 7), 80):
        text = f"{prose(41, 50)}\n{textwrap.fill(mit, width, break_long_words=False, break_on_hyphens=False)}\n{prose(42, 50)}"
        assert [(f.license, f.differences) for f in scanner.scan(text)] == [("MIT", [])], width
    decoy = " ".join(isc.split()[:22])
    found = scanner.scan(f"{decoy}. {prose(43, 10)} {isc.replace('purpose', 'aim')}")
    assert [(f.license, f.differences) for f in found] == [("ISC", ["-purpose", "+aim"])]


def edit_distance(want, found):
    """The fewest words missing from ``want`` plus added by ``found``, whole against whole."""
    last = list(range(len(found) + 1))
    for i, w in enumerate(want, 1):
        row = [i]
        for j, f in enumerate(found, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] if w == f else len(want) + len(found)))
        last = row
    return last[-1]


def test_places_match_brute_force():
    """Every template against every stretch: what is near without a telling word is found, and nothing else."""
    r = random.Random(4)
    templates = [(f"T{k}", prose(500 + k, n, 1).replace("0", "x")) for k, n in enumerate((3, 8, 12, 25, 40))]
    scanner = license_scan.Scanner(templates)
    for _ in range(40):
        parts, planted = [], []
        for _ in range(3):
            k = r.randrange(5)
            words = templates[k][1].split()
            for _ in range(r.randrange(5)):
                at = r.randrange(len(words))
                words[at : at + r.randrange(2)] = [f"odd{'abcdefg'[r.randrange(7)]}"] * r.randrange(3)
            parts += [prose(r.randrange(10**6), r.randrange(4)), " ".join(words)]
            planted.append(k)
        found = license_scan.words("\n".join(parts))
        want = set()
        for k, (name, wording) in enumerate(templates):
            w = license_scan.words(wording)
            d = license_scan.allowed(len(w))
            near = [(edit_distance(w, found[i:j]), i, j) for i in range(len(found)) for j in range(max(i + 1, i + len(w) - d), min(len(found), i + len(w) + d) + 1)]
            want |= {name for cost, _, _ in near if cost <= d}
        got = {f.license for f in scanner.scan("\n".join(parts))}
        # Costs up to d are certain; up to d missing and d added words may be found as well.
        assert want <= got
        for f in scanner.scan("\n".join(parts)):
            w = license_scan.words(dict(templates)[f.license])
            missing, added = ([x[1:] for x in f.differences if x[0] == s] for s in "-+")
            assert max(len(missing), len(added)) <= license_scan.allowed(len(w))
            assert edit_distance(w, license_scan.words(f.wording)) == len(missing) + len(added)
            assert collections.Counter(w) - collections.Counter(license_scan.words(f.wording)) <= collections.Counter(missing)


def test_many_notices_take_linear_time():
    scanner = license_scan.Scanner()
    took = []
    for n in (1000, 4000):
        began = time.process_time()
        assert len(scanner.scan("All rights reserved.\n" * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_license_odd_rows(spark):
    docs = odd_docs(spark).union(table(spark, [(50, "Released under the MIT License. " * 300, None, None), (None, "All rights reserved.", "en", "s")]))
    out = license_scan.scan_licenses(docs).collect()
    assert sum(r.doc_id == 50 and r.license == "MIT" for r in out) == 300 and sum(r.doc_id is None for r in out) == 1
    assert sorted_rows(license_scan.scan_licenses(clashing(docs))) == sorted(map(tuple, out), key=repr)
    assert license_scan.scan_licenses(empty(spark)).isEmpty()


# Mixing.


@data
def test_mix_matches_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as from '{DATA}/documents.parquet'")
    want = c.execute(queries.ORACLE_SQL["op4_mix_sources"]).df()
    got = queries.op4_mix_sources(spark, DATA).toPandas()[want.columns]
    assert got.sort_values("doc_id").reset_index(drop=True).equals(want.sort_values("doc_id").reset_index(drop=True))


@data
def test_expected_tokens_meet_the_targets(spark):
    """With the shipped targets and rounds."""
    out = mixing.mix_report(spark, spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    out["expected"] = out["tokens"] * out["probability"]
    for m in mixing.MARGINS:
        have, share = out.groupby(m)["expected"].sum(), out.groupby(m)["tokens"].sum() / out["tokens"].sum()
        target = share.index.map(mixing.TARGETS[m]) if m in mixing.TARGETS else share ** mixing.POWERS[m]
        target = np.asarray(target, dtype=float)
        assert (have / have.sum()).to_numpy() == pytest.approx(target / target.sum(), abs=2e-3)
    assert out["probability"].max() == 1.0 and out["kept"].mean() == pytest.approx(out["probability"].mean(), abs=0.05)


def test_targets_of_some_values(spark):
    docs = table(spark, [(i, prose(i, 20 + i % 7), ("en", "fr", "de", None)[i % 4], ("web", "web", "book")[i % 3]) for i in range(240)])
    targets = {"source": {"book": 0.5, "radio": 0.2}, "lang": {"en": 0.4}}
    for cells in (mixing.DRIVER_CELLS, 1):
        out = mixing.mix_report(spark, docs, targets=targets, rounds=12, driver_cells=cells).toPandas()
        out["expected"] = out["tokens"] * out["probability"]
        share = {m: (x := out.groupby(m)["expected"].sum()) / x.sum() for m in ("source", "lang")}
        # Nothing is from the radio, so the others share its part.
        assert share["source"]["book"] == pytest.approx(0.5 / 0.8, abs=1e-3) and share["lang"]["en"] == pytest.approx(0.4, abs=1e-3)
        assert share["lang"]["fr"] == pytest.approx(0.2, abs=0.01) and share["lang"][""] == pytest.approx(0.2, abs=0.01)


def test_fit_goes_on_until_the_targets_are_met(spark, caplog):
    """Sources of nearly one language take more rounds than the SQL has; both forms go on, and end where nothing meets the targets."""
    targets = {"lang": {"en": 0.54, "fr": 0.46}}
    for cells, english, others in ((mixing.DRIVER_CELLS, 125, 1), (mixing.DRIVER_CELLS, 250, 2), (1, 250, 2)):
        n = {("a", "en"): english, ("a", "fr"): others, ("b", "fr"): 100, ("b", "en"): others}
        docs = table(spark, [(1000 * k + i, "ka lo mi ne tu", lang, source) for k, (source, lang) in enumerate(n) for i in range(n[source, lang])])
        p = {(r.source, r.lang): r.probability for r in mixing.mix_report(spark, docs, targets=targets, driver_cells=cells).collect()}
        total = sum(n[c] * p[c] for c in n)
        share = {s: sum(n[s, x] for x in ("en", "fr")) ** mixing.POWERS["source"] for s in "ab"}
        assert sum(n[s, "en"] * p[s, "en"] for s in "ab") / total == pytest.approx(0.54, abs=2e-5)
        assert sum(n["a", x] * p["a", x] for x in ("en", "fr")) / total == pytest.approx(share["a"] / sum(share.values()), abs=2e-5)
    assert not caplog.records
    apart = table(spark, [(i, "ka lo", ("en", "fr")[i % 2], ("a", "b")[i % 2]) for i in range(20)])
    for cells in (mixing.DRIVER_CELLS, 1):
        assert {(r.lang, r.probability) for r in mixing.mix_report(spark, apart, targets={"lang": {"en": 0.8, "fr": 0.2}}, driver_cells=cells).collect()} == {("en", 1.0), ("fr", 0.25)}
    assert len(caplog.records) == 2


def test_mix_table_form_and_odd_rows(spark):
    docs = odd_docs(spark)
    a = sorted_rows(mixing.mix_report(spark, docs, rounds=4))
    assert len(a) == 11 and sorted_rows(mixing.mix_report(spark, docs, rounds=4, driver_cells=1)) == a
    assert sorted_rows(mixing.mix_report(spark, clashing(docs), rounds=4)) == a
    kept = mixing.mix(spark, clashing(docs), rounds=4)
    assert kept.columns == clashing(docs).columns and kept.count() == sum(r[-1] for r in a)
    assert mixing.mix_report(spark, empty(spark)).isEmpty() and mixing.mix(spark, table(spark, [(1, None, None, None)])).count() == 1


# Language-model scores.


def brute_losses(texts, targets, share):
    """(tokens, target loss, background loss) by the definition; the start is a context only."""
    docs = []
    for x in texts:
        words = [int(v) for _, h in word_hashes([x]) for v in h]
        docs.append([*words, "end"] if words else [])
    pairs = {n: collections.Counter() for n in "bt"}
    words = {n: collections.Counter() for n in "bt"}
    for i, d in enumerate(docs):
        for n in "bt" if i in targets else "b":
            pairs[n].update(zip(["start", *d], d, strict=False))
            words[n].update([*d, "start"] if d else [])
    total = {n: sum(v for w, v in words[n].items() if w != "start") for n in "bt"}
    known = {w for w, v in words["b"].items() if v >= share * total["b"]} | {"start", "end"}
    scale = total["t"] / total["b"] if total["t"] else 1.0
    prior, unseen = lm_score.PRIOR, lm_score.UNSEEN
    out = []
    for i, d in enumerate(docs):
        losses = [0.0, 0.0]
        own = collections.Counter(zip(["start", *d], d, strict=False))
        for pair in zip(["start", *d], d, strict=False):
            before, word = pair
            base = (words["b"][word] + prior * unseen) / (total["b"] + prior) if word in known else unseen
            for k, (n, s) in enumerate((("t", 1.0), ("b", scale))):
                mine = n == "b" or i in targets
                shorter = (s * (words[n][word] if word in known else 0) + prior * base) / (s * total[n] + prior)
                if before in known:
                    seen = pairs[n][pair] - (own[pair] if mine else 0)
                    context = words[n][before] - (before == "start" and mine)
                    losses[k] -= math.log((s * seen + prior * shorter) / (s * context + prior))
                else:
                    losses[k] -= math.log(shorter)
        out.append((len(d), *(x / len(d) for x in losses)) if d else None)
    return out


@pytest.mark.parametrize(("share", "slot_tokens", "sent"), [(1e-5, 2_000_000, 1000), (1e-3, 300, 0), (1e-2, 300, 1000), (0.5, 100, 0)])
def test_losses_match_brute_force(spark, share, slot_tokens, sent):
    texts = [prose(k, 60) for k in range(30)] + [prose(3, 60), prose(4, 60) + " more", "日本語 42 ก x", "Ünïcode, 42!\n", None, "", "a a a a b a a"]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    targets = spark.createDataFrame([(0,), (1,), (1,), (3,), (36,), (77,), (None,)], "doc_id long")
    want = brute_losses([*texts[:32], "日 本 語 42 ก x", *texts[33:]], {0, 1, 3, 36}, share)
    for r in lm_score.score_documents(spark, docs.union(docs.where("doc_id = -1")), targets, share=share, slot_tokens=slot_tokens, targets_sent=sent).collect():
        if want[r.doc_id] is None:
            assert r.score is None and r.n_tokens == 0
        else:
            assert (r.n_tokens, r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id], abs=1e-5)
            assert r.score == pytest.approx(r.target_loss - r.background_loss)


def test_repeated_rows_are_scored_alike(spark):
    texts = [prose(k, 40) for k in range(12)] + [prose(2, 40), prose(2, 40)]
    ids = [*range(12), 2, 50]
    want = brute_losses(texts, {2, 12, 5}, 1e-5)
    targets = spark.createDataFrame([(2,), (5,)], "doc_id long")
    out = lm_score.score_documents(spark, table(spark, [(i, t, "en", "s") for i, t in zip(ids, texts, strict=True)]), targets).collect()
    assert sorted((r.doc_id, round(r.background_loss, 5)) for r in out) == sorted((i, round(w[2], 5)) for i, w in zip(ids, want, strict=True))


def test_texts_that_occur_twice_stand_apart(spark):
    texts = [prose(k, 80, 4000) for k in range(60)] + [prose(k, 80, 4000) for k in range(10)]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    out = {r.doc_id: r.background_loss for r in lm_score.score_documents(spark, docs, spark.range(20, 30).withColumnRenamed("id", "doc_id")).collect()}
    twice = [out[i] for i in (*range(10), *range(60, 70))]
    assert max(twice) < min(out[i] for i in range(10, 60))


def test_scores_of_odd_rows(spark):
    long_ = prose(1, 250_000)
    docs, targets = odd_docs(spark).union(table(spark, [(70, long_, "en", "s"), (71, "x y " * 40_000, "en", "s")])), spark.createDataFrame([(1,), (7,)], "doc_id long")
    out = lm_score.score_documents(spark, docs, targets).collect()
    assert len(out) == 13 and {r.doc_id for r in out if r.score is None} == {4, 5, 6} and {r.doc_id: r.n_tokens for r in out}[70] == 250_001
    assert len({r.score for r in out if r.doc_id == 7}) == 1
    again = lm_score.score_documents(spark, clashing(docs), targets).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, map(tuple, again)))
    assert lm_score.score_documents(spark, empty(spark), targets).isEmpty()
    assert len(lm_score.score_documents(spark, docs, targets.limit(0)).collect()) == 13


def test_own_kind_scores_lower(spark):
    a, b = [prose(k, 40) for k in range(30)], ["zzq xxw qqz wwx " * 12 + str(k) for k in range(30)]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate([*a, *b])])
    out = {r.doc_id: r.score for r in lm_score.score_documents(spark, docs, spark.range(10).withColumnRenamed("id", "doc_id")).collect()}
    assert max(out[i] for i in range(30)) < min(out[i] for i in range(30, 60))
