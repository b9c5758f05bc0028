import bisect
import os
import random
import re
import zlib

import numpy as np
import pytest

from terrane.llm import quality, toxicity
from terrane.llm._labels import held_out, labelled_sample

from .helpers import clashing, empty, odd_docs, prose, sorted_rows, table

DATA = "/root/testdata/sf0.1"


def auc(score, mark):
    order = np.argsort(np.argsort(score))
    n1 = mark.sum()
    return (order[mark == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(mark) - n1))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize(("module", "run", "label", "least"), [(quality, quality.score_quality, "quality", 0.97), (toxicity, toxicity.score_toxicity, "toxic", 0.96)])
def test_held_out_rows(spark, module, run, label, least):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = run(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    mark = out[label].to_numpy()
    assert auc(out["score"].to_numpy(), mark) > least
    assert (out["predicted"].to_numpy() == mark).mean() > 0.96
    assert ((out["score"] >= module.THRESHOLD) == (out["predicted"] == 1)).all()


def features(blob, separators, orders, bits):
    """(position, feature) by the definition: words, then character n-grams with no separator but at their ends."""
    raw = [32 if separators[b] else b for b in blob]

    def feature(low, high, salt):
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(raw[low:high])) + salt & (1 << 64) - 1
        return ((h ^ h >> 31) * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> 64 - bits

    words = [(m.start(), feature(m.start(), m.end(), 0)) for m in re.finditer(rb"[^ ]+", bytes(raw))]
    return words, [(i + 1, feature(i, i + n, n)) for n in orders for i in range(len(raw) - n + 1) if 32 not in raw[i + 1 : i + n - 1]]


def test_quality_scores_match_brute_force():
    r = np.random.default_rng(3)
    model = quality.QualityModel(r.normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    for text in ("A word, a word word é!", "", "x", "one\ntwo  two\ttwo 日本", prose(3, 50)):
        words, grams = features(b" " + text.encode() + b" ", quality.SPACE, quality.ORDERS, quality.BITS)
        found = [f for _, f in words + grams]
        for (_, a), (_, b) in zip(words, words[1:], strict=False):
            h = a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1
            found.append(((h ^ h >> 31) * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> 64 - quality.BITS)
            found += [quality.REPEAT] * (a == b)
        mean = sum(float(model.direction[f]) for f in found) / max(1, len(found))
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-mean - 0.3)), abs=1e-6)


def test_toxicity_scores_match_brute_force():
    r = np.random.default_rng(4)
    model = toxicity.ToxicityModel(r.normal(size=1 << toxicity.BITS).astype(np.float32) / 3, -2.0, 2.0)
    for text in ("One two. Three! four? five\nsix é", "", "...", "Word word. " * 5, prose(3, 50)):
        blob = b"\n" + text.lower().encode() + b"\n"
        words, grams = features(blob, ~toxicity.WORD, toxicity.ORDERS, toxicity.BITS)
        first = sorted({1} | {k + 1 for k, b in enumerate(blob[:-1]) if b in b"\n!.?"})
        bags = [set() for _ in first]
        for at, f in words + grams:
            bags[bisect.bisect_right(first, at) - 1].add(f)
        logits = [sum(float(model.weights[f]) for f in bag) - 2.0 for bag in bags if bag]
        clean = 1.0
        for z in logits:
            clean *= (1 / (1 + np.exp(z))) ** (1 if z >= 0 else min(1, 2.0 / len(logits)))
        assert model.scores([text])[0] == pytest.approx(1 - clean, abs=1e-5)


def toxic_corpus(n=240):
    r = random.Random(2)
    texts, marks, bad = [], [], []
    for k in range(n):
        lines = [prose(1000 * k + j, 12) + "." for j in range(6)]
        at = r.randrange(6)
        if k % 3 == 0:
            lines[at] = prose(k, 5) + " " + r.choice(["vilething", "nastyword"]) + " " + prose(k + 1, 4) + "."
        texts.append(" ".join(lines))
        marks.append(int(k % 3 == 0))
        bad.append(lines[at] if k % 3 == 0 else None)
    return texts, marks, bad


def test_sentences_are_located_from_document_labels():
    texts, marks, bad = toxic_corpus()
    model = toxicity.train(texts[:180], marks[:180])
    assert ((model.scores(texts[180:]) >= 0.5) == np.array(marks[180:])).mean() > 0.95
    found = [[s for s, _ in model.offending(t)] for t in texts[180:]]
    hits = [b.lower() in f for f, b in zip(found, bad[180:], strict=True) if b]
    assert np.mean(hits) > 0.9 and np.mean([len(f) for f, b in zip(found, bad[180:], strict=True) if not b]) < 0.1


def test_noisy_or_of_the_sentences():
    texts, marks, _ = toxic_corpus(60)
    model = toxicity.train(texts, marks)
    text = texts[0]
    singles = model.scores([s + "." for s in text.split(".") if s.strip()])
    assert model.scores([text])[0] == pytest.approx(1 - np.prod(1 - singles), abs=1e-6)


def test_long_texts_score_as_a_whole():
    texts, marks, _ = toxic_corpus(120)
    model = toxicity.train(texts, marks)
    clean = (prose(5, 30) + ". ") * 1
    long_ = " ".join(prose(9, 200) for _ in range(1500)) + ". a vilething nastyword vilething here."
    assert len(long_) > 1 << 20
    assert model.scores([long_])[0] > 0.5 > model.scores([clean])[0]


def test_long_clean_texts_stay_clean():
    texts, marks, _ = toxic_corpus(240)
    model = toxicity.train(texts, marks)
    clean = " ".join(prose(50_000 + k, 12) + "." for k in range(5000))
    assert model.scores([clean])[0] < 0.5 <= model.scores([clean + " a vilething nastyword vilething here."])[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_clean_texts_joined_stay_clean(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(*labelled_sample(docs, labels, "toxic"))
    rows = docs.join(labels, "doc_id").where("toxic = 0 and text is not null").select("doc_id", "text").orderBy("doc_id").collect()
    clean = [r.text for r in rows if held_out(r.doc_id) and model.scores([r.text])[0] < 0.1]
    sentences = [x for t in clean for x in t.replace("\n", ". ").split(". ") if x.strip()]
    scores = model.scores([". ".join(sentences[k : k + 5000]) for k in range(0, len(sentences) - 4999, 5000)])
    assert len(scores) and (scores < 0.5).all()


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("run", [quality.score_quality, toxicity.score_toxicity])
def test_odd_rows(spark, run):
    docs = odd_docs(spark)
    labels = labels_of(spark, [(1, 1, 0), (1, 0, 1), (3, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (99, 1, 1)])
    out = run(docs, labels).collect()
    assert len(out) == 11 and all(0 <= r.score <= 1 for r in out)
    assert all(bool(r.sentences) <= (r.predicted == 1) for r in out if "sentences" in r)
    assert {r.doc_id: r.held_out for r in out} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, None)}
    by = {r.doc_id: r.score for r in out}
    assert by[1] == by[2] and by[4] == by[5]
    assert sorted_rows(run(clashing(docs), labels)) == sorted_rows(run(docs, labels))
    assert run(empty(spark), labels).isEmpty()
    assert len(run(docs, labels_of(spark, [])).collect()) == 11


def test_held_out_rows_are_never_learnt(spark):
    docs = table(spark, [(i, f"text {i}", "en", "s") for i in range(200)])
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(200)])
    texts, marks = labelled_sample(docs, labels, "quality")
    assert {int(t.split()[1]) for t in texts} == {i for i in range(200) if not held_out(i)}
    assert all(int(t.split()[1]) % 2 == m for t, m in zip(texts, marks, strict=True))
    few, _ = labelled_sample(docs, labels, "quality", rows=10)
    assert len(few) == 10


def test_long_labelled_texts_are_learnt(spark):
    long_ = prose(3, 8000)
    assert len(long_) > 20_000
    ids = [i for i in range(20) if not held_out(i)]
    docs = table(spark, [(i, f"{long_} {i}", "en", "s") for i in ids])
    texts, marks = labelled_sample(docs, labels_of(spark, [(i, 0, i % 2) for i in ids]), "toxic")
    assert len(texts) == len(ids) and sum(marks) == sum(i % 2 for i in ids)


def test_drop_toxic_keeps_columns(spark):
    texts, marks, _ = toxic_corpus(150)
    docs = clashing(table(spark, [(i, t, "en", "s") for i, t in enumerate([*texts, None])]))
    kept = toxicity.drop_toxic(docs, labels_of(spark, [(i, 1, m) for i, m in enumerate(marks)]))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(texts) in ids and sum(marks[i] for i in ids if i < len(marks)) <= 2 and sum(1 - m for i, m in enumerate(marks) if i not in ids) <= 2
