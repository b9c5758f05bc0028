import random

from terrane.llm.line_dedup import dedup_lines, near, within_one, words_of

from .helpers import clashing, empty, odd_docs, prose, sorted_rows, table


def brute(docs):
    """{id: text}: a line goes if an earlier one is equal in words or within the bound of it."""
    earlier, out = [], {}
    for i, text in sorted(docs):
        kept = []
        for line in (text or "").split("\n"):
            w = words_of(line)
            gone = any(w == words_of(e) or near(line, e) for e in earlier) if w else False
            earlier.append(line)
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def edit(line, r):
    w = line.split()
    kind, at = r.randrange(6), r.randrange(len(w))
    if kind >= 4:
        at = r.randrange(len(line))
        return line[:at] + ("" if kind == 4 else r.choice("xy7 ")) + line[at + 1 :]
    if kind == 0:
        w[at] = "changed" + str(r.randrange(99))
    elif kind == 1:
        del w[at]
    elif kind == 2:
        w.insert(at, "added")
    else:
        w[at], w[at // 2] = "both", "ends"
    return " ".join(w)


def test_matches_brute_force(spark):
    r = random.Random(1)
    pool = [prose(k, r.randint(1, 20)) for k in range(25)]
    docs = []
    for i in range(60):
        lines = [r.choice(pool) if r.random() < 0.3 else edit(r.choice(pool), r) if r.random() < 0.6 else prose(1000 + 7 * i + k, 12) for k in range(4)]
        docs.append((i, "\n".join([*lines, "", lines[0].upper()])))
    got = {x.doc_id: x.text for x in dedup_lines(spark, table(spark, [(i, t, "en", "s") for i, t in docs])).collect()}
    assert got == brute(docs)


def test_bound_is_one_word():
    a = "a b c d e f g h".split()
    assert within_one(a, a) and within_one(a, a[1:]) and within_one(a[:-1], a) and within_one(a, [*a[:3], "x", *a[4:]])
    assert not within_one(a, a[2:]) and not within_one(a, ["x", *a[1:-1], "y"]) and not within_one(a, [*a[1:], "x"])


def test_short_lines_are_near_by_characters(spark):
    lines = ["Release notes of May", "Release note of May", "release notes, of Mxy", "Chapter 11 of it", "Chapter 12 of it", "short one", "short ones", "Relase notes of May", "data base systems", "database systems"]
    got = dedup_lines(spark, table(spark, [(i, x, "en", "s") for i, x in enumerate(lines)])).collect()
    assert {r.doc_id for r in got if r.lines_removed} == {1, 2, 7, 9}
    assert {r.doc_id: r.text for r in got} == brute(list(enumerate(lines)))


def test_one_id_with_two_texts(spark):
    a, b = "the first line here\n" + prose(1, 12), prose(2, 12) + "\n" + prose(1, 12)
    docs = [(1, a, "en", "s"), (1, b, "en", "s"), (1, a, "en", "s"), (2, prose(1, 12), "en", "s")]
    got = sorted((r.doc_id, r.text) for r in dedup_lines(spark, table(spark, docs)).collect())
    assert got == sorted([(1, a), (1, b), (1, a), (2, "")])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = {r.doc_id: r for r in dedup_lines(spark, docs).collect()}
    assert out[2].text == "" and out[2].lines_removed == 1 and out[1].lines_removed == 0
    assert out[4].text is None and out[4].lines_before == 0 and out[6].text == "\n \n" and out[None].lines_removed == 0
    assert dedup_lines(spark, docs, keep_empty=False).where("doc_id = 2").isEmpty()
    wide = dedup_lines(spark, clashing(docs))
    assert wide.columns[: len(docs.columns)] == docs.columns and "bucket" in wide.columns
    assert sorted_rows(wide.select(*docs.columns)) == sorted_rows(dedup_lines(spark, docs).select(*docs.columns))
    assert dedup_lines(spark, empty(spark)).isEmpty()
