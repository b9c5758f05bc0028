"""Small tables with everything that goes wrong: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words=40, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ne", "tu", "ra", "si", "po"]) for _ in range(r.randint(1, 4))) + str(r.randrange(vocabulary) if r.random() < 0.1 else "") for _ in range(words))


def table(spark, rows):
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


def odd_docs(spark):
    """Nulls in every column, empty and long texts, exact copies, a repeated row, a null id."""
    copy = prose(1)
    rows = [
        (1, copy, "en", "a"), (2, copy, "en", "a"), (3, prose(2, 3000), None, "b"), (4, None, "en", None), (5, "", "de", "b"),
        (6, "\n \n", "de", "b"), (7, prose(3), "fr", "a"), (7, prose(3), "fr", "a"), (None, prose(4), "en", "a"), (8, "one", "en", "c"), (9, "日本語 Ω é x", "ja", "c"),
    ]
    return table(spark, rows)


def clashing(docs):
    """The same table with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("key", "class_id", "rep", "doc", "line", "score", "topic2", "p", "block", "row", "z", "a", "b", "bucket", "lines_x", "words", "mark", "h")
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
