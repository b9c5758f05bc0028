"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF
word shingles, banded, verified by weighted Jaccard similarity.

Shingles are windows of five words (`_text`). A shingle's weight is its count
in the document times its idf, ``1 + ln((1+N)/(1+df)) / ln((1+N)/(1+N/100))``:
2 for a shingle in one document of a hundred, 1 for one in all. ``df`` is counted
exactly, by shingle, over *all* documents; rarer shingles weigh 2 as well, so
only the common ones have to be known to every task, and their number is at
most a hundred times the distinct shingles of an average document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._memory import lean
from ._store import Scratch
from ._text import distinct, gathered, mix, shingle_hashes, taken, word_hashes

#: Share of all documents from which a shingle is common.
COMMON = 0.01
BANDS, ROWS = 10, 3
SIMILARITY = 0.8
#: Documents and shingles that a side of a tile holds on average.
CHUNK, CHUNK_SHINGLES = 256, 100_000

_ROWS_AT_ONCE = 1024


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _uniforms(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two open uniforms from the upper and middle 24 bits."""
    scale = np.float32(2.0**-24)
    a = ((h >> np.uint64(40)).astype(np.uint32)).astype(np.float32)
    b = ((h >> np.uint64(16)).astype(np.uint32) & np.uint32(0xFFFFFF)).astype(np.float32)
    a += np.float32(0.5)
    b += np.float32(0.5)
    a *= scale
    b *= scale
    return a, b


def icws(keys: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """``samples`` consistent weighted samples of a weighted set, as uint32.

    Two sets agree in a sample with the probability of their weighted Jaccard
    similarity. r and c are Gamma(2, 1), beta uniform, all functions of the
    element's hash and the sample's number; the sample is the element with the
    smallest ln a = ln c - r (t - beta + 1), t = floor(ln w / r + beta),
    together with t.
    """
    first, second = _odd(11, samples), _odd(23, samples)
    best = np.full(samples, np.inf, dtype=np.float32)
    out = np.zeros(samples, dtype=np.uint64)
    columns = np.arange(samples)
    for at in range(0, len(keys), _ROWS_AT_ONCE):
        k = keys[at : at + _ROWS_AT_ONCE, None]
        lnw = np.log(weights[at : at + _ROWS_AT_ONCE]).astype(np.float32)[:, None]
        h = k * first
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        u1, u2 = _uniforms(h)
        g = k * second
        g ^= g >> np.uint64(31)
        g *= np.uint64(0x94D049BB133111EB)
        g ^= g >> np.uint64(29)
        u3, u4 = _uniforms(g)
        g ^= h
        g *= np.uint64(0xD6E8FEB86659FD93)
        beta = (g >> np.uint64(40)).astype(np.uint32).astype(np.float32)
        beta *= np.float32(2.0**-24)
        u1 *= u2
        r = np.negative(np.log(u1, out=u1), out=u1)
        u3 *= u4
        lnc = np.log(np.negative(np.log(u3, out=u3), out=u3), out=u3)
        t = np.floor(lnw / r + beta)
        a = lnc - r * (t - beta + np.float32(1))
        low = a.argmin(axis=0)
        value = a[low, columns]
        won = value < best
        best[won] = value[won]
        picked = keys[at : at + _ROWS_AT_ONCE][low] ^ (t[low, columns].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[won] = picked[won]
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A signed 64-bit hash of each band's rows and number."""
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signature[k : bands * rows : rows].astype(np.uint64))
    return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; two empty sets are alike."""
    (ka, wa), (kb, wb) = a, b
    total = float(wa.sum() + wb.sum())
    if not total:
        return 1.0
    at = np.searchsorted(kb, ka)
    hit = np.zeros(len(ka), dtype=bool)
    if len(kb):
        hit = kb[np.minimum(at, len(kb) - 1)] == ka
    low = float(np.minimum(wa[hit], wb[at[hit]]).sum())
    return low / (total - low)


@dataclass
class Idf:
    """The idf of the common shingles (sorted hashes); all others weigh ``RARE``."""

    common: np.ndarray
    weight: np.ndarray
    RARE = 2.0

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.RARE)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, keys), len(self.common) - 1)
            known = self.common[at] == keys
            out[known] = self.weight[at[known]]
        return out


def idf_weight(df: np.ndarray, n: int, share: float = COMMON) -> np.ndarray:
    return 1 + np.log((1 + n) / (1 + np.maximum(df, share * n))) / np.log((1 + n) / (1 + share * n))


def weighted_shingles(words: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = distinct(shingle_hashes(words))
    return keys, counts * idf.of(keys)


def shingle_idf(docs: DataFrame, tmp: Scratch, text: str = "text", share: float = COMMON) -> Idf:
    """The exact document frequencies of the shingles that a share of all documents has, as idf.

    What a share of all documents has, half that share has over the chunks in
    which half that share has it, so a chunk reports no others; the second scan
    counts what may be common, at most twice as many as can be.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """The number of documents with words of a chunk and their distinct shingles."""
        for batch in taken(batches, 0):
            found = [distinct(shingle_hashes(words))[0] for _, words in word_hashes(batch.column(0).to_pylist()) if len(words)]
            yield len(found), np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for parts in gathered(sets(batches), lambda part: len(part[1]), CHUNK_SHINGLES * 10):
            here = sum(docs_here for docs_here, _ in parts)
            n += here
            values, counts = distinct(np.concatenate([keys for _, keys in parts]))
            kept = counts > share / 2 * here
            yield pa.RecordBatch.from_arrays([pa.array(values[kept].view(np.int64)), pa.array(counts[kept]), pa.nulls(int(kept.sum()), pa.int64())], ["shingle", "df", "docs"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([n], pa.int64())], ["shingle", "df", "docs"])

    texts = docs.select(text)
    sums = tmp.keep(texts.mapInArrow(lean(often), "shingle bigint, df bigint, docs bigint").groupBy("shingle").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs")), "often")
    n = int(sums.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0])
    maybe = np.sort(np.asarray(sums.where(f"shingle is not null and df >= {share / 2 * n}").select("shingle").toArrow()["shingle"], dtype=np.int64).view(np.uint64))
    tmp.drop("often")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(maybe), dtype=np.int64)
        for _, keys in sets(batches):
            at = np.minimum(np.searchsorted(maybe, keys), len(maybe) - 1)
            seen += np.bincount(at[maybe[at] == keys], minlength=len(maybe))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["place", "df"])

    if not len(maybe):
        return Idf(maybe, np.zeros(0))
    rows = texts.mapInArrow(lean(count), "place int, df bigint").groupBy("place").agg(F.sum("df").alias("df")).where(f"df > {share * n}").toArrow()
    place, df = np.asarray(rows["place"], dtype=np.int64), np.asarray(rows["df"], dtype=np.float64)
    order = np.argsort(place)
    return Idf(maybe[place[order]], idf_weight(df[order], n, share))


def _digest(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()


def _signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """(doc, same, n, bands) of (doc_id, text): a digest of the text, its number of shingles and its bands' hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches, 1):
            texts = batch.column(1).to_pylist()
            bands, n = [], []
            for _, words in word_hashes(texts):
                keys, weights = weighted_shingles(words, idf)
                bands.append(band_hashes(icws(keys, weights, BANDS * ROWS)).tolist() if len(keys) else [])
                n.append(len(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, texts), pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc", "same", "n", "bands"])

    return docs.mapInArrow(lean(sign), "doc bigint, same binary, n bigint, bands array<bigint>")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, same, z) of (doc_id, text): the digest and the compressed text."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in taken(batches, 1):
            texts = batch.column(1).to_pylist()
            z = [zip_.compress((x or "").encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, texts), pa.binary()), pa.array(z, pa.binary())], ["doc", "same", "z"])

    return docs.mapInArrow(lean(squeeze), "doc bigint, same binary, z binary")


def _unpacked(z: list[bytes], idf: Idf) -> list[tuple[np.ndarray, np.ndarray]]:
    """The weighted shingles of compressed texts."""
    unzip = zstandard.ZstdDecompressor()
    return [weighted_shingles(words, idf) for _, words in word_hashes([unzip.decompress(x).decode("utf-8", "surrogatepass") for x in z])]


def _verified(pairs: DataFrame, texts: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """(a, b) with a weighted Jaccard similarity of at least ``similarity``; ``texts`` is (node, z).

    A hub with many partners is dealt over as many tasks as its partners fill,
    its text sent once to each; no task gathers a group.
    """
    share = 256
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    dealt = pairs.join(load, "a").withColumn("part", F.expr("cast(pmod(xxhash64(b), parts) as int)")).drop("parts")
    hubs = texts.select(F.col("node").alias("a"), F.col("z").alias("z_a")).join(load, "a").select("a", "z_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(texts.select(F.col("node").alias("b"), F.col("z").alias("z_b")), "b").join(hubs, ["a", "part"]).select("a", "b", "z_a", "z_b").sortWithinPartitions("a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in taken(batches, 3):
            a = batch.column(0).to_pylist()
            found = np.zeros(len(a), dtype=bool)
            for i, own in enumerate(_unpacked(batch.column(3).to_pylist(), idf)):
                if a[i] != hub:
                    hub, hub_set = a[i], _unpacked([batch.column(2)[i].as_py()], idf)[0]
                found[i] = weighted_jaccard(hub_set, own) >= similarity
            yield batch.select([0, 1]).filter(pa.array(found))

    return both.mapInArrow(lean(check), "a bigint, b bigint")


def tile_links(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of sets, one from each side (right null: i < j on the left), that are similar, exactly.

    A shingle that counts c times is c features of its idf; the common weight of
    all pairs is then one matrix product, in slices of the features that more
    than one set has.
    """
    both = left if right is None else left + right
    total = np.array([w.sum() for _, w in both])
    shared = np.zeros((len(left), len(left if right is None else right)))
    if len(both) <= 16:
        for i, x in enumerate(left):
            for j, y in enumerate(left if right is None else right):
                if right is not None or i < j:
                    shared[i, j] = _common(x, y)
    else:
        row = np.repeat(np.arange(len(both)), [len(k) for k, _ in both])
        keys, at, seen = np.unique(np.concatenate([k for k, _ in both]), return_inverse=True, return_counts=True)
        weight = np.concatenate([w for _, w in both])
        several = seen[at] > 1
        row, at, weight = row[several], at[several], weight[several]
        order = np.argsort(at, kind="stable")
        row, weight = row[order], weight[order]
        _, at = np.unique(at[order], return_inverse=True)
        low = 0
        while low < len(at):
            high = int(np.searchsorted(at, at[low] + 2048))
            levels = _levels(row[low:high], at[low:high] - at[low], weight[low:high])
            for rows, features, worth in levels:
                x = np.zeros((len(both), int(features.max()) + 1))
                x[rows, features] = np.sqrt(worth)
                shared += x[: len(left)] @ (x if right is None else x[len(left) :]).T
            low = high
    union = total[: len(left), None] + total[None, -shared.shape[1] :] - shared
    alike = shared >= similarity * union
    edge = np.abs(shared - similarity * union) < 1e-7 * union
    if right is None:
        alike, edge = np.triu(alike, 1), np.triu(edge, 1)
    for i, j in zip(*np.nonzero(edge), strict=True):
        alike[i, j] = weighted_jaccard(left[i], (left if right is None else right)[j]) >= similarity
    return np.nonzero(alike)


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum of minima."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), dtype=bool)
    return float(np.minimum(a[1][hit], b[1][at[hit]]).sum())


def _levels(row: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries cut so that minima become products: of each feature's distinct weights, each step up is a feature of its own."""
    while len(row):
        least = np.full(int(feature.max()) + 1, np.inf)
        np.minimum.at(least, feature, weight)
        step = least[feature]
        yield row, feature, step
        more = weight > step
        row, feature, weight = row[more], feature[more], weight[more] - step[more]


def _settled(members: DataFrame, texts: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """(a, b): verified links between the classes of each bucket.

    ``members`` is (bucket, node, n, root). Every pair of a bucket's documents
    that are of different classes is verified, in tiles of two blocks with a
    bounded number of documents and shingles; the largest class is dealt to
    blocks of its own, and those do not meet each other. Of the links between
    two classes a tile reports one.
    """
    sums = members.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    mixed = sums.groupBy("bucket").agg(F.count("*").alias("classes"), F.max_by("root", "c").alias("major"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.max("c").alias("major_c"), F.max_by("w", "c").alias("major_w")).where("classes > 1")
    blocks = "cast(ceil(greatest({0} / {2}e0, {1} / {3}e0, 1e0)) as int)"
    mixed = mixed.selectExpr("bucket", "major", f"{blocks.format('(c - major_c)', '(w - major_w)', CHUNK, CHUNK_SHINGLES)} as others", f"{blocks.format('major_c', 'major_w', CHUNK, CHUNK_SHINGLES)} as majors")
    placed = members.join(mixed, "bucket").selectExpr("bucket", "node", "root", "others", "majors", "root = major as in_major", "cast(pmod(xxhash64(node), case when root = major then majors else others end) as int) as mine")
    among = "transform(sequence(0, others - 1), i -> named_struct('kind', 0, 'x', least(i, mine), 'y', greatest(i, mine)))"
    against = "transform(sequence(0, {0} - 1), i -> named_struct('kind', 1, 'x', {1}, 'y', {2}))"
    tiles = f"case when in_major then {against.format('others', 'i', 'mine')} else concat({among}, {against.format('majors', 'mine', 'i')}) end"
    rows = placed.join(texts, "node").selectExpr("bucket", f"explode({tiles}) as tile", "node", "root", "in_major", "mine", "z").select("bucket", "tile.*", "node", "root", "in_major", "mine", "z")
    keys = ["bucket", "kind", "x", "y"]

    def close(whole: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        kind, x, y = (whole.column(c)[0].as_py() for c in ("kind", "x", "y"))
        node, root, mine = (whole.column(c).to_numpy() for c in ("node", "root", "mine"))
        sets = _unpacked(whole.column("z").to_pylist(), idf)
        second = np.asarray(whole.column("in_major").to_pylist()) if kind else mine == y if x != y else np.zeros(len(node), dtype=bool)
        one, two = np.flatnonzero(~second), np.flatnonzero(second)
        inner = not kind and x == y
        if not len(one) or not (inner or len(two)):
            return node[:0], node[:0]
        i, j = tile_links([sets[k] for k in one], None if inner else [sets[k] for k in two], similarity)
        a, b = one[i], (one if inner else two)[j]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        _, first = np.unique(np.stack([np.minimum(root[a], root[b]), np.maximum(root[a], root[b])]), axis=1, return_index=True)
        return node[a[first]], node[b[first]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        key = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in close(pa.Table.from_batches(waiting))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in keys]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                here = tuple(c[at] for c in columns)
                if waiting and here != key:
                    yield out()
                    waiting = []
                key = here
                waiting.append(batch.slice(int(at), int(end - at)))
        if waiting:
            yield out()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(work), "a bigint, b bigint")


def _roots(edges: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """(node, root) of every linked text, kept."""
    stars = Scratch(tmp.spark, "classes")
    out = tmp.keep(components(edges, stars), name)
    stars.drop("")
    return out


def _classified(docs: DataFrame, tmp: Scratch, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc, same, n) of every row of (doc_id, text), and (same, doc, root) of every distinct text with an id, doc the smallest that has it."""
    idf = shingle_idf(docs, tmp)
    signed = tmp.keep(_signatures(docs, idf), "signed")
    least = signed.where("doc is not null").groupBy("same").agg(F.min("doc").alias("doc"))
    # A node is a text, so that an id with two texts has two.
    nodes = tmp.keep(signed.join(least, ["doc", "same"]).dropDuplicates(["doc", "same"]).select(F.monotonically_increasing_id().alias("node"), "same", "doc", "n", "bands"), "nodes")
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    shared = tmp.keep(spread.join(sizes, "bucket"), "shared")
    busy = shared.groupBy("node").agg(F.sum("mates").alias("busy"))
    hubs = shared.join(busy, "node").groupBy("bucket").agg(F.max_by("node", "busy").alias("hub"))
    held = tmp.keep(shared.join(hubs, "bucket").where("node <> hub").select("bucket", "node", "n", "hub"), "held")
    wanted = shared.select("node").distinct().join(nodes.select("node", "doc", "same"), "node")
    texts = tmp.keep(_packed(docs).join(wanted, ["doc", "same"]).select("node", "z").dropDuplicates(["node"]), "texts")
    pairs = held.groupBy(F.least("node", "hub").alias("lo"), F.greatest("node", "hub").alias("hi")).agg(F.min("hub").alias("a")).select("a", (F.col("lo") + F.col("hi") - F.col("a")).alias("b"))
    links = tmp.keep(_verified(pairs, texts, idf, similarity), "links")
    first = _roots(links, tmp, "first")
    members = held.join(first, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    found = tmp.keep(_settled(members, texts, idf, similarity), "found")
    last = first if found.isEmpty() else _roots(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found), tmp, "last")
    classes = tmp.keep(nodes.join(last, "node", "left").select("same", "doc", F.coalesce("root", "node").alias("root")), "classes")
    tmp.drop("nodes", "shared", "held", "texts", "links", "first", "found", "last")
    return signed.select("doc", "same", "n"), classes


def near_duplicates(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id long, class_id long, n_shingles long), a row for each row of ``docs``.

    ``class_id`` is the smallest doc_id of the connected class of documents
    linked by a verified similarity of ``similarity`` or more; it equals doc_id
    for a document that stands alone. Exact copies (equal texts) share a class
    by a group key, without pairs.

    Candidates share a band of their signatures. First each bucket's document
    with the most bucket mates over all bands is verified against the others,
    which brings a large group of copies into one class in linear time. Then
    all pairs of a bucket whose documents are still in different classes are
    verified in tiles, so no candidate pair is left unsettled. Documents that
    are alike but not near (many of one template) cost the square of their number.

    Null and empty texts are equal to each other and to nothing else; a text
    without words links only to equal texts; under five words the whole text
    is one shingle. Rows with a null doc_id come back with a null class.
    Repeated rows share their class; a doc_id with two texts has a row and a
    class for each. An empty table gives no rows. Other columns of ``docs``
    are not read.
    """
    tmp = Scratch(spark, "neardup")
    signed, classes = _classified(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tmp, similarity)
    least = classes.groupBy("root").agg(F.min("doc").alias("class_id"))
    named = classes.join(least, "root").select("same", "class_id")
    out = tmp.keep(signed.join(named, "same", "left").select(F.col("doc").alias("doc_id"), F.when(F.col("doc").isNotNull(), F.col("class_id")).alias("class_id"), F.col("n").alias("n_shingles")), "out")
    tmp.drop("signed", "classes")
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, one for each class of ``near_duplicates``: that with the smallest doc_id.

    Of two texts of one class and doc_id the one with the smaller digest stays,
    of rows equal in both one (by a hash of all columns). Rows without a doc_id stay.
    """
    tmp = Scratch(spark, "neardup")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    signed, classes = _classified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tmp, similarity)
    stays = classes.groupBy("root").agg(F.min(F.struct("doc", "same")).alias("first")).select("first.*")
    rows = signed.where("doc is not null").groupBy("doc", "same").agg(F.count("*").alias("_rows"))
    stays = tmp.keep(rows.join(stays, ["doc", "same"]).withColumnsRenamed({"doc": "_doc", "same": "_same"}), "stays")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    kept = tmp.keep(plain.where(id_.isNotNull()).join(stays, (id_.cast("long") == F.col("_doc")) & (digest == F.col("_same"))), "kept")
    one = kept.where("_rows = 1").select(*names)
    several = kept.where("_rows > 1").groupBy("_doc", "_same").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")
    tmp.drop("signed", "classes", "stays")
    return one.union(several).union(plain.where(id_.isNull())).toDF(*docs.columns)
