"""Line de-duplication by a deletion-neighbourhood join.

A line's symbols are its words (`_text`), or from MIN_WORDS words down the
characters of its words with one space between. Every variant within the edit
bound of one symbol - the line itself and the line without each single symbol -
is emitted as a hashed key; equal variants are joined, the edit distance of what
met is verified on the symbols, and the earliest line stays. A line of under
SHORTEST characters has no variants, and digits of short lines never differ.

Two lines one edit apart share their first or last half, so only lines that
share a half with another line emit variants; none is lost by that. Equal lines
are combined within a chunk of text before they meet those of others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memory import lean
from ._parcels import by_slot, column, dealt, entries
from ._store import Scratch
from ._text import _INVERSE, _MULTIPLIER, SEGMENT, hash_blob, mix, taken

#: Lines of fewer words are compared by their characters.
MIN_WORDS = 8
#: Characters that a line of few words must have to be near another.
SHORTEST = 12
#: Slots for each shuffle partition, so that partitions get about as many.
SLOTS = 4

_SECOND = 0xC2B2AE3D27D4EB4F
_WORDED = re.compile("[0-9A-Za-z\u0080-\U0010ffff]")
_LINE_SCHEMA = "doc bigint, line int, crc bigint"


def words_of(line: str) -> list[str]:
    """The words as `_text` sees them."""
    blob = line.lower().encode("utf-8", "surrogatepass")
    raw = np.frombuffer(blob, dtype=np.uint8)
    keep = ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    return np.where(keep, raw, 32).astype(np.uint8).tobytes().decode("utf-8", "replace").split()


def symbols(line: str) -> list[str]:
    """Words, or the characters of a line of few words."""
    words = words_of(line)
    return words if len(words) >= MIN_WORDS else list(" ".join(words))


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two lists is 1 at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def near(one: str, other: str) -> bool:
    """Whether two lines are within the bound of each other."""
    a, b = words_of(one), words_of(other)
    if len(a) >= MIN_WORDS and len(b) >= MIN_WORDS:
        return within_one(a, b)
    if len(a) >= MIN_WORDS or len(b) >= MIN_WORDS:
        return False
    a, b = list(" ".join(a)), list(" ".join(b))
    return min(len(a), len(b)) >= SHORTEST and [x for x in a if x.isdigit()] == [x for x in b if x.isdigit()] and within_one(a, b)


class _Lines:
    """Hashes of the lines of many texts: polynomials over word hashes, so that any run of words has its hash from prefix sums."""

    def __init__(self, texts: list[str | None]):
        lines, self.doc, self.number = [], [], []
        for i, text in enumerate(texts):
            own = (text or "").split("\n")
            lines += own
            self.doc += [i] * len(own)
            self.number += range(len(own))
        words, counts = [], []
        at = 0
        while at < len(lines):
            blobs, size = [], 0
            while at + len(blobs) < len(lines) and (not blobs or size < SEGMENT):
                blobs.append(lines[at + len(blobs)].lower().encode("utf-8", "surrogatepass"))
                size += len(blobs[-1]) + 1
            found, starts = hash_blob(b"\n".join(blobs))
            bounds = np.cumsum([len(x) + 1 for x in blobs])
            cuts = np.searchsorted(starts, bounds)
            words.append(found)
            counts.append(np.diff(cuts, prepend=0))
            at += len(blobs)
        self.raw = lines
        self.words = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
        self.n = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, dtype=np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.prefix = [self._sums(m) for m in (_MULTIPLIER, _SECOND)]

    def _sums(self, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
        steps = np.full(len(self.words) + 1, pow(multiplier, -1, 1 << 64), dtype=np.uint64)
        steps[0] = 1
        down = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = multiplier
        up = np.cumprod(steps, dtype=np.uint64)
        total = np.zeros(len(self.words) + 1, dtype=np.uint64)
        np.cumsum(self.words * up[:-1], out=total[1:])
        return total, down

    def run(self, low: np.ndarray, high: np.ndarray, which: int = 0) -> np.ndarray:
        """The hash of words low to high, by content alone."""
        total, down = self.prefix[which]
        return (total[high] - total[low]) * down[low]

    def whole(self, which: int) -> np.ndarray:
        return mix(self.run(self.first, self.first + self.n, which) + self.n.astype(np.uint64))

    def halves(self) -> np.ndarray:
        """Four keys a line: its first and last n // 2 and (n + 1) // 2 words."""
        out = []
        for k in (self.n // 2, (self.n + 1) // 2):
            out.append(mix(self.run(self.first, self.first + k) + np.uint64(2) * k.astype(np.uint64)))
            out.append(mix(self.run(self.first + self.n - k, self.first + self.n) + np.uint64(2) * k.astype(np.uint64) + np.uint64(1)))
        return np.stack(out, axis=1)

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, place) of the line itself (place -1) and of the line without each word."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(len(self.words))
        low, high = self.first[line], (self.first + self.n)[line]
        place = at - low
        total, down = self.prefix[0]
        left = (total[at] - total[low]) * down[low]
        right = (total[high] - total[at + 1]) * down[low] * np.uint64(_INVERSE)
        short = mix(left + right + (self.n[line] - 1).astype(np.uint64))
        return np.concatenate([np.arange(len(self.n)), line]), np.concatenate([self.whole(0), short]), np.concatenate([np.full(len(self.n), -1), place])


def _short_halves(text: str) -> list[int]:
    """Four keys of a line of few words: its first and last n // 2 and (n + 1) // 2 characters."""
    cuts = {len(text) // 2, (len(text) + 1) // 2}
    return [xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), seed=seed) for k in cuts for part, seed in ((text[:k], 2 * k), (text[len(text) - k :], 2 * k + 1))]


def _scan(slots: int):
    """The kernel that reads all texts once; rows of four kinds, each a chunk's entries for a slot.

    0: the chunk's first line of each kind, dealt by the kind; 1: its other
    lines, which go; 2: one line for each half, dealt by the half; 3: lines that
    share a half within the chunk. ``key`` and ``second`` are 64 bits each.
    """

    def rows(kind: int, slot: np.ndarray, key: np.ndarray, second: np.ndarray, doc: np.ndarray, line: np.ndarray, crc: np.ndarray) -> pa.RecordBatch:
        numbers, bounds, arrays = dealt(slot, [key, second, doc, line, crc])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), kind, dtype=np.int32)), pa.array(numbers.astype(np.int32)), *(column(x, bounds) for x in arrays)], ["kind", "slot", "key", "second", "doc", "line", "crc"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches, 1):
            texts = batch.column(1).to_pylist()
            lines = _Lines(texts)
            keep = np.flatnonzero(lines.n > 0)
            if not len(keep):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            doc, line = ids[np.asarray(lines.doc, dtype=np.int64)[keep]], np.asarray(lines.number, dtype=np.int32)[keep]
            raw = [lines.raw[k] for k in keep.tolist()]
            crc = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in raw), dtype=np.uint32, count=len(raw))
            k1, k2 = lines.whole(0)[keep], lines.whole(1)[keep]
            order = np.lexsort((line, doc, k2, k1))
            new = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))
            head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            again = order[(doc[order] != doc[head]) | (line[order] != line[head])]
            heads = order[new]
            none = np.zeros(len(again), dtype=np.uint64)
            yield rows(0, (k1[heads] % np.uint64(slots)).astype(np.int64), k1[heads], k2[heads], doc[heads], line[heads], crc[heads])
            yield rows(1, np.zeros(len(again), dtype=np.int64), none, none, doc[again], line[again], crc[again])
            long_ = heads[lines.n[keep[heads]] >= MIN_WORDS]
            halves, owners = [lines.halves()[keep[long_]].reshape(-1)], [np.repeat(k1[long_], 4)]
            for i in heads[lines.n[keep[heads]] < MIN_WORDS].tolist():
                text = " ".join(words_of(raw[i]))
                if len(text) >= SHORTEST - 1:
                    own = _short_halves(text)
                    halves.append(np.array(own, dtype=np.uint64))
                    owners.append(np.full(len(own), k1[i], dtype=np.uint64))
            half, owner = np.concatenate(halves), np.concatenate(owners)
            order = np.lexsort((owner, half))
            half, owner = half[order], owner[order]
            fresh = np.append(True, (half[1:] != half[:-1]) | (owner[1:] != owner[:-1]))[: len(half)]
            half, owner = half[fresh], owner[fresh]
            first = np.append(True, half[1:] != half[:-1])[: len(half)]
            alone = first & np.append(first[1:], True)[: len(half)]
            shared = np.unique(owner[~alone])
            empty = [np.zeros(n, dtype=t) for n in (int(first.sum()), len(shared)) for t in (np.int64, np.int32, np.uint32)]
            yield rows(2, (half[first] % np.uint64(slots)).astype(np.int64), half[first], owner[first], *empty[:3])
            yield rows(3, np.zeros(len(shared), dtype=np.int64), shared, shared, *empty[3:])

    return lean(scan)


@lean
def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1 as lines."""
    for batch in batches:
        doc, line, crc = (entries([batch.column(c)], t) for c, t in (("doc", "<i8"), ("line", "<i4"), ("crc", "<u4")))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line), pa.array(crc.astype(np.int64))], ["doc", "line", "crc"])


@lean
def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, doc, line, crc, gone) of the chunks' first lines: the first of all stays."""
    for table in by_slot(batches):
        k1, k2, doc, line, crc = (entries(table.column(c).chunks, t) for c, t in (("key", "<u8"), ("second", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("crc", "<u4")))
        order = np.lexsort((line, doc, k2, k1))
        k1, k2, doc, line, crc = (x[order] for x in (k1, k2, doc, line, crc))
        new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (doc != doc[head]) | (line != line[head])
        out = new | gone
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (k1.view(np.int64), doc, line, crc.astype(np.int64), gone)], ["k1", "doc", "line", "crc", "gone"])


@lean
def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kinds (k1) that share a half with a line of another chunk, from rows of kinds 2 and 3."""
    for table in by_slot(batches):
        kind = table.column("kind").to_numpy()
        for which in (2, 3):
            part = table.filter(pa.array(kind == which))
            if not part.num_rows:
                continue
            key, owner = (entries(part.column(c).chunks, "<u8") for c in ("key", "second"))
            if which == 2:
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                new = np.append(True, key[1:] != key[:-1])
                bounds = np.append(np.flatnonzero(new), len(key))
                several = owner[bounds[:-1]] != owner[bounds[1:] - 1]
                owner = owner[np.repeat(several, np.diff(bounds))]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(owner).view(np.int64))], ["k1"])


def _packed(docs: DataFrame) -> DataFrame:
    """doc and its compressed text: what a join has to move."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in taken(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zip_.compress((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()], pa.binary())], ["doc", "z"])

    return docs.mapInArrow(lean(squeeze), "doc bigint, z binary")


@lean
def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, doc, line, body) of the chosen lines of compressed texts; a line must have its checksum."""
    unzip = zstandard.ZstdDecompressor()
    for batch in taken(batches, 1):
        out = []
        for doc, z, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = unzip.decompress(z).decode("utf-8", "surrogatepass").split("\n")
            out += [(x["k1"], doc, x["line"], lines[x["line"]]) for x in chosen if x["line"] < len(lines) and zlib.crc32(lines[x["line"]].encode("utf-8", "surrogatepass")) == x["crc"]]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["k1", "doc", "line", "body"])


@lean
def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, doc, line, key, place) of every variant; place -1 is the line itself."""
    for batch in taken(batches, 3):
        bodies = [x.replace("\n", " ") for x in batch.column(3).to_pylist()]
        lines = _Lines(bodies)
        row, key, place = lines.variants()
        by_word = lines.n[row] >= MIN_WORDS
        found = [(row[by_word], key[by_word], place[by_word])]
        for i in np.flatnonzero(lines.n < MIN_WORDS).tolist():
            text = " ".join(words_of(bodies[i]))
            cuts = [text, *(text[:k] + text[k + 1 :] for k in range(len(text)))]
            found.append((np.full(len(cuts), i), np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed=7) for x in cuts], dtype=np.uint64), np.arange(-1, len(cuts) - 1)))
        row, key, place = (np.concatenate(x) for x in zip(*found, strict=True))
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(key.view(np.int64)), pa.array(place, pa.int32())], ["k1", "doc", "line", "key", "place"])


@lean
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in taken(batches, 1):
        keep = [near(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield batch.select(["k1"]).filter(pa.array(keep, pa.bool_()))


def repeated_lines(spark: SparkSession, docs: DataFrame, tmp: Scratch) -> DataFrame:
    """(doc long, line int, crc long) of every line to be removed; ``docs`` is (doc, text), crc that of the line's bytes.

    A line goes if an earlier line - smaller doc_id, then smaller number - is
    equal in words, or within the bound of it (an earlier line counts even if it
    goes itself). Lines without words stay.
    """
    slots = SLOTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "kind int, slot int, key binary, second binary, doc binary, line binary, crc binary"
    found = tmp.keep(docs.mapInArrow(_scan(slots), schema), "found")
    by_kind = found.where("kind = 0").drop("kind").repartition("slot").sortWithinPartitions("slot")
    firsts = tmp.keep(by_kind.mapInArrow(_firsts, "k1 bigint, doc bigint, line int, crc bigint, gone boolean"), "firsts")
    by_half = found.where("kind in (2, 3)").select("slot", "kind", "key", "second").repartition("slot").sortWithinPartitions("slot")
    sharing = by_half.mapInArrow(_sharing, "k1 bigint").distinct()
    chosen = firsts.where("not gone").join(sharing, "k1", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("k1", "line", "crc")).alias("chosen"))
    bodies = tmp.keep(_packed(docs).join(chosen.hint("shuffle_hash"), "doc").select("doc", "z", "chosen").mapInArrow(_bodies, "k1 bigint, doc bigint, line int, body string").dropDuplicates(["k1"]), "bodies")
    variants = bodies.mapInArrow(_variant_rows, "k1 bigint, doc bigint, line int, key bigint, place int")
    shared = variants.groupBy("key").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("key")
    met = tmp.keep(variants.join(shared, "key", "left_semi").selectExpr("key", "place", "struct(doc, line, k1) as pos"), "met")
    selves, shorts = met.where("place = -1").select("key", "pos"), met.where("place >= 0")
    # One symbol replaced: the same place and the same rest. One more or less: a variant equal to a whole line.
    replaced = shorts.join(shorts.groupBy("key", "place").agg(F.min("pos").alias("earlier")), ["key", "place"]).where("earlier < pos").select("pos", "earlier")
    longer = shorts.select("key", "pos").join(selves.withColumnRenamed("pos", "earlier"), "key").where("earlier < pos").select("pos", "earlier")
    shorter = selves.join(shorts.groupBy("key").agg(F.min("pos").alias("earlier")), "key").where("earlier < pos").select("pos", "earlier")
    edges = replaced.union(longer).union(shorter).selectExpr("pos.k1 as k1", "earlier.k1 as other_k1").distinct()
    body = bodies.select("k1", "body")
    held = edges.join(body, "k1").join(body.withColumnsRenamed({"k1": "other_k1", "body": "other"}), "other_k1").select("k1", "body", "other")
    close = held.mapInArrow(_verify, "k1 bigint").distinct()
    gone = firsts.where("gone").select("doc", "line", "crc").union(firsts.where("not gone").join(close, "k1", "left_semi").select("doc", "line", "crc"))
    out = tmp.keep(gone.union(found.where("kind = 1").mapInArrow(_unpacked, _LINE_SCHEMA)), "removed")
    tmp.drop("found", "firsts", "bodies", "met")
    return out


def dedup_lines(spark: SparkSession, docs: DataFrame, *, keep_empty: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns, ``text`` without repeated lines, and line counts ``lines_before``, ``lines_removed``.

    What goes is said in ``repeated_lines``; the lines that stay keep their
    order, bytes and line feeds. A null text stays null and has no lines; rows
    with a null doc_id stay as they are. Rows of one doc_id count as one
    document. With ``keep_empty`` false, documents go whose words have all been
    removed. An empty table gives no rows.
    """
    tmp = Scratch(spark, "lines")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    id_, text = names["doc_id"], names["text"]
    keyed = plain.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("doc"), F.col(text).alias("text"))
    removed = repeated_lines(spark, keyed, tmp)
    by_doc = removed.groupBy("doc").agg(F.collect_list(F.struct("line", "crc")).alias("gone"))
    at = [*names].index("text")
    zipped_schema = ", ".join(f"{names[f.name]} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in taken(batches, at):
            z = pa.array([None if x is None else zip_.compress(x.encode("utf-8", "surrogatepass")) for x in batch.column(at).to_pylist()], pa.binary())
            yield batch.set_column(at, batch.schema.names[at], z)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in taken(batches, at):
            texts: list[str | None] = [None if z is None else unzip.decompress(z).decode("utf-8", "surrogatepass") for z in batch.column(at).to_pylist()]
            before, cut, stays = [], [], []
            for i, (text, gone) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                lines = [] if text is None else text.split("\n")
                before.append(len(lines))
                cut.append(0)
                stays.append(True)
                if gone and text is not None:
                    out = {g["line"] for g in gone if g["line"] < len(lines) and zlib.crc32(lines[g["line"]].encode("utf-8", "surrogatepass")) == g["crc"]}
                    cut[i] = len(out)
                    texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in out)
                    stays[i] = keep_empty or not out or bool(_WORDED.search(texts[i]))
            result = batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.string()))
            arrays = [*result.columns[:-1], pa.array(before, pa.int64()), pa.array(cut, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*result.schema.names[:-1], "_before", "_cut"]).filter(pa.array(stays, pa.bool_()))

    moved = plain.mapInArrow(lean(squeeze), zipped_schema)
    joined = moved.join(by_doc.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), F.col(id_).cast("long") == F.col("_doc"), "left").drop("_doc")
    schema = ", ".join(f"{names[f.name]} {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _before bigint, _cut bigint"
    out = joined.mapInArrow(lean(rebuild), schema)
    return out.toDF(*docs.columns, "lines_before", "lines_removed")


def line_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, lines_before, lines_removed, kept_sha256, kept_chars) of ``dedup_lines``, a row for each row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return dedup_lines(spark, source).select("doc_id", "lines_before", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.length("text").cast("long").alias("kept_chars"))
