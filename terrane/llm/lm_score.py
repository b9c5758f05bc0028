"""Cross-entropy difference: matched target and background n-gram models score each document.

Both models are word bigram models over one shared vocabulary: the words (`_text`;
characters of scripts that are written without spaces are words of their own)
that make up a share of KNOWN or more of the corpus, and the end of a text. A
rarer word has a fixed small probability and, as a context, leaves the next
token to its unigram estimate. Bigrams of known contexts are counted exactly,
over all documents (target: those that are marked), in tables that grow with the
corpus: each is dealt to a slot, which counts it and answers for the documents
that share it with others. The background is scaled to the target's total, both
are smoothed alike towards the unigram estimate, and a document's own bigrams
are left out of the counts that score it. A document's score is the mean over
its tokens of the target loss less the background loss (nats); lower is closer
to the target.

Known words, and bigrams with as large a share, are at most 1 / KNOWN each; they
are sent to every task, so that no slot gathers a common pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memory import lean
from ._parcels import by_slot, column, dealt, entries
from ._store import Scratch
from ._text import gathered, mix, taken, word_hashes

#: Weight, in tokens, of the next shorter context's estimate.
PRIOR = 8.0
#: The unigram probability of a word that is not known.
UNSEEN = 1e-6
#: Share of all tokens from which a word or bigram is known.
KNOWN = 1e-5
#: Tokens of a slot on average: what bounds a task's memory.
SLOT_TOKENS = 4_000_000
#: Tokens of a lot in which words and bigrams are looked for that may be known.
LOT_TOKENS = 1_000_000
#: Target ids (8 bytes each) up to which they are sent to every task; more are joined.
TARGETS_SENT = 4_000_000

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ROWS = 60_000
_SPACELESS = re.compile("([฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff])")


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


@dataclass
class Tokens:
    """The tokens of some texts, ends included; texts without words have none. ``n`` and ``target`` are by text."""

    word: np.ndarray
    before: np.ndarray
    doc: np.ndarray
    n: np.ndarray
    target: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str | None], target: np.ndarray) -> Tokens:
        texts = [x if not x or x.isascii() or not _SPACELESS.search(x) else _SPACELESS.sub(r" \1 ", x) for x in texts]
        parts: list[np.ndarray] = []
        n = np.zeros(len(texts), dtype=np.int64)
        for i, words in word_hashes(texts):
            if len(words):
                parts += [words, np.array([END])]
                n[i] = len(words) + 1
        word = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        before = np.concatenate([[START], word[:-1]]).astype(np.uint64) if len(word) else word
        before[(np.cumsum(n) - n)[n > 0]] = START
        return cls(word, before, np.repeat(np.arange(len(texts)), n), n, target)


@dataclass
class Known:
    """Exact counts (background and target rows) of the known words and bigrams, and the totals of tokens and texts."""

    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    tokens: np.ndarray
    texts: np.ndarray

    @property
    def scale(self) -> float:
        return float(self.tokens[1] / self.tokens[0]) if self.tokens[1] else 1.0

    def shorter(self) -> tuple[np.ndarray, np.ndarray]:
        """(target, background) unigram estimates of the known words, and last of any other."""
        counts = np.append(self.word_counts, np.zeros((2, 1)), axis=1)
        base = np.append((self.word_counts[0] + PRIOR * UNSEEN) / (self.tokens[0] + PRIOR), UNSEEN)
        return (counts[1] + PRIOR * base) / (self.tokens[1] + PRIOR), (self.scale * counts[0] + PRIOR * base) / (self.scale * self.tokens[0] + PRIOR)


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of keys among sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _repeats(group: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How many entries share an entry's group and document."""
    _, at, counts = np.unique(group.astype(np.int64) * docs + doc, return_inverse=True, return_counts=True)
    return counts[at]


def _marked(docs: DataFrame, targets: DataFrame, tmp: Scratch, sent: int) -> tuple[DataFrame, np.ndarray | None]:
    """(key, text, target) or, with few targets, (key, text) and the sorted target ids."""
    source = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").alias("text"))
    marks = targets.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct()
    if marks.limit(sent + 1).count() <= sent:
        return source, np.sort(np.asarray(marks.toArrow()["key"], dtype=np.int64))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in taken(batches, 1):
            z = [None if x is None else zip_.compress(x.encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["key", "text"])

    moved = source.mapInArrow(lean(squeeze), "key bigint, text binary")
    return tmp.keep(moved.join(marks.withColumn("target", F.lit(True)), "key", "left").select("key", "text", F.col("target").isNotNull().alias("target")), "marked"), None


def _chunks(batches: Iterator[pa.RecordBatch], marks: np.ndarray | None) -> Iterator[tuple[list[int | None], list[str | None], Tokens]]:
    """(ids, texts, tokens) of about four megabytes of text at a time."""
    unzip = zstandard.ZstdDecompressor()
    for large in taken(batches, 1):
        for low in range(0, large.num_rows, _ROWS):
            batch = large.slice(low, _ROWS)
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if marks is None:
                texts = [None if z is None else unzip.decompress(z).decode("utf-8", "surrogatepass") for z in texts]
                target = np.asarray(batch.column(2).to_pylist(), dtype=bool)
            else:
                known = np.array([x is not None for x in ids])
                target = _found(marks, np.array([x or 0 for x in ids], dtype=np.int64))[1] & known
            yield ids, texts, Tokens.of(texts, target)


def _candidates(source: DataFrame, marks: np.ndarray | None, tmp: Scratch, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, bigrams, tokens): all with ``share`` or more of the tokens, at most twice its inverse of each, and the number of tokens.

    What reaches a share of all tokens reaches half of it over the chunks in
    which it has half of it; only those chunks' counts are moved.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in gathered((t for _, _, t in _chunks(batches, marks)), lambda t: len(t.word), LOT_TOKENS):
            found = [(2, np.zeros(1, dtype=np.uint64), np.array([sum(len(t.word) for t in lot)]))]
            for kind in (0, 1):
                keys = np.concatenate([_pair(t.before, t.word) if kind else t.word for t in lot])
                values, counts = np.unique(keys, return_counts=True)
                often = counts > share / 2 * len(keys)
                found.append((kind, values[often], counts[often]))
            kinds = np.concatenate([np.full(len(v), k, dtype=np.int32) for k, v, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([v for _, v, _ in found]).view(np.int64)), pa.array(np.concatenate([c for _, _, c in found]).astype(np.int64))], ["kind", "value", "n"])

    sums = tmp.keep(source.mapInArrow(lean(count), "kind int, value bigint, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n")), "often")
    total = int(sums.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rows = sums.where(f"kind < 2 and n >= {share / 2 * total}").toArrow()
    tmp.drop("often")
    kind, value = np.asarray(rows["kind"]), np.asarray(rows["value"], dtype=np.int64).view(np.uint64)
    return np.unique(np.append(value[kind == 0], END)), np.unique(value[kind == 1]), total


def _known(source: DataFrame, marks: np.ndarray | None, words: np.ndarray, pairs: np.ndarray, share: float) -> Known:
    """The exact counts of the candidates, those that are known kept (the end always), and the totals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, n), dtype=np.int64) for n in (len(words), len(pairs), 1, 1)]
        for _, _, t in _chunks(batches, marks):
            marked = t.target[t.doc]
            for out, keys, values in ((sums[0], words, t.word), (sums[1], pairs, _pair(t.before, t.word))):
                at, there = _found(keys, values)
                for row, chosen in ((0, there), (1, there & marked)):
                    out[row] += np.bincount(at[chosen], minlength=out.shape[1])[: out.shape[1]]
            sums[2][:, 0] += len(t.word), int(marked.sum())
            sums[3][:, 0] += int((t.n > 0).sum()), int((t.target & (t.n > 0)).sum())
        kind = np.concatenate([np.full(x.shape[1], k, dtype=np.int32) for k, x in enumerate(sums)])
        place = np.concatenate([np.arange(x.shape[1], dtype=np.int32) for x in sums])
        both = np.concatenate(sums, axis=1)
        some = both[0] > 0
        yield pa.RecordBatch.from_arrays([pa.array(kind[some]), pa.array(place[some]), pa.array(both[0, some]), pa.array(both[1, some])], ["kind", "place", "background", "target"])

    rows = source.mapInArrow(lean(count), "kind int, place int, background bigint, target bigint").groupBy("kind", "place").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toArrow()
    sums = [np.zeros((2, n), dtype=np.int64) for n in (len(words), len(pairs), 1, 1)]
    for k, place, b, t in zip(*(rows[c].to_pylist() for c in ("kind", "place", "background", "target")), strict=True):
        sums[k][:, place] = b, t
    tokens = sums[2][:, 0]
    keep = [(x[0] >= share * tokens[0]) & (x[0] > 0) for x in sums[:2]]
    keep[0] |= words == END
    return Known(words[keep[0]], sums[0][:, keep[0]], pairs[keep[1]], sums[1][:, keep[1]], tokens, sums[3][:, 0])


def _doc_keys(ids: Sequence[int | None], texts: Sequence[str | None]) -> np.ndarray:
    """A key of each row's id and text; equal rows share it."""
    out = [xxhash.xxh3_64_intdigest((x or "").encode("utf-8", "surrogatepass"), seed=0 if i is None else 1 + i % (1 << 63)) for i, x in zip(ids, texts, strict=True)]
    return np.array(out, dtype=np.uint64)


def _dealt_bigrams(source: DataFrame, marks: np.ndarray | None, known: Known, slots: int) -> DataFrame:
    """The bigrams of known contexts that are not known themselves, dealt by bigram: a row for each chunk and slot.

    ``word`` and ``run`` are the places of the known words and how many bigrams
    end in each, ``pair`` six bytes of each bigram, ``place`` its document's
    among ``docs``.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, t in _chunks(batches, marks):
            pair = _pair(t.before, t.word)
            here = np.flatnonzero(~_found(known.pairs, pair)[1] & ((t.before == START) | _found(known.words, t.before)[1]))
            if not len(here):
                continue
            pair, doc = pair[here], t.doc[here]
            at, there = _found(known.words, t.word[here])
            word = np.where(there, at, len(known.words)).astype(np.uint32)
            slot = (pair >> np.uint64(48)).astype(np.int64) * slots >> 16
            order = np.lexsort((word, slot))
            slot, word, pair, doc = (x[order] for x in (slot, word, pair, doc))
            numbers, bounds, _ = dealt(slot, [])
            runs = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (slot[1:] != slot[:-1])))
            run_bounds = np.searchsorted(runs, bounds)
            # The documents of each slot, and each bigram's place among them.
            present, place = np.unique(slot * len(t.n) + doc, return_inverse=True)
            doc_bounds = np.searchsorted(present, np.append(numbers * len(t.n), np.iinfo(np.int64).max))
            place = (place - np.repeat(doc_bounds[:-1], np.diff(bounds))).astype(np.uint16)
            present %= len(t.n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers.astype(np.int32)),
                    column(word[runs], run_bounds),
                    column(np.diff(np.append(runs, len(word))).astype(np.uint32), run_bounds),
                    column(pair.view(np.uint8).reshape(-1, 8)[:, :6], bounds),
                    column(place, bounds),
                    column(_doc_keys(ids, texts)[present], doc_bounds),
                    column(t.target[present].astype(np.uint8), doc_bounds),
                ],
                ["slot", "word", "run", "pair", "place", "docs", "target"],
            )

    return source.mapInArrow(lean(deal), "slot int, word binary, run binary, pair binary, place binary, docs binary, target binary")


def _answers(table: pa.Table, shorter: tuple[np.ndarray, np.ndarray], scale: float) -> tuple[np.ndarray, ...]:
    """(document key, target, background): what the bigrams that a document shares with others take off its losses, for one slot."""
    parts = {c: table.column(c).chunks for c in table.column_names}
    word = np.repeat(entries(parts["word"], "<u4"), entries(parts["run"], "<u4"))
    raw = entries(parts["pair"], "u1").reshape(-1, 6)
    pair = np.zeros((len(raw), 8), dtype=np.uint8)
    pair[:, :6] = raw
    keys, target = entries(parts["docs"], "<u8"), entries(parts["target"], "u1").astype(bool)
    held = [len(x) // 8 for c in parts["docs"] for x in c.to_pylist()]
    bigrams = [len(x) // 2 for c in parts["place"] for x in c.to_pylist()]
    doc = entries(parts["place"], "<u2").astype(np.int64) + np.repeat(np.cumsum(held) - held, bigrams)
    # Six bytes and the last word tell the bigrams of a slot apart.
    pairs, pair = np.unique(mix(pair.view("<u8").reshape(-1) + (word.astype(np.uint64) << np.uint64(48))), return_inverse=True)
    own = _repeats(pair, doc, len(keys))
    background = np.bincount(pair, minlength=len(pairs))[pair] - own
    seen = np.flatnonzero(background)
    if not len(seen):
        return keys[:0], np.zeros(0), np.zeros(0)
    marked = target[doc]
    in_target = np.bincount(pair[marked], minlength=len(pairs))[pair[seen]] - own[seen] * marked[seen]
    word, doc = word[seen], doc[seen]
    off = [np.log1p(c / (PRIOR * q[word])) for c, q in zip((in_target, scale * background[seen]), shorter, strict=True)]
    some, doc = np.unique(doc, return_inverse=True)
    return keys[some], *(np.bincount(doc, x) for x in off)


def _own_losses(t: Tokens, known: Known, shorter: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """(target, background) sums of each document's losses, bigrams that are not known counted as in no other document."""
    size = len(t.n)
    marked = t.target[t.doc]
    at, there = _found(known.words, t.word)
    word = np.where(there, at, len(known.words))
    at, context = _found(known.words, t.before)
    start = t.before == START
    contexts = np.where(context, known.word_counts[:, at], 0) if len(known.words) else np.zeros((2, len(t.word)), dtype=np.int64)
    contexts = np.where(start, np.stack([np.full(len(start), known.texts[0] - 1), known.texts[1] - marked]), contexts)
    at, hit = _found(known.pairs, _pair(t.before, t.word))
    pairs = np.zeros((2, len(t.word)))
    if hit.any():
        own = _repeats(at[hit], t.doc[hit], size)
        pairs[:, hit] = known.pair_counts[:, at[hit]] - np.stack([own, own * marked[hit]])
    out = []
    for k, (s, q) in enumerate(((1.0, shorter[0]), (known.scale, shorter[1]))):
        row = 1 - k
        smooth = np.log(s * pairs[row] + PRIOR * q[word]) - np.log(s * contexts[row] + PRIOR)
        out.append(-np.bincount(t.doc, np.where(context | start, smooth, np.log(q[word])), size))
    return out


def score_documents(spark: SparkSession, docs: DataFrame, targets: DataFrame, *, share: float = KNOWN, slot_tokens: int = SLOT_TOKENS, targets_sent: int = TARGETS_SENT) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score), a row for each row of ``docs``.

    A text's tokens are its words and its end. A document's own bigrams are left
    out of the counts that score it, and it is left out of the texts that the
    first token follows; words and other contexts count with all documents.
    ``targets`` holds the doc_ids of the target corpus; ids unknown to ``docs``,
    nulls and repeats among them change nothing; without any, the target model
    has no counts. Texts without words have no tokens and null losses. A null
    doc_id is background and stays null. Repeated rows are counted and scored
    each. An empty table gives no rows. Other columns are not read.
    """
    tmp = Scratch(spark, "lm")
    source, marks = _marked(docs, targets, tmp, targets_sent)
    words, pairs, total = _candidates(source, marks, tmp, share)
    known = _known(source, marks, words, pairs, share)
    shorter, scale = known.shorter(), known.scale
    slots = min(1 << 16, max(1, -(-total // slot_tokens)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_slot(batches):
            keys, target, background = _answers(table, shorter, scale)
            numbers, bounds, arrays = dealt((keys % np.uint64(slots)).astype(np.int64), [keys, target.astype("<f4"), background.astype("<f4")])
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), *(column(x, bounds) for x in arrays)], ["slot", "key", "target", "background"])

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_slot(batches):
            keys, target, background = (entries(table.column(c).chunks, d) for c, d in (("key", "<u8"), ("target", "<f4"), ("background", "<f4")))
            some, at = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), *(pa.array(np.bincount(at, x)) for x in (target, background))], ["key", "target", "background"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, t in _chunks(batches, marks):
            target, background = _own_losses(t, known, shorter)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_doc_keys(ids, texts).view(np.int64)), pa.array(t.n), pa.array(target), pa.array(background)], ["doc_id", "key", "n_tokens", "own_target", "own_background"])

    # Slots are numbered by the corpus's size, so each is a partition's work.
    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(slots, "slot").sortWithinPartitions("slot")

    answers = grouped(_dealt_bigrams(source, marks, known, slots)).mapInArrow(lean(answer), "slot int, key binary, target binary, background binary")
    sums = grouped(answers).mapInArrow(lean(total_up), "key bigint, target double, background double")
    own = tmp.keep(source.mapInArrow(lean(describe), "doc_id bigint, key bigint, n_tokens bigint, own_target double, own_background double"), "own")
    # Equal rows share a key, and each has its part of the answers.
    copies = own.groupBy("key").agg(F.count("*").alias("rows"))
    both = own.join(sums.join(copies, "key"), "key", "left")
    loss = "case when n_tokens > 0 then (own_{0} - coalesce({0} / rows, 0e0)) / n_tokens end"
    out = both.selectExpr("doc_id", "n_tokens", f"{loss.format('target')} as target_loss", f"{loss.format('background')} as background_loss").withColumn("score", F.col("target_loss") - F.col("background_loss"))
    return out
