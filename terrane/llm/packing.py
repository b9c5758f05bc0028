"""Best-fit packing of tokenised documents into sequences, by swap-based local search.

A block of pieces starts from best-fit decreasing; then documents are moved and
exchanged one-for-one or two-for-one between underfull bins, out of the emptiest
bin first, whenever that increases the sum of squared fills, until bins empty
and no exchange helps. Blocks are dealt by hash, so a block has a bounded
number of pieces however the lengths, sources or copies are spread.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memory import lean
from ._store import Scratch
from ._text import taken

CAPACITY = 1024
END_ID = 2
#: Pieces shorter than a sequence that a block has on average.
BLOCK_PIECES = 16384
#: Distinct words that a worker remembers the ids of.
REMEMBERED = 300_000
#: Characters that the tokenizer file encodes at a time; a longer text is cut where the vocabulary's pattern always cuts.
PART = 1 << 18

#: A space between two letters: a word with its space begins there.
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_ODD = re.compile(r"\s\s|^\s|\s$|[^\S \n]|[^\x00-\u024f]")


def parts(text: str, size: int = PART) -> list[str]:
    """The text in pieces whose ids, one after the other, are the text's."""
    out, at = [], 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class TextTokenizer:
    """The ids of a tokenizer file as little-endian uint32 bytes.

    Where a single space or line feed stands between other characters the
    vocabulary's pattern always cuts, so words are encoded apart, by the same
    vocabulary's merge ranks, and remembered: three times as fast as the file's
    own encoder, with equal ids (tested). Texts with any other white space, with
    a special token's string, with a null character or with characters beyond
    the Latin blocks go through the tokenizer file, one thread to a worker.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        piece, any_text = encoding._core_bpe.encode_single_piece, encoding.encode_ordinary

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                letters = word[1:] if word[:1] == " " else word
                if letters.isalpha():
                    ids = array("I", piece(word.encode())).tobytes()
                elif letters[-1:] in (".", ",") and letters[:-1].isalpha():
                    ids = self[word[:-1]] + self[word[-1]]
                else:
                    ids = array("I", any_text(word)).tobytes()
                if len(self) < REMEMBERED and len(word) <= 48:
                    self[word] = ids
                return ids

        self.words = Words()

    def ids(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text in order."""
        for text in texts:
            if not text:
                yield b""
            elif "\0" in text or sys.byteorder != "little" or _ODD.search(text) or any(x in text for x in self.specials):
                yield b"".join(np.array(x.ids, dtype="<u4").tobytes() for part in parts(text) for x in self.whole.encode_batch_fast([part], add_special_tokens=False))
            else:
                yield b"".join(map(self.words.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


_LOADED: dict[tuple[str, str], TextTokenizer] = {}


def tokenizer(path: str, ranks_path: str, pattern: str) -> TextTokenizer:
    """One per worker process, kept between tasks."""
    if (path, ranks_path) not in _LOADED:
        _LOADED[path, ranks_path] = TextTokenizer(path, ranks_path, pattern)
    return _LOADED[path, ranks_path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first is shorter."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pack(lengths: Sequence[int], capacity: int = CAPACITY, *, search: bool = True) -> np.ndarray:
    """The bin of each length, numbered from 0; ties keep the earlier. Without ``search`` best-fit decreasing alone."""
    size = np.asarray(lengths, dtype=np.int64)
    n = len(size)
    if not n:
        return np.zeros(0, dtype=np.int64)
    if size.min() < 1 or size.max() > capacity:
        raise ValueError("lengths lie between 1 and the capacity")
    bin_of = np.zeros(n, dtype=np.int64)
    members: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_mask = 0
    for i in np.argsort(-size, kind="stable").tolist():
        s = int(size[i])
        fitting = free_mask >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free_mask ^= 1 << room
            members[b].append(i)
        else:
            b, room = len(members), capacity
            members.append([i])
        bin_of[i] = b
        if room > s:
            open_bins[room - s].append(b)
            free_mask |= 1 << (room - s)
    fill = np.bincount(bin_of, weights=size, minlength=len(members)).astype(np.int64)
    if search:
        _search(size, bin_of, members, fill, capacity)
    _, out = np.unique(bin_of, return_inverse=True)
    return out


def _search(size: np.ndarray, bin_of: np.ndarray, members: list[list[int]], fill: np.ndarray, capacity: int) -> None:
    """Exchanges out of ever fuller bins until none helps; each raises the sum of squared fills, so they end."""

    def place(i: int, b: int) -> None:
        members[bin_of[i]].remove(i)
        fill[bin_of[i]] -= size[i]
        members[b].append(i)
        fill[b] += size[i]
        bin_of[i] = b

    def chosen_of(b: int, copies: int) -> list[int]:
        """The members of a bin, of equal sizes ``copies`` at most: any other exchange is one of theirs."""
        seen: dict[int, int] = {}
        out = []
        for i in members[b]:
            s = int(size[i])
            if seen.setdefault(s, 0) < copies:
                seen[s] += 1
                out.append(i)
        return out

    changed = True
    while changed:
        changed = False
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        if len(under) < 2:
            return
        items = np.array([i for b in under.tolist() for i in chosen_of(b, 1)], dtype=np.int64)
        twos = [np.array(chosen_of(b, 2), dtype=np.int64) for b in under.tolist()]
        pairs = np.concatenate([own[np.stack(np.triu_indices(len(own), 1), axis=1)] for own in twos])
        for donor in under[np.argsort(fill[under], kind="stable")].tolist():
            for x in sorted(members[donor], key=lambda i: -size[i]):
                if bin_of[x] != donor:
                    continue
                free = capacity - fill
                # Move: into the fullest other bin with room.
                fits = under[(free[under] >= size[x]) & (under != donor) & (fill[under] > 0)]
                if len(fits):
                    best = fits[np.argmin(free[fits])]
                    if fill[best] + size[x] > fill[donor]:
                        place(x, int(best))
                        changed = True
                        continue
                # One for one, or one for two: what the other bin gains must fit and leave it the fuller.
                best_gain, chosen = 0, None
                for sets in (items[:, None], pairs):
                    if not len(sets):
                        continue
                    home = bin_of[sets[:, 0]]
                    gain = size[x] - size[sets].sum(axis=1)
                    good = (gain > best_gain) & (gain <= free[home]) & (home != donor) & (fill[home] + gain > fill[donor])
                    if sets.shape[1] == 2:
                        good &= bin_of[sets[:, 1]] == home
                    if good.any():
                        at = int(np.argmax(np.where(good, gain, 0)))
                        best_gain, chosen = int(gain[at]), sets[at].tolist()
                if chosen is not None:
                    to = int(bin_of[chosen[0]])
                    place(x, to)
                    for y in chosen:
                        place(y, donor)
                    changed = True
                    continue
                # Two for one: x with each other document of its bin.
                for z in chosen_of(donor, 2):
                    if z == x:
                        continue
                    home = bin_of[items]
                    gain = size[x] + size[z] - size[items]
                    good = (gain > 0) & (gain <= free[home]) & (home != donor) & (fill[home] + gain > fill[donor])
                    if good.any():
                        y = int(items[int(np.argmax(np.where(good, gain, 0)))])
                        to = int(bin_of[y])
                        place(x, to)
                        place(z, to)
                        place(y, donor)
                        changed = True
                        break


def _pieces(docs: DataFrame, path: str, ranks_path: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path, ranks_path, pattern)
        end = np.array([end_id], dtype="<u4").tobytes()
        n = 0
        for batch in taken(batches, 1):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                n += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.mapInArrow(lean(split), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint")


def pack_documents(spark: SparkSession, docs: DataFrame, *, tokenizer_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A null text is empty and has the end id alone. Only documents of more than
    ``capacity`` ids are cut; the first piece may be shorter. Full pieces are
    sequences of their own; all others are packed in blocks of about
    ``block_pieces`` dealt by hash, each block a bounded task. Repeated rows
    are packed once for each row. A null doc_id stays null. An empty table
    gives no rows. Other columns are not read. The vocabulary's files are
    parameters; by default those of the installed public tokenizers.
    """
    import public_tokenizers

    tmp = Scratch(spark, "packing")
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    pieces = tmp.keep(_pieces(source, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity, end_id), "pieces")
    short = pieces.where(F.col("length") < capacity)
    blocks = max(1, round(short.count() / block_pieces))
    dealt = short.withColumn("block", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32, row), {blocks})"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        length = table["length"].to_numpy()
        bins = pack(length, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.searchsorted(bins[order], np.arange(bins.max() + 1))
        offset = np.empty(len(bins), dtype=np.int64)
        offset[order] = before - before[first][bins[order]]
        block = table["block"][0].as_py()
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array((block << 32) + bins)).append_column("offset", pa.array(offset))

    packed = dealt.repartition(blocks, "block").groupBy("block").applyInArrow(fit, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    full = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(full)
