"""Token packing: bounded-space online best-fit with a fixed number of open bins in a bitset keyed by free space.

Each task tokenizes its documents, cuts only those longer than a sequence, and places the pieces in the order they
come: into the open bin whose free space fits most tightly, found as the lowest set bit of the bitset at or above the
piece's length. When no bin fits and all places for open bins are taken, the fullest bin closes, for good. Bins still
open when a task ends (`places` of them at most) are merged by the same rule: they are themselves packed as blocks. What
a merging task still holds open goes on to the next round of fewer tasks, until one task has packed the rest; only (bin,
fill) pairs move, never tokens.

Defined results. Null text counts as empty: its document is one piece of one token (the end id). Empty tables give
empty results. Repeated rows are packed as documents of their own. Ties between bins of equal free space go to the
last one opened. Very long texts are cut into whole sequences and a rest. Extra columns of the input are dropped; ids
may be null.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import small_batches, written

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"
MERGE_ROWS = 20_000  # open bins that one merging task takes


class OpenBins:
    """The open bins of one packer: a bitset of free spaces, and for each free space the bins that have it."""

    def __init__(self, capacity: int, places: int) -> None:
        self.capacity, self.places = capacity, places
        self.bits, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int, new: Callable[[], int]) -> tuple[int, int, list[tuple[int, int]]]:
        """(bin, offset in it, closed bins as (bin, fill)) for a block of that size (1 to capacity)."""
        closed: list[tuple[int, int]] = []
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            if self.count >= self.places:
                tightest = (self.bits & -self.bits).bit_length() - 1
                closed.append((self._take(tightest), self.capacity - tightest))
            free, name = self.capacity, new()
        left = free - size
        if left:
            self.by_free[left].append(name)
            self.bits |= 1 << left
            self.count += 1
        else:
            closed.append((name, self.capacity))
        return name, self.capacity - free, closed

    def _take(self, free: int) -> int:
        here = self.by_free[free]
        name = here.pop()
        if not here:
            self.bits &= ~(1 << free)
        self.count -= 1
        return name

    def rest(self) -> Iterator[tuple[int, int]]:
        for free in range(self.capacity, 0, -1):
            for name in self.by_free[free]:
                yield name, self.capacity - free


def _byte_letters() -> dict[int, int]:
    """Byte to the letter that stands for it in byte-level vocabularies: printable Latin-1 as itself, the rest from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of whole texts for tokenizers whose tokens never cross white space, by two bounded caches.

    A batch of texts is cut at ASCII white space and dictionary-encoded, so that each of its distinct chunks is looked
    up once. A new chunk of Latin letters is cut into words, whose ids are kept; any other chunk goes to the tokenizer
    itself, other white space included. The caches are emptied when they hold `keep` chunks.
    """

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    PLAIN = r"[\x21-\x7e\xa1-\u012f\u0131-\u0240]+"

    def __init__(self, path: str, keep: int = 400_000) -> None:
        import regex
        from tokenizers import Tokenizer

        self.inner, self.keep = Tokenizer.from_file(path), keep
        self.model, self.letters = self.inner.model, _byte_letters()
        self.pieces, self.plain = regex.compile(self.PIECES).findall, regex.compile(self.PLAIN).fullmatch
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def _word(self, w: str) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            spelt = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
            ids = self.words[w] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return ids

    def _ids(self, chunk: str) -> bytes:
        """Ids of a chunk, four bytes each."""
        if chunk.isascii():
            if chunk.isalpha():
                return self._word(chunk.lower())
            if chunk[-1] in ".,!" and chunk[:-1].isalpha():
                return self._word(chunk[:-1].lower()) + self._word(chunk[-1])
        if "<|" in chunk or not self.plain(chunk):
            return array("I", self.inner.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join([self._word(w) for w in self.pieces(chunk.lower())])

    def _learn(self, chunks: list[str]) -> None:
        found = [self._ids(c) for c in chunks]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        k, n, total = len(self.chunks), len(found), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(found), np.uint32)
        self.sizes[k : k + n] = sizes
        self.starts[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.chunks.update(zip(chunks, range(k, k + n), strict=True))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more at the end); null is empty."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.dictionary_encode(parts.values.slice(parts.offsets[0].as_py(), parts.offsets[-1].as_py() - parts.offsets[0].as_py()))
        counts = np.diff(parts.offsets.to_numpy())
        names = coded.dictionary.to_pylist()
        if len(self.chunks) > self.keep:
            self.clear()
        known = self.chunks
        if missing := [c for c in names if c and c not in known]:
            self._learn(missing)
        places = np.fromiter((known[c] if c else -1 for c in names), np.int64, len(names))
        at = places[coded.indices.to_numpy()]
        sizes = np.where(at < 0, 0, self.sizes[at])
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, bounds

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch(pa.array([text], pa.string()))[0]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of a batch whose texts together have about most_bytes (a longer text comes alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker process's tokenizer, with empty caches: a task's words don't burden what the worker does next."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    _TOKENIZERS[path].clear()
    return _TOKENIZERS[path]


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the little-endian ids) of one document."""
    raw = ids.astype("<u4", copy=False)
    for k, start in enumerate(range(0, len(raw), capacity)):
        part = raw[start : start + capacity]
        yield k, start, len(part), zlib.crc32(part)


def tokenize_and_place(docs: DataFrame, tokenizer: str, capacity: int, places: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """PIECE_SCHEMA rows: each task packs its own documents; a bin's name holds its task. Rows of piece -1 are the bins that
    a task holds open at its end, with their fill as length."""
    small_batches(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        made = iter(range(base, base + (1 << 40)))
        bins, words = OpenBins(capacity, places), tokenizer_of(tokenizer)
        last = np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            for some in slices(batch, 1):
                ids, bounds = words.encode_batch(some.column(1))
                for k, doc in enumerate(some.column(0).to_pylist()):
                    for piece, start, n, crc in pieces_of(np.concatenate([ids[bounds[k] : bounds[k + 1]], last]), capacity):
                        name, at, _ = bins.place(n, made.__next__)
                        rows.append((doc, piece, start, n, crc, name, at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        words.clear()
        if rows := [(None, -1, None, fill, None, name, None) for name, fill in bins.rest()]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


def merge_open(blocks: DataFrame, capacity: int, places: int, tasks: int, round_no: int) -> DataFrame:
    """blocks (bin, fill) packed into (bin, into, base, fill): bins of several tasks, tightest first by size. Rows without
    bin and base are the bins that a task holds open at its end, with their fill."""
    schema = pa.schema([("bin", pa.int64()), ("into", pa.int64()), ("base", pa.int64()), ("fill", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (round_no << 56) | (TaskContext.get().partitionId() << 40)
        made = iter(range(base, base + (1 << 40)))
        bins = OpenBins(capacity, places)
        for batch in batches:
            rows = []
            for name, fill in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                into, at, _ = bins.place(fill, made.__next__)
                rows.append((name, into, at, fill))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        if rest := [(None, name, None, fill) for name, fill in bins.rest()]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest, strict=True), schema.types, strict=True)], schema=schema)

    dealt = blocks.repartition(tasks, F.xxhash64("bin")).sortWithinPartitions(F.desc("fill"), "bin")
    return dealt.mapInArrow(run, "bin long, into long, base long, fill long")


def followed_by(moved: DataFrame, moves: DataFrame) -> DataFrame:
    """(bin, into, base) of moved, carried on by the moves of the next round."""
    later = moves.select(F.col("bin").alias("into"), F.col("into").alias("then"), F.col("base").alias("further"))
    return moved.join(later, "into", "left").select("bin", F.coalesce("then", "into").alias("into"), (F.col("base") + F.coalesce("further", F.lit(0))).alias("base"))


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, places: int = 512, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document lies."""
    rows = written(tokenize_and_place(docs, tokenizer, capacity, places, end_id, id_col, text_col), "pieces")
    placed = rows.filter("piece >= 0")
    open_bins = rows.filter("piece = -1").select("bin", F.col("length").alias("fill"))
    left = open_bins.count()
    if left == 0:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moved, tasks, round_no = None, -(-left // MERGE_ROWS), 1
    while True:
        merged = written(merge_open(open_bins, capacity, places, tasks, round_no), "merged-bins")
        moves = merged.filter(F.col("bin").isNotNull()).select("bin", "into", "base")
        moved = moves if moved is None else followed_by(moved, moves)
        if tasks == 1:
            break
        open_bins = merged.filter(F.col("bin").isNull()).select(F.col("into").alias("bin"), "fill")
        tasks, round_no = max(1, min(-(-open_bins.count() // MERGE_ROWS), tasks // 2)), round_no + 1
    out = placed.join(moved, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"))


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id, input_ids array<int>: the token sequences that `pack` laid out (documents with unique ids)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_of(tokenizer)
        for batch in batches:
            rows = []
            for text, start, length, seq, at in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                ids = np.concatenate([words.encode(text), np.array([end_id], np.uint32)])
                rows.append((seq, at, ids[start : start + length].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["sequence_id", "at", "ids"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = texts.join(placed, "doc_id").select("text", "start", "length", "sequence_id", "offset").mapInArrow(cut, "sequence_id long, at long, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("at", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("input_ids"))
