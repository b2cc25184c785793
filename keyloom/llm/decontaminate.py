"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

Words are runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. A window is `window` consecutive
words of an item; an item of fewer words, but not none, is one window. The automaton of all items is walked over a
document's words, tracking the longest suffix that some item contains; where that length reaches a window, the words
under it are hit and the state names the items. A document's words are first checked for a run of word pairs that some
item has: stretches without one cannot hold a window and are skipped (an exact necessary condition).

The automaton holds at most `max_words` item words; a larger benchmark is dealt by hash into several automata, and the
documents pass one after another, so the broadcast size is bounded whatever the benchmark.

Defined results. Null and empty texts have no words and no hits. Null item ids count as hits but name no item; equal
item ids are one item. Repeated documents are judged one by one. An empty benchmark hits nothing. Extra columns pass
through; the added ones replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.llm._shared import small_batches, spare_name, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ADDED = "n_words long, n_hit long, hit_ranges array<int>, hit_items array<string>"
PAIR_BITS = 22


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; every state keeps the items whose window it contains."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.number.setdefault(w, len(self.number)) for w in ws]) for name, ws in items if ws]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        self.shortest = min((min(window, len(ids)) for _, ids in coded), default=window)
        for name, ids in coded:
            self._name_windows(name, ids)
        self.pairs = np.zeros(1 << (PAIR_BITS - 3), np.uint8)
        for _, ids in coded:
            if len(ids) > 1:
                at = self.pair_hash(np.array(ids[:-1]), np.array(ids[1:]))
                np.bitwise_or.at(self.pairs, at >> 3, (1 << (at & 7)).astype(np.uint8))

    @staticmethod
    def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the longest string of p followed by c, apart from the longer ones that share q."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        here = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = here
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[here] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return here

    def _shorten(self, state: int, length: int) -> int:
        """The suffix of the state's strings that has that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _name_windows(self, name: str | None, ids: list[int]) -> None:
        state = 0
        for k, c in enumerate(ids):
            state = self.next[state][c]
            if k + 1 >= self.window and name is not None:
                self.items.setdefault(self._shorten(state, self.window), set()).add(name)
        if len(ids) < self.window:
            self.short.setdefault(state, []).append((len(ids), name))

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that may hold a window: runs of word pairs that items have."""
        need = self.shortest - 1
        if len(ids) <= need:
            return
        if need == 0:
            yield 0, len(ids)
            return
        at = self.pair_hash(ids[:-1], ids[1:])
        known = ((self.pairs[at >> 3] >> (at & 7)) & 1).astype(bool) & (ids[:-1] >= 0) & (ids[1:] >= 0)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        for a, b in edges.reshape(-1, 2):
            if b - a >= need:
                yield int(a), int(b) + 1

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit words, and the items that have a window there."""
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        for a, b in self.stretches(ids):
            state = matched = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                moves = self.next
                while state and c not in moves[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if c not in moves[state]:
                    continue
                state = moves[state][c]
                matched += 1
                if matched >= self.window:
                    ranges.append((i + 1 - self.window, i + 1))
                    found |= self.items.get(self._shorten(state, self.window), set())
                if self.short:
                    up = state
                    while up > 0:
                        for n, name in self.short.get(up, ()):
                            if n <= matched:
                                ranges.append((i + 1 - n, i + 1))
                                if name is not None:
                                    found.add(name)
                        up = self.link[up]
        return merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mark(docs: DataFrame, automaton: object, text: str) -> DataFrame:
    """docs with ADDED columns, which add to those of an earlier pass."""
    small_batches(docs)
    names = [x.split()[0] for x in ADDED.split(", ")]
    plain = [c for c in docs.columns if c not in names]
    later = all(c in docs.columns for c in names)
    read = docs.select(*plain, F.col(text).cast("binary").alias(spare_name(docs, "body")), *(names[2:] if later else []))
    schema = StructType([*docs.select(*plain).schema.fields, *StructType.fromDDL(ADDED).fields])
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam: SuffixAutomaton = automaton.value
        number = sam.number.get
        for batch in batches:
            rows = []
            old = zip(batch.column(len(plain) + 1).to_pylist(), batch.column(len(plain) + 2).to_pylist(), strict=True) if later else None
            for one in batch.column(len(plain)):
                ws = words_of(one.as_py())
                ids = np.fromiter((number(w, -1) for w in ws), np.int64, len(ws))
                ranges, found = sam.hits(ids)
                if old is not None:
                    flat, before = next(old)
                    ranges, found = merged(ranges + list(zip(flat[::2], flat[1::2], strict=True))), found | set(before)
                rows.append((len(ws), sum(b - a for a, b in ranges), [x for r in ranges for x in r], sorted(found)))
            if rows:
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(plain))), *new], names=[*plain, *names])

    return read.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 2_000_000) -> DataFrame:
    """docs with n_words, n_hit, hit_ranges (word positions, flattened start and end) and hit_items (sorted strings)."""
    spark = docs.sparkSession
    docs = docs.drop(*[x.split()[0] for x in ADDED.split(", ")])
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("binary").alias("body"))
    size = items.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n")).first()["n"]
    parts = size // (2 * max_words) + 1  # a word and its separator take two bytes at least
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == k).collect()
        sam = SuffixAutomaton([(r["item"], words_of(bytes(r["body"]) if r["body"] is not None else None)) for r in rows], window)
        docs = _mark(docs, spark.sparkContext.broadcast(sam), text)
        if k + 1 < parts:
            docs = written(docs, "contamination")
    return docs


def digest(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return marked.select(
        F.col(doc_id), "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_spans(text: str | None, ranges: list[int] | None) -> str | None:
    """The text without its hit words, from the first letter of a range to the last; the rest is untouched."""
    if not ranges:
        return text
    raw = text.encode()
    spans = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
        out.append(raw[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", max_coverage: float = 0.5, **options: object) -> DataFrame:
    """docs (their own columns) with every hit span cut out; documents hit in over max_coverage of their words go."""
    columns = docs.columns
    added = [x.split()[0] for x in ADDED.split(", ")]
    own_name = {c: spare_name(docs, f"own_{c}") for c in columns if c.lower() in added}
    own = docs.withColumnsRenamed(own_name)
    marked = contamination(own, benchmark, text=text, **options)
    kept = marked.filter(F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage))
    cut = F.udf(without_spans, "string", useArrow=True)
    body = F.when(F.col("n_hit") > 0, cut(F.col(text), F.col("hit_ranges"))).otherwise(F.col(text))
    return kept.withColumn(text, body).select(*[F.col(own_name.get(c, c)).alias(c) for c in columns])
