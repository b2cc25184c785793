"""Line deduplication by a log-template tree.

Tokens with a digit are variable fields. A line descends a tree of fixed depth: its token count, then its leading
tokens (variable ones as a wildcard). In the leaf it joins the template that agrees with it in most positions, if those
are at least `similarity` of them, differing positions becoming wildcards; otherwise it starts a template. A template
that occurs in `min_docs` or more documents recurs, and its lines are dropped everywhere but in the document of smallest
id that has it; a template of over `long_tokens` tokens is a passage, which does not meet another by chance, and recurs
from `long_docs` documents on. Lines of every length go through the tree.

Lines are first reduced to keys (128 bits of the masked line) with their documents; a task hands on a line's text with
the key's first row only. Texts are dealt to leaves by a hash of the leaf, sorted and streamed, so a task holds the
templates of one leaf and no lines; a leaf of one line, as most of long lines are, is not even split into tokens. In a
crowded leaf (of over `crowd` templates) a line is compared with the templates that an index of blocks of positions
gives, which are all that can take it: results do not depend on `crowd` or on the size of a leaf. Decisions return to
the documents as the keys each one loses.

White space is that of Unicode. Defined results. Null text stays null, empty text empty; blank lines (of white space
only) are never dropped. Ties between templates go to the older one; the order of lines in a leaf is that of their
keys. Rows of equal id are one document and get one decision; rows with a null id are left as they are and count as no
document. Very long texts are whole. Empty tables give empty results. Extra columns pass through, whatever their names;
`n_lines` and `n_dropped` replace columns of those names.
"""

from __future__ import annotations

import math
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from keyloom.llm._shared import small_batches, spare_name, written

WILD = "<*>"
LEADING = 3
SEEN_KEYS = 100_000  # keys that a task remembers as handed on with their text; it forgets them all beyond that
FEW = 16  # templates of a leaf that are compared one by one
CROWD = 1_000  # templates of a leaf that are all compared with a line
RECENT = 50_000  # numbers in a dictionary

OTHER_SPACE = r"\t\n\v\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
FIELD = f"[^ {OTHER_SPACE}]*[0-9][^ {OTHER_SPACE}]*"
SPACES = f"[{OTHER_SPACE}][ {OTHER_SPACE}]*| [ {OTHER_SPACE}]+"  # runs of white space other than a single space


# ---- lines and their keys -------------------------------------------------------------------------------------------


def masked(lines: pa.Array) -> pa.Array:
    """The lines with tokens that hold a digit as wildcards and single spaces; empty for blank lines."""
    fields = pc.replace_substring_regex(lines, FIELD, WILD)
    return pc.utf8_trim(pc.replace_substring_regex(fields, SPACES, " "), " ")


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts one after the other, and where each text's begin (one more at the end); null has none."""
    parts = pc.split_pattern(texts, "\n")
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(parts), np.concatenate([[0], np.cumsum(counts)])


def key_of(line: str) -> tuple[int, int]:
    """128 bits of a masked line, as two signed longs."""
    digest = xxhash.xxh3_128_digest(line)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def leaf_of(line: str) -> tuple:
    return (line.count(" ") + 1, *line.split(" ", LEADING)[:LEADING])


def leaf_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(repr(leaf_of(line))) - (1 << 63)


def keyed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, a, b, tokens, leaf, line): the distinct lines of each row; leaf and line are null where the task has handed them
    on already."""
    small_batches(docs)
    source = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            raw, bounds = lines_of(batch.column(1))
            masks, rows, take = masked(raw).to_pylist(), [], []
            for k, (start, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own: set[str] = set()
                for line in masks[start:end]:
                    if not line or line in own:
                        continue
                    own.add(line)
                    key = key_of(line)
                    take.append(k)
                    rows.append((*key, line.count(" ") + 1, *((None, None) if key in seen else (leaf_hash(line), line))))
                    seen.add(key)
                if len(seen) > SEEN_KEYS:
                    seen.clear()
            if rows:
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *new], names=["id", "a", "b", "tokens", "leaf", "line"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, a long, b long, tokens int, leaf long, line string")


# ---- templates of a leaf --------------------------------------------------------------------------------------------


class Postings:
    """Numbers by hash: the newest in a dictionary, all others in sorted arrays of growing length, 12 bytes each."""

    def __init__(self) -> None:
        self.new: dict[int, array] = {}
        self.size = 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: int, number: int) -> None:
        self.new.setdefault(key, array("i")).append(number)
        self.size += 1
        if self.size >= RECENT:
            keys = np.repeat(np.fromiter(self.new, np.int64), [len(v) for v in self.new.values()])
            numbers = np.concatenate([np.frombuffer(v, np.int32) for v in self.new.values()])
            while self.runs and len(self.runs[-1][0]) < 2 * len(keys):
                more = self.runs.pop()
                keys, numbers = np.concatenate([more[0], keys]), np.concatenate([more[1], numbers])
            order = keys.argsort(kind="stable")
            self.runs.append((keys[order], numbers[order]))
            self.new, self.size = {}, 0

    def of(self, keys: list[int]) -> np.ndarray:
        """All numbers of the keys, repeats included."""
        found = [np.frombuffer(v, np.int32) for v in map(self.new.get, keys) if v]
        if self.runs:
            asked = np.array(keys, np.int64)
            for held, numbers in self.runs:
                low, high = held.searchsorted(asked), held.searchsorted(asked, "right")
                found += [numbers[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b]
        return np.concatenate(found) if found else np.empty(0, np.int32)


class LeafTemplates:
    """The templates of one leaf. Many are compared as rows of one array, over `crowd` only those that share a block.

    A line that agrees with a template in all but d positions agrees with it in the whole of at least one of d + 1 blocks of
    positions. Templates are found by each block's tokens and the places of its wildcards, so none that takes the line is
    missed, and the way of comparing does not change what is found."""

    def __init__(self, similarity: float, crowd: int = CROWD) -> None:
        self.similarity, self.crowd = similarity, crowd
        self.templates: list[list[str]] = []
        self.members: list[list[tuple[int, int]]] = []
        self.codes: dict[str, int] = {WILD: 0}
        self.grid: np.ndarray | None = None
        self.blocks: list[list[int]] = []
        self.shapes: list[set[tuple[int, ...]]] = []  # by block: the sets of positions without wildcard that occur
        self.postings = Postings()

    def _coded(self, tokens: list[str]) -> list[int]:
        return [self.codes.setdefault(t, len(self.codes)) for t in tokens]

    def _post(self, k: int, blocks: set[int]) -> None:
        codes = self.grid[k].tolist()
        for j in blocks:
            fixed = tuple(i for i in self.blocks[j] if codes[i])
            self.shapes[j].add(fixed)
            self.postings.add(hash((j, fixed, *[codes[i] for i in fixed])), k)

    def _candidates(self, codes: list[int]) -> np.ndarray:
        """Numbers of all templates that can take the line, and of others. Each block has its share of the positions that vary."""
        if not self.blocks:
            n = len(codes)
            spare = n - math.ceil(self.similarity * n - 1e-9)
            varied = sorted(range(n), key=lambda i: len(np.unique(self.grid[: len(self.templates), i])))
            self.blocks = [varied[j :: spare + 1] for j in range(spare + 1)]
            self.shapes = [set() for _ in self.blocks]
            for k in range(len(self.templates)):
                self._post(k, set(range(spare + 1)))
        return self.postings.of([hash((j, fixed, *[codes[i] for i in fixed])) for j, shapes in enumerate(self.shapes) for fixed in shapes])

    def _best(self, tokens: list[str]) -> tuple[int, int]:
        """(positions that agree, number) of the most similar template, the older one of equals; (-1, -1) if none can take
        the line."""
        if len(self.templates) <= FEW:
            agree = [sum(a == b or a == WILD for a, b in zip(t, tokens, strict=True)) for t in self.templates]
            best = max(agree)
            return best, agree.index(best)
        if self.grid is None:
            self.grid = np.array([self._coded(t) for t in self.templates] * 2, np.int32)
        codes = [self.codes.get(t, -1) for t in tokens]
        if len(self.templates) <= self.crowd:
            numbers, used = None, self.grid[: len(self.templates)]
        else:
            numbers = self._candidates(codes)
            if not len(numbers):
                return -1, -1
            used = self.grid[numbers]
        agree = ((used == np.array(codes, np.int32)) | (used == 0)).sum(axis=1)
        best = int(agree.max())
        return best, int(agree.argmax() if numbers is None else numbers[agree == best].min())

    def place(self, line: str) -> int:
        """Number of the template that takes the line."""
        tokens = [sys.intern(t) for t in line.split(" ")]
        if self.templates:
            agree, k = self._best(tokens)
            if agree >= self.similarity * len(tokens) - 1e-9 and k >= 0:
                template, changed = self.templates[k], []
                for i, t in enumerate(tokens):
                    if template[i] != t and template[i] != WILD:
                        template[i] = WILD
                        changed.append(i)
                if changed and self.grid is not None:
                    self.grid[k, changed] = 0
                    if self.blocks:
                        self._post(k, {j for j, block in enumerate(self.blocks) if not set(block).isdisjoint(changed)})
                return k
        self.templates.append(tokens)
        k = len(self.templates) - 1
        if self.grid is not None:
            if k >= len(self.grid):
                self.grid = np.concatenate([self.grid, np.zeros_like(self.grid)])
            self.grid[k] = self._coded(tokens)
            if self.blocks:
                self._post(k, set(range(len(self.blocks))))
        return k

    def put(self, key: tuple[int, int], line: str) -> int:
        """As place, with the key kept in `members`."""
        k = self.place(line)
        if k == len(self.members):
            self.members.append([])
        self.members[k].append(key)
        return k


class Leaf:
    """The templates of a leaf and their first keys."""

    def __init__(self, similarity: float, crowd: int) -> None:
        self.tree, self.firsts = LeafTemplates(similarity, crowd), array("q")

    def put(self, key: tuple[int, int], line: str) -> tuple[int, int] | None:
        """The first key of the template that the line joins; none if it starts one."""
        k = 2 * self.tree.place(line)
        if k == len(self.firsts):
            self.firsts.extend(key)
            return None
        return self.firsts[k], self.firsts[k + 1]


JOINED = "a long, b long, ta long, tb long"


def grouped_lines(texts: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """texts (leaf, a, b, line) -> JOINED rows: each key that joins a template, with the template's first key. A key may come
    repeatedly; leaves whose hashes are equal are kept apart."""
    dealt = texts.repartition("leaf").sortWithinPartitions("leaf", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last, alone = None, None, None
        leaves: dict[tuple, Leaf] = {}
        rows: list[tuple] = []

        def put(key: tuple[int, int], line: str) -> None:
            leaf = leaf_of(line)
            if leaf not in leaves:
                leaves[leaf] = Leaf(similarity, crowd)
            first = leaves[leaf].put(key, line)
            if first is not None:
                rows.append((*key, *first))

        for batch in batches:
            lines = batch.column(3)
            for i, (leaf, *key) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if leaf != place:
                    place, last, leaves, alone = leaf, key, {}, (tuple(key), lines[i])
                elif key != last:
                    if alone is not None:
                        put(alone[0], alone[1].as_py())
                        alone = None
                    put(tuple(key), lines[i].as_py())
                    last = key
            if alone is not None:
                alone = (alone[0], pa.scalar(alone[1].as_py()))  # a copy, so that the batch can go
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "ta", "tb"])
                rows = []

    return dealt.select("leaf", "a", "b", "line").mapInArrow(run, JOINED)


def leaf_templates(texts: DataFrame, similarity: float, crowd: int = CROWD) -> DataFrame:
    """texts (leaf, a, b, line) -> (a, b, ta, tb): lines that share a template with another one, and its first key."""
    moved = written(grouped_lines(texts, similarity, crowd), "templates")
    return moved.unionByName(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b"), "ta", "tb").distinct())


# ---- the operator ---------------------------------------------------------------------------------------------------


def losses(docs: DataFrame, doc_id: str, text: str, min_docs: int, similarity: float, long_tokens: int, long_docs: int, crowd: int) -> DataFrame:
    """(id, lost): the keys of lines that a document loses, two longs each."""
    enough = F.col("n") >= F.when(F.col("long"), long_docs).otherwise(min_docs)
    keyed = written(keyed_lines(docs, doc_id, text), "lines")
    shared = written(leaf_templates(keyed.filter(F.col("line").isNotNull()).select("leaf", "a", "b", "line"), similarity, crowd), "templates")
    pairs = keyed.select("a", "b", "id", (F.col("tokens") > long_tokens).alias("long")).distinct()
    counted = (F.count("*").alias("n"), F.min("id").alias("first"), F.first("long").alias("long"))
    alone = pairs.groupBy("a", "b").agg(*counted).filter(enough).join(shared.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "first")
    grouped = pairs.join(shared, ["a", "b"]).groupBy("ta", "tb", "id").agg(F.first("long").alias("long"))
    recurring = grouped.groupBy("ta", "tb").agg(*counted).filter(enough)
    together = shared.join(recurring, ["ta", "tb"]).select("a", "b", "first")
    dropped = written(alone.unionByName(together), "dropped-lines")
    lost = pairs.join(dropped, ["a", "b"]).filter(F.col("id") != F.col("first"))
    return lost.groupBy("id").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("lost"))


def without_lines(docs: DataFrame, text: str, lost: str) -> DataFrame:
    """docs without column `lost`: the text without the lines of those keys, n_lines and n_dropped."""
    plain = [c for c in docs.columns if c != lost]
    at, schema = plain.index(text), StructType([*docs.select(*plain).schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType())

    def kept(body: str, keys: np.ndarray) -> tuple[str, int]:
        gone = set(zip(keys[::2].tolist(), keys[1::2].tolist(), strict=True))
        raw = body.split("\n")
        rest = [x for x, m in zip(raw, masked(pa.array(raw, pa.string())).to_pylist(), strict=True) if not m or key_of(m) not in gone]
        return "\n".join(rest), len(raw) - len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(at), batch.column(len(plain))
            dropped = np.zeros(batch.num_rows, np.int64)
            changed: dict[int, str] = {}
            for k in np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False) & texts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                changed[k], dropped[k] = kept(texts[k].as_py(), keys[k].values.to_numpy())
            if changed:
                fresh = texts.to_pylist()
                for k, body in changed.items():
                    if dropped[k]:
                        fresh[k] = body
                out = pa.array(fresh, texts.type)
            else:
                out = texts
            n_lines = pc.add(pc.fill_null(pc.count_substring(texts, "\n"), -1), 1).cast(pa.int64())
            columns = [out if k == at else batch.column(k) for k in range(len(plain))]
            yield pa.RecordBatch.from_arrays([*columns, n_lines, pa.array(dropped)], names=[*plain, "n_lines", "n_dropped"])

    return docs.select(*plain, lost).mapInArrow(run, schema)


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, similarity: float = 0.8, long_tokens: int = 40, long_docs: int = 2, crowd: int = CROWD) -> DataFrame:
    """docs with recurring lines dropped from the text, and n_lines (before) and n_dropped added."""
    docs = docs.drop("n_lines", "n_dropped")
    own_id, own_lost = spare_name(docs, "lost_id"), spare_name(docs, "lost")
    lost = losses(docs, doc_id, text, min_docs, similarity, long_tokens, long_docs, crowd).select(F.col("id").alias(own_id), F.col("lost").alias(own_lost))
    small_batches(docs)
    return without_lines(docs.join(lost, F.col(doc_id) == F.col(own_id), "left").drop(own_id), text, own_lost)
