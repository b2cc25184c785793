"""Language spans and document language: script ranges, word scores and Viterbi with a switching penalty.

A word is a run of letters. The script of its first letter narrows the languages to those that were seen in that
script; each of these scores the word by the mean log-probability of its letter n-grams, times a number of letters that
is bounded, so that no single word decides. Viterbi finds the labels of best total score, a change of language costing
`penalty`. Most texts need no search: if no run of words gains more than the penalty over the leading language (the
largest sum of any run, over the best other language at each word), staying in it is provably the best path.

The model is fitted on a bounded sample: about `sample_docs` documents of each language (all of a rarer one), picked by
hash of the id. Prediction reads all words of all texts.

Defined results. Null text and text without letters: ``und``, score 0. Ties between languages: alphabetical order.
Without any labelled text every document is ``und``. Null languages teach nothing. Repeated rows get equal results.
Words of a script that no language has are scored for all. Extra columns are dropped. The score is the share of the
letters whose label is the predicted language.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import small_batches
from keyloom.llm.packing import slices

BUCKETS = 1 << 17
BEYOND = "[^\\p{L}\\p{M}]+"
OTHER_SCRIPT = -60.0

# First code points of Unicode ranges, and the script of each range up to the next
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00, 0x0D80, 0x0E00, 0x0E80, 0x0F00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x13A0, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFE00, 0xFE70, 0xFF00, 0xFF66, 0xFFA0, 0x10000, 0x20000)
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "bengali", "gurmukhi", "gujarati", "oriya", "tamil", "telugu", "kannada", "malayalam", "sinhala", "thai", "lao", "tibetan", "myanmar", "georgian", "hangul", "ethiopic", "other", "khmer", "mongolian", "latin", "greek", "latin", "han", "hiragana", "katakana", "bopomofo", "hangul", "other", "han", "other", "hangul", "other", "han", "latin", "hebrew", "arabic", "other", "arabic", "latin", "katakana", "hangul", "other", "han")
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))
_SCRIPT_OF = np.array([SCRIPTS.index(x) for x in SCRIPT_NAMES])


def script_of(letter: str) -> str:
    return SCRIPT_NAMES[bisect_right(SCRIPT_STARTS, ord(letter)) - 1]


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-cased words of each text (empty strings may stand at the ends); null has none."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), BEYOND)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (2 to 4 letters, the word's bounds included) of all words one after the other, and the word of each."""
    joined = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le"), np.uint32).astype(np.uint64)
    bound = joined == 1
    word = np.cumsum(bound)[:-1] - 1
    code, found, owner = joined.copy(), [], []
    inner = np.cumsum(bound)
    for n in (2, 3, 4):
        code = code[:-1] * np.uint64(0x9E3779B1) + joined[n - 1 :]
        k = len(code)
        whole = inner[n - 2 : n - 2 + k] - inner[:k] == 0  # no bound between the first and the last letter
        found.append(((code[whole] * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(47)).astype(np.int64))
        owner.append(word[:k][whole])
    return np.concatenate(found), np.concatenate(owner)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log-probability of a hashed n-gram under each language
    scripts: np.ndarray  # whether a language is seen in a script

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its score under each language, relative to the best."""
        n = len(words)
        if not n:
            return np.zeros((0, len(self.languages)), np.float32)
        hashed, owner = grams(words)
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        letters = np.minimum(np.fromiter(map(len, words), np.int64, n), 12)
        out = np.stack([np.bincount(owner, weights=self.table[hashed, k], minlength=n) for k in range(len(self.languages))], axis=1)
        out *= (letters / count)[:, None]
        first = np.fromiter((ord(w[0]) for w in words), np.int64, n)
        allowed = self.scripts[_SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, first, "right") - 1]]
        out = np.where(allowed | ~allowed.any(axis=1, keepdims=True), out, OTHER_SCRIPT * letters[:, None] / 4)
        return (out - out.max(axis=1, keepdims=True)).astype(np.float32)


def fit(samples: dict[str, list[str]], smoothing: float = 0.2, script_share: float = 0.01) -> Model:
    """A model from texts by language."""
    languages = sorted(samples)
    table = np.zeros((BUCKETS, len(languages)), np.float64)
    scripts = np.zeros((len(SCRIPTS), len(languages)), bool)
    for k, lang in enumerate(languages):
        words = [w for ws in words_of(pa.array(samples[lang], pa.string())).to_pylist() for w in ws if w]
        if not words:
            continue
        hashed, _ = grams(words)
        table[:, k] = np.bincount(hashed, minlength=BUCKETS)
        first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        share = np.bincount(_SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, first, "right") - 1], minlength=len(SCRIPTS)) / len(words)
        scripts[:, k] = share >= script_share
    table += smoothing
    table = np.log(table / table.sum(axis=0))
    return Model(languages, table.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of best total score, a change costing penalty; among equal paths the earlier languages, later changes."""
    best = scores[0].tolist()
    n = range(len(best))
    back: list[list[int]] = []
    for row in scores[1:].tolist():
        top = max(best)
        at = best.index(top)
        stay = top - penalty
        came = [k if best[k] >= stay else at for k in n]
        best = [(best[k] if best[k] >= stay else stay) + row[k] for k in n]
        back.append(came)
    label = best.index(max(best))
    out = [label]
    for came in reversed(back):
        label = came[label]
        out.append(label)
    return np.array(out[::-1])


def labels(scores: np.ndarray, penalty: float) -> np.ndarray:
    """As viterbi; constant where one language provably holds throughout."""
    lead = int(scores.sum(axis=0, dtype=np.float64).argmax())
    if scores.shape[1] == 1:
        return np.zeros(len(scores), np.int64)
    gain = np.cumsum(np.delete(scores, lead, axis=1).max(axis=1).astype(np.float64) - scores[:, lead])
    lowest = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
    if (gain - lowest).max() < penalty:
        return np.full(len(scores), lead)
    return viterbi(scores, penalty)


def judge(model: Model, scores: np.ndarray, letters: np.ndarray, penalty: float) -> tuple[str, float, list[tuple[str, int, int]]]:
    """Language, share of its letters, and spans (language, first word, word after the last)."""
    got = labels(scores, penalty)
    weight = np.bincount(got, weights=letters, minlength=len(model.languages))
    top = int(weight.argmax())
    cuts = np.flatnonzero(np.diff(got)) + 1
    bounds = [0, *cuts.tolist(), len(got)]
    spans = [(model.languages[got[a]], a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return model.languages[top], float(weight[top] / max(1.0, weight.sum())), spans


def sample_of(docs: DataFrame, text: str, lang: str, doc_id: str, learn: Column, sample_docs: int) -> dict[str, list[str]]:
    """About sample_docs texts of each language, picked by hash; a count by language reads no text."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    picked = rows.filter(F.pmod(F.xxhash64(doc_id, F.lit("language")), F.lit(1 << 20)) < F.element_at(share, F.col(lang)) * (1 << 20))
    out: dict[str, list[str]] = {}
    for r in picked.select(F.col(lang).alias("lang"), F.col(text).alias("text")).collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 400, penalty: float = 30.0) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; `learn` marks the rows whose language may be learnt from."""
    small_batches(docs)
    samples = sample_of(docs, text, lang, doc_id, learn, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(samples) if samples else None)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for some in slices(batch, 1):
                found = _judge_all(model, some.column(1), penalty)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array([[dict(zip(("lang", "first", "end"), s, strict=True)) for s in f[2]] for f in found], span)], names=["doc_id", "lang_pred", "score", "spans"])

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,first:int,end:int>>")


def _judge_all(model: Model | None, texts: pa.Array, penalty: float) -> list[tuple[str, float, list]]:
    lists = words_of(texts)
    coded = pc.dictionary_encode(lists.flatten())
    names = coded.dictionary.to_pylist()
    letter = np.array([any(c.isalpha() for c in w) for w in names], bool)  # a lone mark is no word
    index = coded.indices.to_numpy()
    keep = letter[index] if len(index) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    index = index[keep]
    if model is not None and len(index):
        own = np.cumsum(letter) - 1
        words = [w for w, x in zip(names, letter, strict=True) if x]
        table = model.scores(words)
        index = own[index]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if a == b or model is None:
            out.append(("und", 0.0, []))
        else:
            out.append(judge(model, table[index[a:b]], sizes[index[a:b]], penalty))
    return out
