"""Every opN query and every pipeline stage on the smallest tables, against SQL or plain Python versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from test_edges import slow_line_dedup
from test_pure import slow_fingerprint
from test_similar import groups

from keyloom.llm import pii, queries, simhash, toxicity
from keyloom.llm._shared import key_fold, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def run(spark, name):
    return queries.QUERIES[name](spark, DATA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    got, want = run(spark, name), duck.sql(queries.ORACLES[name])
    pick = sorted(want.columns)
    assert sorted(got.columns) == pick
    assert sorted(tuple(map(str, (r[c] for c in pick))) for r in got.collect()) == sorted(tuple(map(str, (r[want.columns.index(c)] for c in pick))) for r in want.fetchall())


def test_op2(spark, texts):
    fps = {i: slow_fingerprint(t or "") for i, t in texts.items()}
    ids = sorted(fps)
    roots = groups(len(ids), [(a, b) for a, b in combinations(range(len(ids)), 2) if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 2])
    want = {(i, f"{fps[i]:016x}", ids[roots[k]]) for k, i in enumerate(ids)}
    assert {tuple(r) for r in run(spark, "op2_simhash").collect()} == want


def test_op4(spark, texts):
    out = run(spark, "op4_pii")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == set(texts) and any(r["n_pseudonyms"] for r in rows.values())
    assert all((r["text"] != texts[i]) == (r["n_pseudonyms"] > 0) for i, r in rows.items())
    back = pii.pseudonymise(out, queries.PII_KEY, count="n_back", inverse=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == texts
    mail = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+")
    pairs = {(a.group(), b.group()) for i, t in texts.items() if t for a, b in zip(mail.finditer(t), mail.finditer(rows[i]["text"]), strict=True)}
    assert pairs and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)  # equal values stay linked, others apart


def plain_logit(weights, xs, shift):
    """One window's logit: both recurrences step by step, then attention over their states."""
    w = {k: v.astype(np.float64) for k, v in weights.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))

    def walk(side, steps):
        h, out = np.zeros(len(w[f"{side}_u"])), []
        for x in steps:
            pz, pr, pc = np.split(x @ w[f"{side}_w"] + w[f"{side}_b"], 3)
            uz, ur, uc = np.split(w[f"{side}_u"], 3, axis=1)
            z, r = sig(pz + h @ uz), sig(pr + h @ ur)
            h = (1 - z) * h + z * np.tanh(pc + (r * h) @ uc)
            out.append(h)
        return out

    states = [np.concatenate(pair) for pair in zip(walk("fw", xs), walk("bw", xs[::-1])[::-1], strict=True)]
    share = np.exp([np.tanh(s @ w["att_w"]) @ w["att_v"] for s in states])
    return sum(a * s for a, s in zip(share / share.sum(), states, strict=True)) @ w["out_w"] + w["out_b"][0] + shift


def plain_score(net, text, window=32, stride=16):
    """The highest window's probability, one window and one word at a time."""
    names, flat, _ = toxicity.coded(pa.array([text], pa.string()))
    words, best = [names[k] for k in flat.tolist()], None
    for start in toxicity.window_starts(len(words), window, stride):
        some = words[start : start + window]
        logit = plain_logit(net.weights, [net.inputs([t])[0].astype(np.float64) for t in some], net.shift)
        best = logit if best is None else max(best, logit)
    return 0.0 if best is None else 1 / (1 + np.exp(-best))


def test_op5(spark, texts):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    from pyspark.sql import functions as F

    net = toxicity.fit(docs, table(spark, DATA, "labels"), key_fold(F.col("__id"), 5) != 0)
    out = {r["doc_id"]: r for r in run(spark, "op5_toxicity").collect()}
    assert set(out) == set(texts)
    for i in list(texts)[:40]:
        assert out[i]["score"] == pytest.approx(plain_score(net, texts[i]), abs=1e-4)
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1


def test_op6(spark, texts):
    assert sorted((r["doc_id"], str(r["text"])) for r in run(spark, "op6_line_templates").collect()) == sorted((i, str(t)) for i, t in slow_line_dedup(list(texts.items())))


def plain_pieces(docs, capacity=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            yield i, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())


def check_packing(rows, docs):
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(plain_pieces(docs))
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.1 * -(-total // 2048) + 1


def test_op8(spark, texts):
    check_packing(run(spark, "op8_packing").collect(), texts.items())


def test_op9(spark, duck, texts):
    langs = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    out = {r["doc_id"]: r for r in run(spark, "op9_language_id").collect()}
    assert set(out) == set(texts) and all(0 <= r["score"] <= 1 for r in out.values())
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[i] or ""))
    held = [i for i, r in out.items() if r["held_out"] and langs[i] and r["lang_pred"] != "und"]
    assert sum(out[i]["lang_pred"] == langs[i] for i in held) >= 0.9 * len(held)


def test_op10(spark, texts):
    for r in run(spark, "op10_mpeg_audio").collect():
        body = (texts[r["doc_id"]] or "").encode()
        payload = body.ljust(max(1, -(-len(body) // 192)) * 192, b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


# ---- the pipeline ---------------------------------------------------------------------------------------------------


def plain_near_dedup(rows):
    """All pairs of fingerprints that share a shard, compared one by one."""
    known = simhash.WordHashes()
    marks = [simhash.wide_sketch(t.encode() if t else None, 5, known) for _, t in rows]
    shards = [set(s.tolist()) for _, s in marks]
    reach = simhash.radius_of(0.8)
    pairs = [(a, b) for a, b in combinations(range(len(rows)), 2) if shards[a] & shards[b] and np.bitwise_count(marks[a][0] ^ marks[b][0]).sum() <= reach]
    return [r for k, r in zip(groups(len(rows), pairs), rows, strict=True) if rows[k][0] == r[0]]


def plain_decontaminate(rows, items):
    windows = set()
    for body in items:
        ws = WORD.findall((body or "").encode().lower())
        windows |= {tuple(ws[k : k + 10]) for k in range(max(1, len(ws) - 9))} if ws else set()
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        spans = [m.span() for m in WORD.finditer((t or "").encode().lower())]
        ws = WORD.findall((t or "").encode().lower())
        hit = np.zeros(len(ws), bool)
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit[k : k + n] = True
        if hit.sum() > 0.5 * len(ws):
            continue
        raw, edges = (t or "").encode(), np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
        for a, b in edges[::-1]:
            raw = raw[: spans[a][0]] + raw[spans[b - 1][1] :]
        out.append((i, raw.decode() if len(edges) else t))
    return out


def test_pipeline(spark, duck, texts):
    """Each stage on what the one before it kept, and run() as a whole."""
    docs, stages = table(spark, DATA, "documents"), dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: r[0])
    here = sorted(texts.items())
    predicted = {r["doc_id"]: r["predicted"] for r in run(spark, "op5_toxicity").collect()}
    for name, plain in (
        ("toxicity", lambda x: [r for r in x if not predicted[r[0]]]),
        ("line dedup", lambda x: [b for a, b in zip(x, slow_line_dedup(x), strict=True) if a == b or b[1].strip(" ")]),
        ("SimHash near-dedup", plain_near_dedup),
        ("benchmark decontamination", lambda x: plain_decontaminate(x, [t for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()])),
    ):
        out = stages[name](spark, docs, DATA)
        assert sorted(out.columns) == sorted(docs.columns)
        found, want = rows(out), plain(here)
        assert found == want, name
        assert 0 < len(found) <= len(here)
        docs, here = spark.createDataFrame(out.collect(), out.schema), found
    whole = corpus_pipeline.run(spark, DATA).collect()
    check_packing(whole, here)


def test_stages_on_edges(spark):
    """Nulls in any column, empty and white texts, repeated rows, a clashing name and no rows at all."""
    long = "one two three four five six seven eight nine ten eleven twelve " * 300
    rows = [(1, "a b c d e f", "en", "s", 11, "x"), (1, "a b c d e f", "en", "s", 11, "x"), (2, None, None, None, None, None), (3, "", "en", None, 0, "x"), (None, "a b c d e f", "en", "s", 11, "x"), (4, "\r\n\t", None, "s", 3, "x"), (5, long, "en", "s", len(long), "x")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, __gone string"
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            got = out.collect()
            assert (name == "best-fit packing") or out.columns == docs.columns
            assert len(got) >= len(docs.filter("doc_id IS NULL").collect())
