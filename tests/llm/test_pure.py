"""Byte- and array-level parts against brute force, without Spark."""

from __future__ import annotations

import os
import random
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from keyloom.llm import decontaminate as dc
from keyloom.llm import language_id as li
from keyloom.llm import line_templates as lt
from keyloom.llm import mpeg_audio as mp
from keyloom.llm import packing as pk
from keyloom.llm import simhash as sh
from keyloom.llm import toxicity as tx
from keyloom.llm import warc

# ---- WARC -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 8191, 8192, 8193, 50_000])
def test_chunked_round_trip(n):
    p = os.urandom(n)
    assert warc.dechunked(warc.chunked(p)) == p


def test_chunked_damage():
    c = warc.chunked(b"hello world")
    assert warc.dechunked(c[:-5]) is None and warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"") is None
    assert warc.dechunked(b"5;x=1\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"


def pieces(payload, segment_bytes=100):
    out = []
    for r in warc.page_records("<urn:page:1:0.1>", 1, "http://a/\r\nb", payload, None, __import__("hashlib").sha256(payload).hexdigest(), segment_bytes, "2024-01-01T00:00:00Z"):
        for head, block, whole in warc.parse(r):
            number, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
            out.append((head.get("warc-segment-origin-id", head["warc-record-id"]), number and int(number), total and int(total), 1, head.get("warc-target-uri"), head["warc-type"], None, head.get("warc-payload-digest"), whole, block))
    return out


def test_segments_and_damage():
    p = os.urandom(1000)
    ps = pieces(p)
    assert len(ps) > 5 and {x[0] for x in ps} == {"<urn:page:1:0.1>"}
    row = warc.joined(ps)
    assert row[4] == 1000 and row[7] == "ok" and row[6] == len(ps) and "\r" not in row[1]
    assert warc.joined(ps[:2] + ps[3:])[7] == "missing_segment"
    assert warc.joined(ps[:-1])[7] == "missing_segment"
    assert warc.joined(ps[1:])[7] == "missing_segment"
    short = [*ps[:-1], (*ps[-1][:2], ps[-1][2] + 1, *ps[-1][3:])]
    assert warc.joined(short)[7] == "length_mismatch"
    wrong = [(*ps[0][:7], "sha256:00", *ps[0][8:]), *ps[1:]]
    assert warc.joined(wrong)[7] == "digest_mismatch"
    assert list(warc.parse(b"garbage")) == [] and list(warc.parse(b"")) == []


def test_reading_goes_on_after_damage():
    good = lambda k: warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<id:{k}>")], b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1 in a text\r\nWARC/1.1\r\nend")
    bad_length = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\nbody\r\n\r\n"
    no_end = b"WARC/1.1\r\nWARC-Type: response\r\n"
    too_long = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\nbody\r\n\r\n"
    too_short = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nbody\r\n\r\n"
    for bad in (b"junk\r\n", bad_length, no_end, too_long, too_short, b"WARC/1.1\n"):
        out = list(warc.parse(good(1) + bad + good(2) + bad))
        whole = [h["warc-record-id"] for h, b, ok in out if ok]
        assert whole == ["<id:1>", "<id:2>"], bad
        assert bad == b"junk\r\n" or sum(not ok for _, _, ok in out) == 2, bad
    row = warc.piece({"warc-refers-to": "<urn:uuid:1>", "warc-segment-number": "x", "x-page-id": "ab", "warc-segment-total-length": "-1"}, "continuation", b"", True)
    assert row[1:4] == (0, None, None) and warc.joined([row])[7] == "missing_segment"


# ---- SimHash --------------------------------------------------------------------------------------------------------


def slow_fingerprint(t, n=3):
    w = t.encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", " \t\n", "one", "Two Words", "a b c d e f g a b c", "É é x y z", "tie tie", "x " * 500])
def test_fingerprint(text):
    assert sh.fingerprint(text.encode())[0] == slow_fingerprint(text)
    assert sh.fingerprint(None) == [0]
    assert len(set(sh.fingerprint(b"a b c d e f", count=4))) == 4


def test_links_match_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(rng.integers(64))) for b in base[:200]]
    dense = [base[0] ^ np.uint64(sum(1 << int(x) for x in rng.integers(0, 64, 3))) for _ in range(700)]
    points = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array(dense, np.uint64)]))
    monkeypatch.setattr(sh, "LEAF", 64)
    forest = sh.link_points(points, 2)
    slow = sh.Forest(len(points))
    sh.link_leaf(points, np.arange(len(points)), 2, slow)
    assert [forest.find(i) for i in range(len(points))] == [slow.find(i) for i in range(len(points))]
    tree = sh.VantageTree(points[:300], 64, 2)
    held = dict(tree.shards(points))
    assert len(held) > 2
    shards = [set(map(int, rows)) for rows in held.values()]
    pairs = [(i, j) for i in range(0, len(points), 7) for j in range(len(points)) if i != j and int(points[i] ^ points[j]).bit_count() <= 2]
    assert pairs and all(any(i in s and j in s for s in shards) for i, j in pairs)


# ---- decontamination ------------------------------------------------------------------------------------------------


def test_automaton_matches_brute_force():
    rng = random.Random(5)
    for trial in range(150):
        v = [w.encode() for w in "abcd"[: rng.randint(1, 4)]]
        items = [(str(i), [rng.choice(v) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 5))]
        n = rng.randint(1, 5)
        sam = dc.SuffixAutomaton(items, n)
        doc = [rng.choice([*v, b"z"]) for _ in range(rng.randint(0, 40))]
        hit, found = set(), set()
        for name, ws in items:
            k = min(n, len(ws))
            for a in range(len(ws) - k + 1) if ws else ():
                for i in range(len(doc) - k + 1):
                    if doc[i : i + k] == ws[a : a + k]:
                        hit |= set(range(i, i + k))
                        found.add(name)
        ids = np.array([sam.number.get(w, -1) for w in doc], np.int64)
        ranges, names = sam.hits(ids)
        assert {p for a, b in ranges for p in range(a, b)} == hit and names == found, trial
        assert all(b < c for (_, b), (c, _) in pairwise(ranges))


def test_words_and_spans():
    assert dc.words_of("Ab-c É9 _x".encode()) == [b"ab", b"c", "É9".encode(), b"x"]
    assert dc.words_of(None) == []
    assert dc.without_spans("One, two three. Four", [1, 3]) == "One, . Four"


# ---- packing --------------------------------------------------------------------------------------------------------


def test_bins_and_pieces():
    rng = random.Random(1)
    bins, made, fill = pk.OpenBins(64, 4), iter(range(10**6)), {}
    total = 0
    for _ in range(2000):
        n = rng.randint(1, 64)
        name, at, closed = bins.place(n, made.__next__)
        assert fill.get(name, 0) == at and at + n <= 64
        fill[name] = at + n
        total += n
        assert bins.count <= 4
        assert all(fill[b] == f for b, f in closed)
    assert sum(fill.values()) == total and {b: f for b, f in bins.rest()}.items() <= fill.items()
    assert [(p[0], p[1], p[2]) for p in pk.pieces_of(np.arange(130, dtype=np.uint32), 64)] == [(0, 0, 64), (1, 64, 64), (2, 128, 2)]
    assert len(list(pk.pieces_of(np.arange(64, dtype=np.uint32), 64))) == 1


def test_tokenizer_is_exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    mine, theirs = pk.WordTokenizer(path, keep=200), Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "aB cÉß\x85\xa0　\x1c\x1fİΣσ'sǅñ½²①中は한́<|>endoftxT09_-.\n\t\x0b​😀ﬁ"
    texts = [None, "", "  ", "Don't we'll x1y2", "<|endoftext|> a<|endoftext|>b"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    ids, bounds = mine.encode_batch(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == theirs.encode(t or "", add_special_tokens=False).ids, t
    sliced = pa.array(texts, pa.string()).slice(3, 2)
    ids, bounds = mine.encode_batch(sliced)
    assert ids[bounds[1] : bounds[2]].tolist() == theirs.encode(texts[4], add_special_tokens=False).ids


# ---- language -------------------------------------------------------------------------------------------------------


def test_labels_match_viterbi():
    rng = np.random.default_rng(2)
    for _ in range(300):
        s = -rng.exponential(3, (rng.integers(1, 40), rng.integers(2, 5))).astype(np.float32)
        p = float(rng.choice([2.0, 10.0, 40.0]))
        value = lambda path: sum(s[i, k] for i, k in enumerate(path)) - p * sum(a != b for a, b in pairwise(path))  # noqa: B023, E731
        assert value(li.labels(s, p)) == pytest.approx(value(li.viterbi(s, p)), abs=1e-3)
        if s.shape[0] <= 6:
            import itertools

            assert value(li.viterbi(s, p)) == pytest.approx(max(map(value, itertools.product(range(s.shape[1]), repeat=len(s)))), abs=1e-3)


def test_language_spans_and_scripts():
    m = li.fit({"aa": ["the cat sat on the mat with the hat " * 30], "bb": ["der hund und die katze und das haus " * 30], "el": ["και το σπίτι " * 30]})
    out = li._judge_all(m, pa.array(["the cat and hat " * 5 + "und der hund das haus " * 20, None, "123 !!", "", "σπίτι", "the"]), 5.0)
    assert [o[0] for o in out] == ["bb", "und", "und", "und", "el", "aa"]
    assert [s[0] for s in out[0][2]] == ["aa", "bb"] and out[0][2][-1][2] == 120 and 0.5 < out[0][1] < 1
    assert li.script_of("я") == "cyrillic" and li.script_of("a") == "latin" and li.script_of("中") == "han"
    assert li._judge_all(None, pa.array(["x"]), 5.0)[0][0] == "und"


# ---- audio ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1416, 1417, 1418, 60_000])
def test_audio_round_trip(n):
    p = mp.padded(os.urandom(n))
    s = mp.decode(mp.encode(p))
    assert s.payload == p and s.crc_errors == s.skipped == 0 and s.frames == s.table.frames == len(s.offsets) and s.table_ok
    assert len(p) % 192 == 0 and len(p) >= 192 and s.samples == 1152 * s.frames


def test_audio_damage():
    p = mp.padded(b"x" * 20_000)
    m = mp.encode(p)
    whole = mp.decode(m)
    at = whole.offsets[5]
    s = mp.decode(m[:at] + b"\xff\xfbjunk" * 9 + m[at:])
    assert s.payload == p and s.skipped == 54 and s.frames == whole.frames
    s = mp.decode(m[: at + 4] + b"\0\0" + m[at + 6 :])
    assert s.crc_errors == 1
    s = mp.decode(m[:at])
    assert s.payload is None and s.frames == 5
    assert mp.decode(m + b"TAG" + bytes(125)).payload == p
    assert mp.decode(b"").frames == 0 and mp.decode(b"not audio at all").payload is None


def vbri_stream(frames=40):
    sizes = [4, 9, 13]
    body = [mp.PREFIXES[sizes[k % 3]].ljust(mp.SIZES[sizes[k % 3]], b"x") for k in range(frames)]
    per = 4
    steps = [sum(map(len, body[k : k + per])) for k in range(0, frames, per)]
    total = mp.SIZES[13] + sum(map(len, body))
    first = mp.header(13, False).ljust(36, b"\0") + b"VBRI" + b"\0\1\0\0\0\x4b" + total.to_bytes(4, "big") + frames.to_bytes(4, "big") + len(steps).to_bytes(2, "big") + b"\0\1\0\2" + per.to_bytes(2, "big") + b"".join(x.to_bytes(2, "big") for x in steps)
    return first.ljust(mp.SIZES[13], b"\0") + b"".join(body), body


def test_variable_bitrate_tables_and_tags():
    s = mp.decode(mp.encode(os.urandom(100_000)))
    assert (s.table.kind, s.table.frames, s.table_ok, len(s.table.points)) == ("Xing", s.frames, True, 100)
    data, body = vbri_stream()
    s = mp.decode(data)
    assert (s.table.kind, s.table.frames, s.table.size, s.table.quality, s.frames, s.table_ok) == ("VBRI", 40, len(data), 75, 40, True)
    assert s.offsets == [mp.SIZES[13] + sum(map(len, body[:k])) for k in range(40)] and s.samples == 40 * 1152
    assert s.table.points == s.offsets[::4]
    assert mp.decode(data[: -len(body[-1])]).table_ok is False
    ms = 40 * 1152 * 1000 / mp.HZ
    assert mp.seek_offset(ms / 2, ms, s.offsets) == s.offsets[20] == mp.seek_offset(ms / 2, ms, None, s.table) and mp.seek_offset(ms, ms, s.offsets) is None
    text = lambda name, b: name + len(b).to_bytes(4, "big") + b"\0\0" + b
    frames = text(b"TIT2", b"\x03song") + text(b"TPE1", b"\1" + "näme".encode("utf-16"))
    tag = b"ID3\4\0\x10" + mp.synchsafe(len(frames)) + frames + b"3DI\4\0\x10" + mp.synchsafe(len(frames))
    s = mp.decode(tag + data + b"TAG" + b"old song".ljust(30, b"\0") + b"x".ljust(30, b"\0") + b"album".ljust(65, b"\0"))
    assert s.tags == {"TIT2": "song", "TPE1": "näme", "TALB": "album"} and s.frames == 40 and s.skipped == 0


# ---- templates, toxicity --------------------------------------------------------------------------------------------


def test_template_tree():
    t = lt.LeafTemplates(0.8)
    assert t.put((0, 1), "user <*> logged in from home") == 0
    assert t.put((0, 2), "user <*> logged in from work") == 0
    assert t.templates[0][-1] == lt.WILD and t.members == [[(0, 1), (0, 2)]]
    assert t.put((0, 3), "something else entirely here now ok") == 1


def test_many_templates_as_few(monkeypatch):
    """The array of templates decides as the comparison one by one does."""
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(10)) for _ in range(600)]
    found = []
    for few in (0, 10**6):
        monkeypatch.setattr(lt, "FEW", few)
        t = lt.LeafTemplates(0.7)
        found.append(([t.put((k, k), x) for k, x in enumerate(lines)], t.templates))
    assert found[0] == found[1]


def test_masks():
    lines = ["a1 b  c", "\t\r", "\u00a0", "x 9:30\u2003y\r", "", "no change here", " 7 "]
    assert lt.masked(pa.array(lines)).to_pylist() == ["<*> b c", "", "", "x <*> y", "", "no change here", "<*>"]
    raw, bounds = lt.lines_of(pa.array(["a\nb", None, "", "c\n"]))
    assert raw.to_pylist() == ["a", "b", "", "c", ""] and bounds.tolist() == [0, 2, 2, 3, 5]


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = tx.start({"a": 1}, rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = rng.standard_normal((6, tx.WORD_DIM + tx.GRAM_DIM))
    index = rng.integers(0, 6, (3, 5))
    mask = np.ones((3, 5), bool)
    mask[1, 3:] = False
    y = np.array([1.0, 0.0, 1.0])
    net.project = lambda v: tuple(v @ net.weights[f"{d}_w"] + net.weights[f"{d}_b"] for d in ("fw", "bw"))
    g, dx, _ = tx.gradients(net, x, index, mask, y)
    for name in ("fw_w", "bw_u", "fw_b", "att_w", "att_v", "out_w"):
        w = net.weights[name]
        at = tuple(int(rng.integers(n)) for n in w.shape)
        old, eps = w[at], 1e-3
        w[at] = old + eps
        up = tx.gradients(net, x, index, mask, y)[2]
        w[at] = old - eps
        down = tx.gradients(net, x, index, mask, y)[2]
        w[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4), name


def test_training_separates():
    rng = random.Random(0)
    words = ["".join(rng.choice("aeiou") + rng.choice("bdgklm") for _ in range(3)) for _ in range(200)]
    texts, marks = [], []
    for k in range(700):
        ws = [rng.choice(words) for _ in range(60)]
        if k % 2:
            ws[rng.randrange(60)] = "zork" + rng.choice(words)[:2]
        texts.append(" ".join(ws))
        marks.append(k % 2)
    net = tx.train(texts[:600], marks[:600], window=32, stride=16)
    s = tx.scores_of(net, pa.array([*texts[600:], None, "", "12 34"]), 32, 16)
    assert ((s[:100] >= 0.5) == (np.array(marks[600:]) == 1)).mean() >= 0.85
    assert s[100:].tolist() == [0.0, 0.0, 0.0] and s.min() >= 0 and s.max() <= 1
    assert tx.train(["a"], [1], window=32, stride=16) is None and tx.train([], [], window=32, stride=16) is None
    assert tx.window_starts(100, 32, 16)[-1] == 68 and tx.window_starts(5, 32, 16) == [0] and tx.window_starts(0, 32, 16) == []
