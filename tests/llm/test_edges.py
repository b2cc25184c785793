"""Operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import components, decontaminate, language_id, line_templates, mpeg_audio, packing, pii, queries, simhash, toxicity, url_filter, warc

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [(1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, LONG), (5, "Alpha beta gamma delta epsilon"), (5, "Alpha beta gamma delta epsilon"), (None, "alpha"), (6, "  \n\t "), (7, "12 34 !!")]
EXTRA = "n_words long, toxicity_score string, host string, n_dropped string"


@pytest.fixture(scope="module")
def docs(spark):
    """Edge rows with extra columns whose names operators use themselves."""
    rows = [(i, t, 7, "x", "y", "z") for i, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_simhash(docs, none):
    out = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    by = {i: (fp, c) for i, fp, c in out}
    assert by[2][0] == by[3][0] == by[6][0] == 0 and by[2][1] == by[3][1] == 2
    assert by[1] == by[5] and by[5][1] == 1 and len(simhash.near_duplicates(docs).collect()) == len(ROWS)
    assert simhash.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert 1 in kept and 5 not in kept and None in kept and kept.count(2) == 1 and 3 not in kept
    assert simhash.one_of_each(none).count() == 0 and simhash.similar_texts(none).count() == 0
    clashing = docs.withColumn("__gone", F.lit(1)).withColumn("fp", F.lit("own"))
    assert simhash.one_of_each(clashing).columns == clashing.columns


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 200)] + [(500, 500), (600, 601), (601, 600), (700, 600)] + [(1000, b) for b in range(1001, 1400)]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = lambda xs: len({out[x] for x in xs})
    assert group(range(201)) == 1 and group([600, 601, 700]) == 1 and group(range(1000, 1400)) == 1 and 500 not in out
    assert len(set(out.values())) == 3
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, none):
    path = queries.tokenizer_path()
    out = packing.pack(docs, path, capacity=64, places=4).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = sorted((i is None, i or 0, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in ROWS)
    got = {}
    for r in out:
        got.setdefault((r["doc_id"] is None, r["doc_id"] or 0), 0)
        got[(r["doc_id"] is None, r["doc_id"] or 0)] += r["length"]
    merged = {}
    for a, b, n in want:
        merged[(a, b)] = merged.get((a, b), 0) + n
    assert got == merged
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(n for _, _, n in want) // 64) + 2
    assert packing.pack(none, path).count() == 0
    one = docs.filter("doc_id IN (1, 4)")
    placed = packing.pack(one, path)
    seqs = {r["sequence_id"]: r["input_ids"] for r in packing.sequences(one, placed, path).collect()}
    r = placed.filter("doc_id = 1").first()
    ids = [*t.encode(ROWS[0][1], add_special_tokens=False).ids, 0]
    assert seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids
    assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_decontaminate(docs, none, spark):
    items = [(1, "alpha BETA gamma"), (2, None), (3, ""), (None, "epsilon"), (1, "ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.digest(decontaminate.contamination(docs, bench))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert (rows[1]["n_words"], rows[1]["n_hit"], rows[1]["n_items"]) == (5, 4, 1) and rows[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert rows[2]["n_words"] == rows[3]["n_hit"] == 0 and rows[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not rows[2]["contaminated"]
    assert rows[4]["n_hit"] > 99_000 and out.count() == len(ROWS)
    many = decontaminate.digest(decontaminate.contamination(docs, bench, max_words=20))
    assert sorted(map(str, many.collect())) == sorted(map(str, out.collect()))
    kept = {r["doc_id"]: r for r in decontaminate.clean(docs, bench).collect()}
    assert set(kept) == {2, 3, None, 6, 7} and kept[7]["host"] == "y" and kept[7]["n_words"] == 7
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontaminate_replaces_columns_of_its_names(docs, spark):
    """Input columns that look like an earlier pass, or like the operator's own working columns, change nothing."""
    bench = spark.createDataFrame([(1, "alpha BETA gamma"), (2, "epsilon")], "item_id long, text string")
    own = {"n_words": F.lit(-1).cast("long"), "n_hit": F.lit(-2).cast("long"), "hit_ranges": F.array(F.lit(0), F.lit(5)), "hit_items": F.array(F.lit("x")), "__body": F.lit("b"), "__own_n_hit": F.lit(3)}
    clashing = docs.withColumns(own)
    for words in (20, 2):
        want = decontaminate.digest(decontaminate.contamination(docs, bench, max_words=words))
        got = decontaminate.contamination(clashing, bench, max_words=words)
        assert sorted(map(str, decontaminate.digest(got).collect())) == sorted(map(str, want.collect()))
        assert {(r["__body"], r["__own_n_hit"]) for r in got.collect()} == {("b", 3)}
    cleaned = decontaminate.clean(clashing, bench)
    assert cleaned.columns == clashing.columns
    assert {tuple(r[c] for c in own) for r in map(lambda r: {**r.asDict(), "hit_ranges": tuple(r["hit_ranges"]), "hit_items": tuple(r["hit_items"])}, cleaned.collect())} == {(-1, -2, (0, 5), ("x",), "b", 3)}


def test_line_templates(spark, none):
    long = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    texts = [f"only {i}\nPage {i} of 90 today\n\nall the rights are reserved here now\n{long}\nunique line of text {'abcdefgh'[i]}" for i in range(5)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(8, None), (9, ""), (None, texts[0])]
    out = {r["doc_id"]: r for r in line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.9).collect()}
    assert out[0]["text"] == texts[0] and out[0]["n_dropped"] == 0 and out[None]["text"] == texts[0]
    for i in range(1, 5):
        assert out[i]["text"] == f"\nunique line of text {'abcdefgh'[i]}" and out[i]["n_dropped"] == 4 and out[i]["n_lines"] == 6
    assert out[8]["text"] is None and out[8]["n_lines"] == 0 and out[9]["text"] == ""
    assert line_templates.dedup(none).count() == 0


def test_pii(docs, none, spark):
    text = "pay 4111 1111 1111 1111 or 4111111111111112, call +1 (366) 555-9807, from 10.0.255.1 not 300.1.1.1, born 1984-02-29, 02/30/1999, ssn 123-45-6789 or 666-12-1234, mail ab.c1@mail.example.com."
    d = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "no data"), (6, LONG + " 10.0.255.1")], "doc_id long, text string")
    out = pii.pseudonymise(d, "key")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == rows[2]["text"] != text and rows[1]["n_pseudonyms"] == 6 and rows[3]["text"] is None and rows[5]["n_pseudonyms"] == 0
    for secret in ("4111 1111 1111 1111", "555-9807", "10.0.255.1", "1984-02-29", "123-45-6789", "ab.c1@"):
        assert secret not in rows[1]["text"]
    for kept in ("4111111111111112", "300.1.1.1", "02/30/1999", "666-12-1234", "@mail.example.com."):
        assert kept in rows[1]["text"]
    ip = rows[1]["text"].split("from ")[1].split(" not")[0]
    assert rows[6]["text"].endswith(ip)
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "key", inverse=True).collect()}
    assert back[1] == text
    assert pii.pseudonymise(d, "other key").first()["text"] != rows[1]["text"]
    cards = spark.createDataFrame([(1, "code 123 4111111111111111 or qty 12 4111 1111 1111 1111, 3782 822463 10005, 1234567890123"), (2, "4111-1111-1111-1111")], "id long, text string")
    shown = {r["id"]: r["text"] for r in pii.pseudonymise(cards, "key").collect()}
    new = shown[2].replace("-", "")
    assert shown[1].startswith(f"code 123 {new} or qty 12 {new[:4]} {new[4:8]} {new[8:12]} {new[12:]}, ") and "822463" not in shown[1] and shown[1].endswith(" 1234567890123")
    assert {r["text"] for r in pii.pseudonymise(pii.pseudonymise(cards, "key"), "key", inverse=True).collect()} == {r["text"] for r in cards.collect()}
    many = spark.createDataFrame([(1, "x@" + ".".join(["ab"] * 20_000) + " 10.0.255.1")], "id long, text string")
    assert pii.pseudonymise(many, "key").first()["n_pseudonyms"] == 2
    clash = d.withColumn("__old", F.lit(1)).withColumn("__new", F.lit(2))
    assert pii.pseudonymise(clash, "key").columns == [*clash.columns, "n_pseudonyms"]
    assert pii.pseudonymise(none, "key").count() == 0 and pii.pseudonymise(docs, "key").count() == len(ROWS)


def test_feistel_is_a_permutation(spark):
    d = spark.range(35).select(pii.feistel(F.col("id") % 5, F.floor(F.col("id") / 5), F.lit(5), F.lit(7), "k", "t").alias("p"))
    assert sorted((r["p"]["l"], r["p"]["r"]) for r in d.collect()) == [(a, b) for a in range(5) for b in range(7)]


def test_urls(docs, spark, none):
    rules = [url_filter.parse_rule(*r) for r in queries.URL_RULES]
    urls = [None, "", "no scheme", "http://", "http://COM/en/x", "https://a.Example.com/en/7?x#y", "https://notexample.com/en/71", "http://x.net/de/8", "http://example.net/de/8#f", "x://org?/es/", "http://a..org/es/", "http://org.evil/es/", "http://com/en"]
    out = [tuple(r) for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).orderBy("url").collect()]
    by = {r[0]: r[1:] for r in out}
    assert by[None] == ("", "", None, "allow") == by["no scheme"] and by["http://COM/en/x"] == ("com", "/en/x", "com/en/", "block")
    assert by["https://a.Example.com/en/7?x#y"][2:] == ("example.com/en/7", "allow") and by["https://notexample.com/en/71"][2:] == ("com/en/", "block")
    assert by["http://x.net/de/8"][2:] == ("net/de/", "block") and by["http://example.net/de/8#f"][3] == "allow" and by["x://org?/es/"] == ("org", "", None, "allow")
    assert by["http://a..org/es/"][2] == "org/es/" and by["http://org.evil/es/"][2] is None and by["http://com/en"][2] is None
    assert url_filter.judge(none.withColumn("url", F.lit("http://com/en/")), rules).count() == 0
    assert url_filter.judge(docs.withColumn("url", F.lit("http://com/en/")), rules).filter("host = 'com' AND verdict = 'block'").count() == len(ROWS)
    assert url_filter.judge(docs.withColumn("url", F.lit("http://com/en/")), []).filter("verdict = 'allow'").count() == len(ROWS)


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("key LIKE '%7'")
    c = url_filter.build_cascade(listed, universe, 300)  # a wrong size estimate: more false positives, more levels
    got = {r["key"] for r in universe.filter(c.contains(F.col("key"))).collect()}
    assert got == {r["key"] for r in listed.collect()} and len(c.levels) > 1


def test_audio(docs, none):
    out = mpeg_audio.round_trip(docs).collect()
    for r, (i, t) in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"])), sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        p = mpeg_audio.padded((t or "").encode())
        assert r["doc_id"] == i and r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:]) and r["payload_bytes"] == len(p) and r["crc_errors"] == 0
    assert mpeg_audio.round_trip(none).count() == 0


def test_warc(spark):
    body = "x" * 40_000
    pages = [(1, "http://a", "short"), (2, "http://b", "short"), (3, None, None), (5, "http://c", body), (4, "http://d\r\n", body), (9, "http://e", body), (9, "http://e", body), (10, "u", "")]
    out = [r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()]
    assert len(out) == len(pages) and {r["status"] for r in out} == {"ok"}
    by = {r["id"]: r for r in out}
    assert by[4]["type"] == "response" and by[4]["segments"] > 1 and by[5]["refers_to"] == by[9]["refers_to"] == 4 and by[1]["type"] == by[2]["type"] == "response"
    for i, _, html in pages:
        assert by[i]["payload_digest"] == hashlib.sha256((html or "").encode()).hexdigest() and by[i]["payload_bytes"] == len(html or "")
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    odd = [(None, "u", body, 1, 2), (None, None, None, 1, 2), (1, "u", body, 1, 2), (-4, "u", "y" * 200, 1, 2), (7, "u", "y" * 200, 1, 2), (7, "u", "y" * 200, 1, 2)]
    out = warc.round_trip(spark.createDataFrame(odd, "page_id long, url string, html string, __first long, digest long").repartition(2)).collect()
    assert sorted((str(r["id"]), r["type"], str(r["refers_to"]), r["status"]) for r in out) == sorted([("None", "response", "None", "ok")] * 2 + [("1", "response", "None", "ok"), ("-4", "response", "None", "ok")] + [("7", "revisit", "-4", "ok")] * 2)


def test_damaged_archives(spark):
    """Damage and foreign records through Spark: nothing after them is lost, and revisits without their response are told."""
    ok = lambda k: warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{k}>"), ("WARC-Payload-Digest", "sha1:AB")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    revisit = lambda of: warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:9>"), ("WARC-Refers-To", of)], b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\n")
    data = ok(1) + b"WARC/1.1\r\nContent-Length: 3\r\n" + revisit("<urn:uuid:1>") + revisit("<urn:uuid:404>") + warc.record([("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", "<urn:uuid:7>"), ("WARC-Segment-Number", "two")], b"x") + ok(2)
    out = warc.read_archives(spark.createDataFrame([("a", bytearray(data)), ("b", None)], "archive string, data binary")).collect()
    assert sorted((r["type"], r["status"], r["payload_bytes"]) for r in out if r["type"] == "response") == [("response", "ok", 4)] * 2
    assert sorted((r["type"], r["status"]) for r in out if r["type"] != "response") == [("continuation", "missing_segment"), ("damaged", "bad_header"), ("revisit", "dangling"), ("revisit", "ok")]


def test_language(docs, none, spark):
    learn = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in language_id.identify(learn, F.lit(True)).collect()}
    assert rows[0]["lang_pred"] == "en" and rows[1]["lang_pred"] == "de" and rows[99]["lang_pred"] == "und"
    blind = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(blind, F.lit(True)).collect()} == {"und"}
    assert language_id.identify(learn.limit(0), F.lit(True)).count() == 0


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, F.lit(True))
    out = toxicity.score(docs, net).collect()
    assert len(out) == len(ROWS) and all(0 <= r["toxicity_score"] <= 1 for r in out) and {r["toxicity_score"] for r in out if r["doc_id"] in (2, 3, 6, 7)} == {0.0}
    assert toxicity.fit(docs, labels.filter("toxic = 1"), F.lit(True)) is None and {r["toxicity_score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(none, net).count() == 0


def test_long_lines_go_through_the_tree(spark):
    """Passages of over 40 words that differ in a word without a digit share a template; others of the same length don't."""
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    passage = lambda k: " ".join([*words[:30], "xyzuvw"[k], *words[30:]])
    other = " ".join([*words[:3], *words[:2:-1], "end"])
    texts = [f"{passage(k)}\nown {'xyzuvw'[k]}" for k in range(4)] + [f"{other}\nlast"]
    out = {r["doc_id"]: r for r in line_templates.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert out[0]["text"] == texts[0] and out[4]["text"] == texts[4]
    assert [out[i]["text"] for i in (1, 2, 3)] == ["own y", "own z", "own u"] and all(out[i]["n_dropped"] == 1 for i in (1, 2, 3))


def slow_line_dedup(rows, min_docs=3, similarity=0.8, long_tokens=40, long_docs=2):
    """Plain version: masked lines, one tree in the order of keys, templates counted by document."""
    docs, leaves = {}, {}
    for i, t in rows:
        if i is not None and t is not None:
            docs.setdefault(i, []).extend(m for m in line_templates.masked(pa.array(t.split("\n"))).to_pylist() if m)
    for m in sorted({m for ms in docs.values() for m in ms}, key=line_templates.key_of):
        ts, words = leaves.setdefault(line_templates.leaf_of(m), []), m.split(" ")
        scored = [(sum(a in (b, "<*>") for a, b in zip(t, words, strict=True)), -k) for k, (t, _) in enumerate(ts)]
        if scored and max(scored)[0] >= similarity * len(words) - 1e-9:
            t, members = ts[-max(scored)[1]]
            members.append(m)
            t[:] = [a if a == b else "<*>" for a, b in zip(t, words, strict=True)]
        else:
            ts.append((list(words), [m]))
    gone = {}
    for ts in leaves.values():
        for _, members in ts:
            held = sorted(i for i, ms in docs.items() if set(ms) & set(members))
            if len(held) >= (long_docs if len(members[0].split(" ")) > long_tokens else min_docs):
                gone |= dict.fromkeys(members, held[0])
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        kept = [x for x in t.split("\n") if gone.get(line_templates.masked(pa.array([x]))[0].as_py(), i) == i]
        out.append((i, "\n".join(kept) if len(kept) < len(t.split("\n")) else t))
    return out


def test_line_templates_match_brute_force(spark):
    import random

    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    def line():
        n = rng.choice([3, 5, 6, 45])
        return " ".join(rng.choice(words[: rng.choice([1, 2, 10])]) if rng.random() > 0.1 else str(rng.randrange(99)) for _ in range(n))
    pool = [line() for _ in range(60)]
    rows = [(rng.randrange(40), "\n".join([*(rng.choice(pool) for _ in range(rng.randrange(6))), *(["", "\t\r", "\u00a0", " "][rng.randrange(4)] for _ in range(2)), line()])) for _ in range(60)]
    rows += [(None, rows[0][1]), (3, None), (41, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = [(r["doc_id"], r["text"]) for r in line_templates.dedup(frame).collect()]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(out, key=key) == sorted(slow_line_dedup(rows), key=key) and sorted(out, key=key) != sorted(rows, key=key)


def test_blank_lines_stay(spark):
    texts = [f"own {'abcd'[k]}\r\n\r\n\t\n\u00a0\nsame line of all\r" for k in range(4)]
    out = {r["doc_id"]: r for r in line_templates.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0]["text"] == texts[0] and [out[k]["text"] for k in (1, 2, 3)] == [f"own {'abcd'[k]}\r\n\r\n\t\n\u00a0" for k in (1, 2, 3)]


def test_crowded_leaves(spark):
    """Lines of one shape find each other although their leaf is dealt to many sub-leaves; very long texts and clashing names pass."""
    names = [f"{a}{b}{c}" for a in "abcde" for b in "fghij" for c in "klmno"]
    rows = [(k, f"user went home from {n} today with bag\nown words {n}", "x", "y") for k, n in enumerate(names)] + [(900, LONG + "\n" + LONG, "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __lost string, __lost_id string").repartition(4)
    out = {r["doc_id"]: r for r in line_templates.dedup(frame, crowd=20).collect()}
    assert out[0]["text"] == rows[0][1] and all(out[k]["text"] == f"own words {n}" and out[k]["__lost"] == "x" for k, n in enumerate(names) if k) and out[900]["text"] == rows[-1][1]


def test_a_passage_recurs_from_two_documents_on(spark):
    passage = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr")
    texts = [f"{passage}\nshort line of both\nfirst", f"{passage} end\nshort line of both\nsecond", f"{passage}\nthird"]
    out = {r["doc_id"]: r["text"] for r in line_templates.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: texts[0], 1: texts[1], 2: "third"}


def test_packing_merges_what_merging_tasks_leave_open(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_ROWS", 4)
    rows = [(i, "alpha " * (5 + 7 * i % 23)) for i in range(60)]
    placed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(20), queries.tokenizer_path(), capacity=64, places=4).collect()
    bins = {}
    for r in placed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in placed if r["piece"] == 0) == list(range(60))
    for parts in bins.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    fills = sorted(sum(n for _, n in parts) for parts in bins.values())
    assert fills[0] + fills[1] > 64 and len(bins) <= -(-sum(fills) // 64) + 4


def test_crowded_leaves_match_brute_force(spark):
    """A leaf of very many shapes, each in a few documents, is joined as in one pass over its lines, however few may be compared at once."""
    import random

    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefghijkl" for b in "mnopqr"]
    shapes = [[rng.choice(words) for _ in range(rng.choice([1, 2, 7, 7, 9]))] for _ in range(150)]
    rows = []
    for k in range(120):
        lines = [["the", "same", "start", *rng.choice(shapes)] for _ in range(5)]
        for line in lines:
            for _ in range(rng.choice([0, 1, 1, 2])):
                line[rng.randrange(3, len(line))] = rng.choice([*words, "7"])
        rows.append((k, "\n".join(map(" ".join, lines))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = sorted(slow_line_dedup(rows))
    assert plain != sorted(rows)
    for crowd in (20, 10**6):
        assert sorted((r["doc_id"], r["text"]) for r in line_templates.dedup(frame, crowd=crowd).collect()) == plain


def test_many_numbers_by_hash(monkeypatch):
    monkeypatch.setattr(line_templates, "RECENT", 3)
    posts, plain = line_templates.Postings(), {}
    for n in range(50):
        posts.add(hash((n * n % 7,)), n)
        plain.setdefault(n * n % 7, []).append(n)
    assert len(posts.runs) < 6
    for keys in ([1], [0, 2, 4], [3], []):
        assert sorted(posts.of([hash((k,)) for k in keys]).tolist()) == sorted(n for k in keys for n in plain.get(k, []))
