"""Cases of the second round's findings on the keyed operators."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from keyloom.functions.kernels import format_double
from keyloom.operators import entries, sketches
from keyloom.plans import views
from keyloom.streaming import stateful


def test_rows_in_order_from_spooled_runs():
    rng = random.Random(3)
    rows = [(rng.randrange(50), n, ["a", str(n)]) for n in range(1_000)]
    frames = (pd.DataFrame(rows[k : k + 30], columns=["seq", "n", "keys"]) for k in range(0, 1_000, 30))
    got = [(r.seq, r.n, list(r.keys)) for r in stateful.in_order(frames, run_rows=100)]
    assert got == sorted(rows, key=lambda r: r[0])


def test_scores_take_the_least_and_the_greatest():
    rng = random.Random(5)
    scores, plain = stateful.Scores({"m1": 2.0}), {"m1": 2.0}
    for _ in range(5_000):
        if rng.random() < 0.6 or not plain:
            member, score = f"m{rng.randrange(40)}", float(rng.randrange(9))
            scores.put(member, score)
            plain[member] = score
        else:
            high = rng.random() < 0.5
            member = (max if high else min)(plain, key=lambda m: (plain[m], m))
            assert scores.pop(high) == (member, plain.pop(member))
    assert scores.members == plain


def test_approximate_trims_have_no_limit_unless_asked(spark):
    x = spark.range(12_345).select(F.lit("k").alias("key"), F.col("id").alias("id_ms"), F.lit(0).cast("long").alias("id_seq"))
    left = lambda y: y.agg(F.min("id_ms"), F.count("*")).first()[:]
    assert left(entries.xtrim_maxlen(x, 70, approximate=True)) == (12_200, 145)
    assert left(entries.xtrim_minid(x, 12_250, approximate=True)) == (12_200, 145)
    assert left(entries.xtrim_maxlen(x, 70, approximate=True, limit=350)) == (300, 12_045)


def test_top_list_counts_are_exact(spark):
    """Many rare items share the few cells with the frequent ones."""
    log = spark.range(4_000).select(F.lit(1).alias("key"), F.col("id").alias("o"), F.lit("ADD").alias("op"), F.when(F.col("id") % 40 < 3, F.col("id") % 40).otherwise(F.col("id")).cast("string").alias("item"))
    log = log.unionByName(spark.sql("SELECT 1 AS key, 5000L AS o, 'QUERY' AS op, '2' AS item"))
    top = sketches.topk_fold_list(log, "o", 3, width=16, depth=2)
    assert {(r["item"], r["cnt"]) for r in top.collect()} == {("0", 100), ("1", 100), ("2", 100)}


def test_count_min_rows_are_independent(spark):
    items = spark.range(3_000).select(sketches.cms_cells(64, 5, F.col("id").cast("string")).alias("c"))
    assert items.distinct().count() >= 2_990


def test_cuckoo_commands_do_not_visit_every_filter():
    c = sketches.Cuckoo(8)
    seen = 0

    class Counted(list):
        def __getitem__(self, at):
            nonlocal seen
            seen += 1
            return super().__getitem__(at)

    grow = c._empty
    c._empty = lambda k: Counted(grow(k))
    assert all(c.add(i) for i in range(6_000)) and all(c.count(i) for i in range(6_000)) and c.info()["filters"] > 600
    assert seen < 60 * 6_000
    held = {(b << 8 | m) for f in c.filters for b, marks in enumerate(f) for m in marks}
    assert held == set(c.held[4]) and sum(c.held[4].values()) == 6_000


def test_numbers_are_formatted_once_a_row(spark):
    assert str(format_double(F.col("x"))).count("format_string") <= 4


def test_parts_of_a_table_do_not_grow_with_it(spark, data, monkeypatch):
    few = views.lst(spark, data).orderBy("key", "pos").collect()
    monkeypatch.setattr(views, "PART_ROWS", 700)
    many = views.lst(spark, data)
    assert many.rdd.getNumPartitions() == 9 and many.orderBy("key", "pos").collect() == few


def shuffled_rows(spark):
    empty = spark.sparkContext._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_growing_bloom_filters_shuffle_an_item_once(spark):
    """All items are found and hardly any other, over many segments; no row for every bit of an item goes over the network."""
    items = spark.range(6_000).select((F.col("id") % 2).cast("string").alias("key"), F.col("id").alias("item"), F.col("id").alias("o"))
    others = items.selectExpr("key", "-item - 1 AS item").unionByName(spark.sql("SELECT 'none' AS key, 1L AS item UNION ALL SELECT NULL, 2L UNION ALL SELECT '0', NULL"))
    before = shuffled_rows(spark)
    bloom = sketches.bloom_grow(items, "o", 100)
    rows = sketches.bloom_grow_exists(bloom, items.select("key", "item").unionByName(others)).collect()
    assert shuffled_rows(spark) - before < 10 * 6_000
    small = sketches.bloom_grow(items, "o", 100, segment=1 << 12)
    for found in (rows, sketches.bloom_grow_exists(small, items.select("key", "item").unionByName(others), segment=1 << 12).collect()):
        assert len(found) == 12_003 and all(r["found"] == 1 for r in found if (r["item"] or -1) >= 0 and r["key"] in ("0", "1"))
        assert all(r["found"] == 0 for r in found if r["key"] in ("none", None) or r["item"] is None)
        assert sum(r["found"] for r in found if (r["item"] or 0) < 0) < 120
    assert {r["layer"] for r in bloom.select("layer").distinct().collect()} == {0, 1, 2, 3, 4}
