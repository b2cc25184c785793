"""JSON document and sketch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions.shared import written
from keyloom.operators import json_docs as j
from keyloom.operators import sketches as k
from keyloom.plans.views import jsn, query, table


def docs(s, d):
    """A document per order: numbers, text, an array of three, a nested object and a flag."""
    o = table(s, d, "orders")
    n = F.col("o_orderkey")
    return o.select(
        n.alias("key"),
        F.to_json(F.struct(n.alias("id"), F.col("o_orderstatus").alias("st"), F.array(n % 5, n % 7, n % 11).alias("a"), F.struct((n % 13).alias("x"), F.struct((n % 3).alias("z")).alias("y")).alias("o"), (n % 2 == 0).alias("f"))).alias("doc"),
    )


def reply(df, i=0):
    return df.select("key", F.get("reply", F.lit(i)).alias("reply"))


def field(df, path, kind="bigint"):
    return df.select("key", j.scalar(F.col("doc"), path).cast(kind).alias("v"))


O = "FROM orders"  # noqa: E741
K = "o_orderkey AS key"
query("json_get_scalar", "jsn", "SELECT key, json_extract_string(doc, '$.k')::BIGINT AS v FROM jsn")(lambda s, d: field(jsn(s, d), "$.k"))
query("json_get", "", f"SELECT {K}, '[' || (o_orderkey % 7) || ']' AS value {O}")(lambda s, d: j.get(docs(s, d), "$.a[-2]"))
query("json_get_legacy", "", f"SELECT {K}, '\"' || o_orderstatus || '\"' AS value {O}")(lambda s, d: j.get(docs(s, d), ".st"))
query("json_get_deep", "", f"SELECT {K}, '[' || (o_orderkey % 3) || ']' AS value {O}")(lambda s, d: j.get(docs(s, d), "$..z"))
query("json_get_max", "", f"SELECT {K}, '[' || greatest(o_orderkey % 5, o_orderkey % 7, o_orderkey % 11) || ']' AS value {O}")(lambda s, d: j.get(docs(s, d), "max($.a[*])").select("key", "value"))
query("json_get_many", "", f"SELECT {K}, '{{\"$.id\":[' || o_orderkey || '],\"$.o.x\":[' || (o_orderkey % 13) || ']}}' AS value {O}")(lambda s, d: j.get(docs(s, d), "$.id", "$.o.x"))
query("json_mget", "", "SELECT k AS key, CASE WHEN o_orderkey IS NOT NULL THEN '[' || (k % 13) || ']' END AS value FROM (VALUES (1), (2), (-9)) v(k) LEFT JOIN orders ON o_orderkey = k")(lambda s, d: j.mget(docs(s, d), s.createDataFrame([(1,), (2,), (-9,)], "key long"), "$.o.x"))
query("json_type", "", f"SELECT {K}, 'array' AS a, 'object' AS o, 'boolean' AS f {O}")(lambda s, d: reply(j.type_(docs(s, d), "$.a")).withColumnRenamed("reply", "a").join(reply(j.type_(docs(s, d), "$.o")).withColumnRenamed("reply", "o"), "key").join(reply(j.type_(docs(s, d), "$.f")).withColumnRenamed("reply", "f"), "key"))
query("json_strlen", "", f"SELECT {K}, length(o_orderstatus)::BIGINT AS reply {O}")(lambda s, d: reply(j.strlen(docs(s, d), "$.st")))
query("json_objlen", "", f"SELECT {K}, 5::BIGINT AS reply {O}")(lambda s, d: reply(j.objlen(docs(s, d))))
query("json_arrlen", "", f"SELECT {K}, 3::BIGINT AS reply {O}")(lambda s, d: reply(j.arrlen(docs(s, d), "$.a")))
query("json_objkeys", "", f"SELECT {K}, 'a,f,id,o,st' AS reply {O}")(lambda s, d: reply(j.objkeys(docs(s, d))).select("key", F.array_join("reply", ",").alias("reply")))
query("json_arrindex", "", f"SELECT {K}, CASE WHEN o_orderkey % 5 = 3 THEN 0 WHEN o_orderkey % 7 = 3 THEN 1 WHEN o_orderkey % 11 = 3 THEN 2 ELSE -1 END::BIGINT AS reply {O}")(lambda s, d: reply(j.arrindex(docs(s, d), "$.a", 3)))
query("json_debug_fields", "", f"SELECT {K}, 11::BIGINT AS reply {O}")(lambda s, d: reply(j.debug_fields(docs(s, d))))
query("json_resp", "", f"SELECT {K}, '[\"[\",' || (o_orderkey % 5) || ',' || (o_orderkey % 7) || ',' || (o_orderkey % 11) || ']' AS reply {O}")(lambda s, d: reply(j.resp(docs(s, d), "$.a")))
query("json_set", "", f"SELECT {K}, 42::BIGINT AS v {O}")(lambda s, d: field(j.set_(docs(s, d), "$.o.new", 42), "$.o.new"))
query("json_set_nx", "", f"SELECT {K}, o_orderkey % 13 AS v {O}")(lambda s, d: field(j.set_(docs(s, d), "$.o.x", 42, nx=True), "$.o.x"))
query("json_mset", "", f"SELECT {K}, CASE o_orderkey WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE o_orderkey END AS v {O}")(lambda s, d: field(j.mset(docs(s, d), [(1, "$.id", 7), (2, "$.id", 8)]), "$.id"))
query("json_numincrby", "", f"SELECT {K}, o_orderkey % 13 + 5 AS v {O}")(lambda s, d: field(j.numincrby(docs(s, d), "$.o.x", 5), "$.o.x"))
query("json_nummultby", "", f"SELECT {K}, (o_orderkey % 13) * 3 AS v {O}")(lambda s, d: field(j.nummultby(docs(s, d), "$.o.x", 3), "$.o.x"))
query("json_toggle", "", f"SELECT {K}, o_orderkey % 2 <> 0 AS v {O}")(lambda s, d: field(j.toggle(docs(s, d), "$.f"), "$.f", "boolean"))
query("json_strappend", "", f"SELECT {K}, o_orderstatus || 'zz' AS v {O}")(lambda s, d: field(j.strappend(docs(s, d), "$.st", "zz"), "$.st", "string"))
query("json_del", "", f"SELECT {K}, 1::BIGINT AS reply {O}")(lambda s, d: reply(j.objlen(j.delete(docs(s, d), "$.o.y"), "$.o")))
query("json_clear", "", f"SELECT {K}, 0::BIGINT AS reply {O}")(lambda s, d: reply(j.arrlen(j.clear(docs(s, d), "$.a"), "$.a")))
query("json_arrappend", "", f"SELECT {K}, 5::BIGINT AS reply {O}")(lambda s, d: reply(j.arrlen(j.arrappend(docs(s, d), "$.a", 1, 2), "$.a")))
query("json_arrinsert", "", f"SELECT {K}, -1 AS v {O}")(lambda s, d: field(j.arrinsert(docs(s, d), "$.a", 1, -1), "$.a[1]"))
query("json_arrpop", "", f"SELECT {K}, (o_orderkey % 11)::VARCHAR AS reply {O}")(lambda s, d: reply(j.arrpop(docs(s, d), "$.a")[0]))
query("json_arrtrim", "", f"SELECT {K}, o_orderkey % 7 AS v {O}")(lambda s, d: field(j.arrtrim(docs(s, d), "$.a", 1, 1), "$.a[0]"))
query("json_merge", "", f"SELECT {K}, 9::BIGINT AS v {O}")(lambda s, d: field(j.merge(docs(s, d), "$", {"o": {"x": 9, "y": None}, "st": None}), "$.o.x"))

# ---- sketches -------------------------------------------------------------------------------------------------------


def pairs(s, d):
    return table(s, d, "lineitem").select((F.col("l_suppkey") % 20).alias("key"), F.col("l_partkey").alias("item"))


query("pfcount_within_bound", "", "SELECT DISTINCT l_suppkey % 20 AS key, TRUE AS ok FROM lineitem")(
    lambda s, d: k.pfcount(k.pfadd(pairs(s, d))).join(pairs(s, d).groupBy("key").agg(F.count_distinct("item").alias("n")), "key").select("key", (F.abs(F.col("estimate") - F.col("n")) <= 0.03 * F.col("n") + 1).alias("ok"))
)
query("pfmerge_within_bound", "", "SELECT TRUE AS ok")(
    lambda s, d: k.pfcount(k.pfmerge(k.pfadd(pairs(s, d)).withColumn("key", F.lit(0)))).join(pairs(s, d).agg(F.count_distinct("item").alias("n"), F.lit(0).alias("key")), "key").select((F.abs(F.col("estimate") - F.col("n")) <= 0.03 * F.col("n")).alias("ok"))
)


def log(s, d):
    return pairs(s, d).withColumn("by", F.lit(1).cast("long"))


query("cms_query_bounds", "", "SELECT l_suppkey % 20 AS key, l_partkey AS item, TRUE AS ok FROM lineitem GROUP BY 1, 2, 3")(
    lambda s, d: k.cms_query(k.cms_incrby(log(s, d), 20000, 5), pairs(s, d).distinct(), 20000, 5).join(log(s, d).groupBy("key", "item").agg(F.sum("by").alias("n")), ["key", "item"]).select("key", "item", ((F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + 3)).alias("ok"))
)
query("cms_info", "", "SELECT l_suppkey % 20 AS key, 1000 AS width, 4 AS depth, count(*)::BIGINT AS count FROM lineitem GROUP BY 1")(lambda s, d: k.cms_info(k.cms_incrby(log(s, d), 1000, 4), 1000, 4))
query("cms_merge_total", "", "SELECT (3 * count(*))::BIGINT AS total FROM lineitem WHERE l_suppkey % 20 < 2")(lambda s, d: k.cms_merge([k.cms_incrby(log(s, d).filter(f"key = {i}"), 500, 3) for i in (0, 1)], [3, 3]).filter("row = 0").agg(F.sum("cnt").alias("total")))
query("bloom_no_false_negative", "", "SELECT l_suppkey % 20 AS key, min(1) AS found FROM lineitem GROUP BY 1")(lambda s, d: k.bloom_exists(k.bloom_add(pairs(s, d), 20000), pairs(s, d).distinct(), 20000).groupBy("key").agg(F.min("found").alias("found")))
query("bloom_false_positives_bounded", "", "SELECT TRUE AS ok")(lambda s, d: k.bloom_exists(k.bloom_add(pairs(s, d), 20000), pairs(s, d).distinct().withColumn("item", -F.col("item") - 1), 20000).agg((F.avg("found") < 0.02).alias("ok")))
query("bloom_info", "", "SELECT DISTINCT l_suppkey % 20 AS key, 20000 AS capacity, 7 AS hashes FROM lineitem")(lambda s, d: k.bloom_info(k.bloom_add(pairs(s, d), 20000), 20000).select("key", "capacity", "hashes"))


def cuckoo_log(s, d):
    c = table(s, d, "customer").select((F.col("c_nationkey") % 3).alias("key"), F.col("c_custkey").alias("item"))
    adds = c.select("key", F.col("item").alias("o"), F.lit("ADD").alias("op"), "item")
    return adds.unionByName(c.select("key", (F.col("item") + 1_000_000).alias("o"), F.lit("EXISTS").alias("op"), "item"))


query("cuckoo_no_false_negative", "", "SELECT c_nationkey % 3 AS key, 2 * count(*) AS n, TRUE AS ok FROM customer GROUP BY 1")(lambda s, d: k.cuckoo_fold(cuckoo_log(s, d), "o", capacity=512).groupBy("key").agg(F.count("*").alias("n"), (F.min("reply") == 1).alias("ok")))
query("topk_list", "", "SELECT * FROM (SELECT l_suppkey % 20 AS key, l_partkey AS item, count(*)::BIGINT AS cnt, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY count(*) DESC, l_partkey) - 1 AS rank FROM lineitem GROUP BY 1, 2) WHERE rank < 5")(lambda s, d: k.topk_list(k.topk_counts(log(s, d)), 5))
query("topk_query", "", "SELECT key, item, (rank < 5)::INTEGER AS found FROM (SELECT l_suppkey % 20 AS key, l_partkey AS item, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY count(*) DESC, l_partkey) - 1 AS rank FROM lineitem GROUP BY 1, 2)")(lambda s, d: k.topk_query(k.topk_counts(log(s, d)), 5, pairs(s, d).distinct()))
query("topk_sketch")(lambda s, d: k.topk_sketch(log(s, d), 5))


def deletes(s, d):
    """Every customer added, those of even numbers deleted, then all of them asked for."""
    c = table(s, d, "customer").select((F.col("c_nationkey") % 3).alias("key"), F.col("c_custkey").alias("item"))
    ops = [c.select("key", (F.lit(n * 10_000_000) + F.col("item")).alias("o"), F.lit(op).alias("op"), "item") for n, op in enumerate(("INSERT", "DEL", "EXISTS"))]
    return ops[0].unionByName(ops[1].filter("item % 2 = 0")).unionByName(ops[2].filter("item % 2 = 1"))


query("cuckoo_delete", "", "SELECT c_nationkey % 3 AS key, count(*) FILTER (c_custkey % 2 = 0) AS deleted, count(*) FILTER (c_custkey % 2 = 1) AS found FROM customer GROUP BY 1")(
    lambda s, d: k.cuckoo_fold(deletes(s, d), "o", capacity=64, expansion=3).withColumn("n", F.floor(F.col("o") / 10_000_000)).groupBy("key").agg(F.sum(F.when(F.col("n") == 1, F.col("reply"))).alias("deleted"), F.sum(F.when(F.col("n") == 2, F.col("reply"))).alias("found"))
)
query("cuckoo_info", "", "SELECT c_nationkey % 3 AS key, count(*) FILTER (c_custkey % 2 = 1) AS items, 4 AS expansion, 2 AS bucket_size FROM customer GROUP BY 1")(lambda s, d: k.cuckoo_info(deletes(s, d), "o", capacity=64, expansion=3).select("key", "items", "expansion", "bucket_size"))
query("topk_fold", "", "SELECT key, string_agg(cnt::VARCHAR, ',' ORDER BY cnt DESC) AS counts FROM (SELECT l_suppkey % 20 AS key, count(*) AS cnt, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY count(*) DESC) AS n FROM lineitem GROUP BY 1, l_partkey) WHERE n <= 5 GROUP BY 1")(
    lambda s, d: k.topk_fold_list(table(s, d, "lineitem").select((F.col("l_suppkey") % 20).alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.lit("ADD").alias("op"), F.col("l_partkey").alias("item")), "o", 5, width=4096, depth=5)
    .groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list("cnt"), False), lambda x: x.cast("string")), ",").alias("counts"))
)


def grown(s, d):
    """A growing filter, written out in chunks and loaded again."""
    ordered = table(s, d, "lineitem").select((F.col("l_suppkey") % 20).alias("key"), F.col("l_partkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return k.bloom_loadchunk(written(k.bloom_scandump(k.bloom_grow(ordered, "o", 100), 64), "bloom-chunks"))


def grown_asked(s, d):
    bloom = grown(s, d)
    found = k.bloom_grow_exists(bloom, pairs(s, d).distinct()).groupBy("key").agg(F.min("found").alias("found"))
    return found.join(bloom.groupBy("key").agg(F.count_distinct("layer").alias("layers")), "key")


query("bloom_grow", "", "SELECT l_suppkey % 20 AS key, ceil(log2(count(DISTINCT l_partkey) / 100.0 + 1))::BIGINT AS layers, 1 AS found FROM lineitem GROUP BY 1")(grown_asked)
