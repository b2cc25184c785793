"""Column kernels shared by the operators: index ranges, glob patterns, numeric text, live rows, table versions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.shared import written

LARGE_KEY = 1_000_000  # rows of one key that a task takes for a rank; beyond it the key is cut into ranges
MAX_TTL_MS = 268_435_455_000  # the longest relative expiry; longer ones are clamped


def lit(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def index_bounds(start: Column | int, stop: Column | int, length: Column) -> tuple[Column, Column]:
    """First and last 0-based index of an inclusive range whose negative ends count from the back.

    A range is empty (last < first) if it begins past the end, or if both ends are negative and reversed; a stop before
    the head counts as the head.
    """
    s, e, n = lit(start), lit(stop), length
    first = F.greatest(F.when(s < 0, n + s).otherwise(s), F.lit(0))
    last = F.least(F.greatest(F.when(e < 0, n + e).otherwise(e), F.lit(0)), n - 1)
    return first, F.when((s < 0) & (e < s), F.lit(-1)).otherwise(last)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: * ? [a-z] [^...] and \\x."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[" and (end := pattern.find("]", i + (2 if pattern[i : i + 1] == "^" else 1))) > 0:
            body = pattern[i:end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            out.append("[" + "^" * negated + re.sub(r"([\[\]&^])", r"\\\1", body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"(?s)^{''.join(out)}$"


def glob(c: Column, pattern: str) -> Column:
    """Predicate of a glob; plain prefixes, suffixes and infixes become pushable string predicates."""
    plain = pattern.strip("*")
    if not re.search(r"[*?\[\\]", plain):
        head, tail = pattern.startswith("*"), pattern.endswith("*")
        if pattern and not plain:
            return F.lit(True)
        if head and tail:
            return c.contains(plain)
        if tail:
            return c.startswith(plain)
        return c.endswith(plain) if head else c == pattern
    return c.rlike(glob_regex(pattern))


def parse_long(text: Column) -> Column:
    """A 64-bit integer of strict decimal text (a sign is allowed), else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def parse_double(text: Column) -> Column:
    """A double of text with blanks trimmed; inf spelled out is allowed, overflow and other text give null."""
    t = F.lower(F.trim(text))
    named = F.when(t.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(t.isin("-inf", "-infinity"), F.lit(float("-inf")))
    value = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), t.try_cast("double"))
    return F.coalesce(named, F.when(F.abs(value) < float("inf"), value))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def format_double(x: Column) -> Column:
    """Shortest decimal text without exponent; whole numbers without a point, inf, -inf and nan by name.

    The shortest of 15, 16 or more digits that reads back as the number is taken apart into digits and the place of the
    point, and written out with as many zeros as it needs. Each step is computed once a row: as plain expressions, that name
    the one before several times, they would be computed over and over.
    """
    digits_of = lambda n: F.format_string(f"%.{n - 1}E", x)
    short = _let(digits_of(15), lambda s: F.when(s.try_cast("double") == x, s))
    short = F.coalesce(short, _let(digits_of(16), lambda s: F.when(s.try_cast("double") == x, s)), x.cast("string"))

    def parts(text: Column) -> Column:
        mantissa = F.replace(F.substring_index(text, "E", 1), F.lit("-"), F.lit(""))
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
        point = F.instr(mantissa, ".") - 1 + F.when(text.contains("E"), F.substring_index(text, "E", -1).try_cast("int")).otherwise(0)
        return F.struct(digits.alias("digits"), point.alias("point"))

    def fixed(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        n = F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        large = F.when(n <= point, F.rpad(digits, point, "0")).otherwise(F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, n)))
        return F.when(point <= 0, small).otherwise(large)

    number = F.concat(F.when(x < 0, "-").otherwise(""), _let(_let(short, parts), fixed))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, "0").otherwise(number)


def live(df: DataFrame, now_ms: int | Column, expire: str = "expire_at_ms") -> DataFrame:
    """Rows that have not expired; a sticky row never does."""
    if expire not in df.columns:
        return df
    alive = F.col(expire).isNull() | (F.col(expire) > lit(now_ms))
    return df.filter(alive | F.col("sticky") if "sticky" in df.columns else alive)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next version of a table: delta's rows replace base's rows of equal keys."""
    return base.join(delta.select(*keys).distinct(), list(keys), "left_anti").unionByName(delta, allowMissingColumns=True)


def without(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def last_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the greatest order, by an aggregate (no window, combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _same(keys: list[str]) -> Column:
    """Join condition: equal keys (nulls are equal) of rows and of a table that names them __key0, __key1, ..."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__key{i}")) for i, c in enumerate(keys)])


def _large_keys(df: DataFrame, order: Sequence[Column], keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of other keys, rows of keys of over LARGE_KEY rows). The latter are range-partitioned by key and order, with
    the key's number of rows as __n and the number of the range as __range, and written, so that the ranges stay as they are."""
    if df.count() <= LARGE_KEY:  # no key can have more, and a count alone reads hardly any column
        return df, None
    held = [F.col(c).alias(f"__key{i}") for i, c in enumerate(keys)]
    counts = df.groupBy(*held).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LARGE_KEY)
    if counts.isEmpty():
        return df, None
    counts = written(counts, "large-keys")
    marked = df.join(counts, _same(keys), "left").drop(*[f"__key{i}" for i in range(len(keys))])
    ranges = marked.filter(F.col("__n").isNotNull()).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    return marked.filter(F.col("__n").isNull()).drop("__n"), written(ranges, "ranges")


def _with_earlier(rows: DataFrame, large: DataFrame, value: Column, how: Callable[[Column], Column], keys: list[str]) -> DataFrame:
    """rows of large keys with `__earlier`: value, an aggregate of each range, put together by `how` over the key's ranges before."""
    held = [f"__key{i}" for i in range(len(keys))]
    w = W.partitionBy(*held).orderBy("__m").rowsBetween(W.unboundedPreceding, -1)
    totals = large.groupBy(*[F.col(c).alias(h) for c, h in zip(keys, held, strict=True)], F.col("__range").alias("__m")).agg(value.alias("__v"))
    earlier = totals.select(*held, "__m", how(F.col("__v")).over(w).alias("__earlier"))
    return rows.join(earlier, _same(keys) & (F.col("__range") == F.col("__m")), "left")


def ranked(df: DataFrame, order: Sequence[Column], key: str | Sequence[str] = "key", name: str = "rank", length: str | None = None) -> DataFrame:
    """Rows with their rank in the key, from 0, and the key's number of rows in column `length` if one is named.

    A key of up to LARGE_KEY rows is a window. A larger one is cut into ranges of its order: a rank is that in the range,
    plus the rows of the ranges before, so no task takes more of a key than a range.
    """
    rank = lambda *by: (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("long")
    keys = _names(key)
    rest, large = _large_keys(df, order, keys)
    out = rest.withColumn(name, rank(*keys))
    if length is not None:
        out = out.withColumn(length, F.count(F.lit(1)).over(W.partitionBy(*keys)))
    if large is None:
        return out
    split = _with_earlier(large.withColumn("__rank", rank(*keys, "__range")), large, F.count(F.lit(1)), F.sum, keys)
    number = F.col("__rank") + F.coalesce("__earlier", F.lit(0))
    size = [] if length is None else [F.col("__n").alias(length)]
    kept = [c for c in df.columns if c not in (name, length)]
    return out.select(*kept, name, *([] if length is None else [length])).unionByName(split.select(*kept, number.alias(name), *size))


def running(df: DataFrame, order: Sequence[Column], value: Column, how: Callable[[Column], Column], both: Callable[[Column, Column], Column], name: str, *, last: int = 0, key: str | Sequence[str] = "key") -> DataFrame:
    """Rows with how(value) over the key's rows up to each (last=0) or before it (last=-1); both(a, b) puts the values of two
    stretches together and passes over nulls. Large keys are cut into ranges as in `ranked`."""
    frame = lambda *by: how(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, last))
    keys = _names(key)
    rest, large = _large_keys(df, order, keys)
    out = rest.withColumn(name, frame(*keys))
    if large is None:
        return out
    split = _with_earlier(large.withColumn("__own", frame(*keys, "__range")), large, how(value), how, keys)
    return out.unionByName(split.select(*df.columns, both(F.col("__earlier"), F.col("__own")).alias(name)))


def first_ranked(df: DataFrame, order: Sequence[Column], n: int | Column, key: str = "key", name: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank. The bound stands on row_number itself, so that the plan keeps only
    n rows of a key per task before the shuffle (WindowGroupLimit): a hot key costs no task more than that."""
    w = W.partitionBy(key).orderBy(*order)
    numbered = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= lit(n))
    return numbered.withColumn(name, (F.col("__rn") - 1).cast("long")).drop("__rn")
