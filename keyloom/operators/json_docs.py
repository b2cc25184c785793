"""JSON documents: tables (key, doc) of text. Simple paths read through get_json_object; every other path and all
rewriting goes through Arrow-batched functions, as the engine has no function that changes a document."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import jsonpath as jp
from keyloom.functions.kernels import lit, upsert

SIMPLE = re.compile(r"^\$(\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\])*$")


def scalar(doc: Column, path: str) -> Column:
    """Text of a path that has at most one match: a built-in, evaluated in the generated code."""
    if not SIMPLE.match(path):
        raise ValueError("only names and indexes")
    return F.get_json_object(doc, path)


def _read(doc: Column, kind: str, f: Callable[[Any], Any]) -> Column:
    @F.pandas_udf(kind)
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda t: None if t is None else f(json.loads(t)))

    return run(doc)


def get(d: DataFrame, *paths: str) -> DataFrame:
    """JSON.GET: one path as is, several as an object of their replies."""
    if len(paths) == 1:
        return d.select("key", _read(F.col("doc"), "string", lambda v: jp.get(v, paths[0])).alias("value"))
    legacy = all(map(jp.is_legacy, paths))
    one = lambda v, p: (jp.find(v, p) or [None])[-1] if legacy else jp.find(v, p)
    return d.select("key", _read(F.col("doc"), "string", lambda v: jp.dumps({p: one(v, p) for p in paths})).alias("value"))


def mget(d: DataFrame, asked: DataFrame, path: str) -> DataFrame:
    return asked.join(get(d, path), "key", "left")


def _each(d: DataFrame, path: str, kind: str, f: Callable[[Any], Any]) -> DataFrame:
    """(key, reply array): f of every match."""
    return d.select("key", _read(F.col("doc"), f"array<{kind}>", lambda v: [f(x) for x in jp.find(v, path)]).alias("reply"))


def type_(d: DataFrame, path: str = "$") -> DataFrame:
    return _each(d, path, "string", jp.type_name)


def strlen(d: DataFrame, path: str = "$") -> DataFrame:
    return _each(d, path, "bigint", lambda x: len(x.encode()) if isinstance(x, str) else None)


def objlen(d: DataFrame, path: str = "$") -> DataFrame:
    return _each(d, path, "bigint", lambda x: len(x) if isinstance(x, dict) else None)


def arrlen(d: DataFrame, path: str = "$") -> DataFrame:
    return _each(d, path, "bigint", lambda x: len(x) if isinstance(x, list) else None)


def objkeys(d: DataFrame, path: str = "$") -> DataFrame:
    return _each(d, path, "array<string>", lambda x: sorted(x) if isinstance(x, dict) else None)


def _same(a: Any, b: Any) -> bool:
    return type(a) is type(b) and a == b


def arrindex(d: DataFrame, path: str, value: Any, start: int = 0, stop: int = 0) -> DataFrame:
    """First index of a value of equal type and content from start to stop (inclusive; 0 is the end), -1 if none."""

    def one(x: Any) -> int | None:
        if not isinstance(x, list):
            return None
        a = max(0, start + len(x) if start < 0 else start)
        b = len(x) - 1 if stop == 0 else min(len(x) - 1, stop + len(x) if stop < 0 else stop)
        return next((k for k in range(a, b + 1) if _same(x[k], value)), -1)

    return _each(d, path, "bigint", one)


def debug_fields(d: DataFrame, path: str = "$") -> DataFrame:
    return _each(d, path, "bigint", lambda x: jp.fields(x) if isinstance(x, (dict, list)) else 1)


def resp(d: DataFrame, path: str = "$") -> DataFrame:
    """Nested replies as text: containers begin with { or [, members follow flat."""

    def one(x: Any) -> Any:
        if isinstance(x, dict):
            return ["{", *(y for k, v in sorted(x.items()) for y in (k, one(v)))]
        return ["[", *map(one, x)] if isinstance(x, list) else x

    return _each(d, path, "string", lambda x: jp.dumps(one(x)))


def _write(d: DataFrame, f: Callable[[Any], Any], *, may_delete: bool = False) -> DataFrame:
    """Next version with every document rewritten; where a function may give None, that deletes the key. Only then is the
    result filtered: a filter on it makes the plan rewrite every document twice."""
    if not may_delete:
        return d.filter(F.col("doc").isNotNull()).withColumn("doc", _read(F.col("doc"), "string", lambda v: jp.dumps(f(v))))
    doc = _read(F.col("doc"), "string", lambda v: None if (w := f(v)) is None else jp.dumps(w))
    return d.withColumn("doc", doc).filter(F.col("doc").isNotNull())


def set_(d: DataFrame, path: str, value: Any, *, nx: bool = False, xx: bool = False) -> DataFrame:
    return _write(d, lambda v: jp.set_(v, path, value, nx=nx, xx=xx)[0], may_delete=True)


def set_root(d: DataFrame, new: DataFrame) -> DataFrame:
    """Whole documents (key, doc) set; invalid text raises."""
    ok = F.when(F.try_parse_json("doc").isNotNull(), F.col("doc")).otherwise(F.raise_error(F.lit("failed to parse JSON")).cast("string"))
    return upsert(d, new.select("key", ok.alias("doc")), ["key"])


def mset(d: DataFrame, triples: list[tuple[Any, str, Any]]) -> DataFrame:
    """Sets in order; a triple's key is touched alone. One pass over the table, however many triples there are; only the
    documents named go through Python."""
    steps: dict[Any, list[tuple[str, Any]]] = {}
    for key, path, value in triples:
        steps.setdefault(key, []).append((path, value))

    @F.pandas_udf("string")
    def run(keys: pd.Series, docs: pd.Series) -> pd.Series:
        def one(key: Any, text: str | None) -> str | None:
            if text is None:
                return None
            doc = json.loads(text)
            for path, value in steps.get(key, ()):
                doc = jp.set_(doc, path, value)[0]
            return jp.dumps(doc)

        return pd.Series([one(k, t) if t is not None else None for k, t in zip(keys, docs, strict=True)], dtype=object)

    named = F.col("key").isin([lit(k) for k in steps])
    return d.withColumn("doc", F.when(named, run(F.when(named, F.col("key")), F.when(named, F.col("doc")))).otherwise(F.col("doc")))


def delete(d: DataFrame, path: str = "$") -> DataFrame:
    return _write(d, lambda v: jp.delete(v, path)[0], may_delete=True)


def merge(d: DataFrame, path: str, patch: Any) -> DataFrame:
    return _write(d, lambda v: jp.rewrite(v, path, lambda x: jp.merge_patch(x, patch))[0], may_delete=True)


def toggle(d: DataFrame, path: str) -> DataFrame:
    return _write(d, lambda v: jp.rewrite(v, path, lambda x: not x if isinstance(x, bool) else x)[0])


def _arith(d: DataFrame, path: str, n: float, f: Callable[[Any, Any], Any]) -> DataFrame:
    def one(x: Any) -> Any:
        if not jp.number(x):
            return x
        y = f(x, n)
        if isinstance(y, float) and (y != y or y in (float("inf"), float("-inf"))):
            raise OverflowError("result is not a number")
        return y

    return _write(d, lambda v: jp.rewrite(v, path, one)[0])


def numincrby(d: DataFrame, path: str, n: float) -> DataFrame:
    return _arith(d, path, n, lambda a, b: a + b)


def nummultby(d: DataFrame, path: str, n: float) -> DataFrame:
    return _arith(d, path, n, lambda a, b: a * b)


def strappend(d: DataFrame, path: str, text: str) -> DataFrame:
    return _write(d, lambda v: jp.rewrite(v, path, lambda x: x + text if isinstance(x, str) else x)[0])


def clear(d: DataFrame, path: str = "$") -> DataFrame:
    return _write(d, lambda v: jp.rewrite(v, path, lambda x: {} if isinstance(x, dict) else [] if isinstance(x, list) else 0 if jp.number(x) else x)[0])


def _on_arrays(d: DataFrame, path: str, f: Callable[[list], list]) -> DataFrame:
    return _write(d, lambda v: jp.rewrite(v, path, lambda x: f(x) if isinstance(x, list) else x)[0])


def arrappend(d: DataFrame, path: str, *values: Any) -> DataFrame:
    return _on_arrays(d, path, lambda x: [*x, *values])


def arrinsert(d: DataFrame, path: str, i: int, *values: Any) -> DataFrame:
    def one(x: list) -> list:
        k = i + len(x) if i < 0 else i
        if not 0 <= k <= len(x):
            raise IndexError("index out of range")
        return [*x[:k], *values, *x[k:]]

    return _on_arrays(d, path, one)


def arrpop(d: DataFrame, path: str = "$", i: int = -1) -> tuple[DataFrame, DataFrame]:
    """(popped, next version); the index is clamped to the array."""
    at = lambda x: max(0, min(len(x) - 1, i + len(x) if i < 0 else i))
    popped = _each(d, path, "string", lambda x: jp.dumps(x[at(x)]) if isinstance(x, list) and x else None)
    return popped, _on_arrays(d, path, lambda x: x[: at(x)] + x[at(x) + 1 :] if x else x)


def arrtrim(d: DataFrame, path: str, start: int, stop: int) -> DataFrame:
    def one(x: list) -> list:
        a = max(0, start + len(x) if start < 0 else start)
        b = min(len(x) - 1, stop + len(x) if stop < 0 else stop)
        return x[a : b + 1] if a <= b else []

    return _on_arrays(d, path, one)
