"""Every registered query of the keyed operators against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest
import xxhash
from conftest import DATA

from keyloom.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "%.9g" % v
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


# ---- queries that SQL cannot say, in plain Python -----------------------------------------------------------------------


def plain_rates(log):
    """Replies of the rate limiter, 3 at once and 3 a day, from its definition: a request conforms if the time at which the
    bucket would be empty again, one interval later, is no more than the whole burst away."""
    interval, burst, due, out = 86400 * 10**9 // 3, 3, {}, []
    up = lambda ns: 0 if ns <= 0 else -(-ns // 10**6) // 1000 + 1
    for key, seq, ms in log:
        now = ms * 10**6
        free = max(due.get(key, now), now)
        ok = free + interval <= now + burst * interval
        after = free + interval if ok else free
        if ok:
            due[key] = after
        room = burst * interval - (after - now)
        retry = -1 if ok else (lambda ms: ms // 1000 + 1 if ms > 0 else ms)(-((now + burst * interval - free - interval) // 10**6))
        out.append((key, seq, int(not ok), burst, room // interval, retry, up(after - now)))
    return out


def plain_bitfield(duck):
    for key, brand in duck.sql("SELECT p_partkey, p_brand FROM part").fetchall():
        raw = bytearray(brand.encode())
        raw[0] = (raw[0] + 10) % 256
        second = raw[1] - 256 if raw[1] > 127 else raw[1]
        third = min(127, second + 100)
        raw[1] = third % 256
        yield key, raw.hex().upper(), f"{raw[0]},{third},{raw[0] >> 4}"


def plain_pops(duck):
    held, waits = {}, {}
    for queue, name, user, value in duck.sql("SELECT event_type, event_id, user_id, value FROM events ORDER BY event_id").fetchall():
        if name % 4:
            held.setdefault(queue, {})[str(user)] = value
        else:
            waits.setdefault(queue, []).append(str(name))
        while held.get(queue) and waits.get(queue):
            least = min(held[queue], key=lambda m: (held[queue][m], m))
            yield queue, waits[queue].pop(0), least, held[queue].pop(least)


EVENTS = "SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events ORDER BY"
RATES = ["key", "o", "limited", "limit", "remaining", "retry_s", "reset_s"]
BRUTE = {
    "digest": lambda c: (["key", "digest"], [(k, t and xxhash.xxh3_64_hexdigest(t)) for k, t in c.sql("SELECT doc_id, text FROM documents").fetchall()]),
    "throttle_gcra": lambda c: (RATES, plain_rates(c.sql(f"{EVENTS} ms, event_id").fetchall())),
    "stream_throttle": lambda c: (["key", "seq", *RATES[2:]], plain_rates(c.sql(f"{EVENTS} event_id").fetchall())),
    "bitfield": lambda c: (["key", "value", "replies"], list(plain_bitfield(c))),
    "stream_bzpopmin": lambda c: (["queue", "conn", "member", "score"], list(plain_pops(c))),
}


def check_top(duck, got):
    """Fewer distinct items than the sketch holds: its counts are exact."""
    want = {}
    for key, n in duck.sql("SELECT l_suppkey % 20, count(*) AS n FROM lineitem GROUP BY l_suppkey % 20, l_partkey ORDER BY n DESC").fetchall():
        want.setdefault(key, []).append(n)
    assert {r["key"]: [x["count"] for x in r["top"]] for r in got} == {k: ns[:5] for k, ns in want.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name == "topk_sketch":
        return check_top(duck, got)
    if name not in ORACLES:
        columns, data = BRUTE[name](duck)
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, data)
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
