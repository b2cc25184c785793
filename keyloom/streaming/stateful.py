"""Structured Streaming operators with state per key: id validation, rate limiting, blocking queues, consumer groups.

Each takes a streaming (or batch) DataFrame of commands and returns the replies as an append stream. State is one JSON
text per key in the state store, so it survives restarts with the checkpoint. Rows of a micro-batch are taken in the
order of `seq`; a key's rows are put in order in runs that are spooled to local files, so a task holds one run and the
key's state, not its rows. Waiting clients whose deadline has passed are answered when the next rows of their queue arrive or when
the processing-time timer fires.
"""

from __future__ import annotations

import json
import tempfile
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush, merge
from operator import attrgetter
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.operators.strings import NS, throttle_step


RUN_ROWS = 200_000  # rows of a key that a task sorts at once
BLOCK_ROWS = 2_000  # rows of a spooled run that are read at once
REPLY_ROWS = 10_000  # replies that a task hands on at once


def _spooled(run: pd.DataFrame, path: str) -> Iterator[Any]:
    """The rows of a sorted run, written to a file and read back block by block."""
    table = pa.Table.from_pandas(run, preserve_index=False)
    with pa.ipc.new_file(path, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table, BLOCK_ROWS)

    def rows() -> Iterator[Any]:
        with pa.OSFile(path) as f:
            blocks = pa.ipc.open_file(f)
            for k in range(blocks.num_record_batches):
                yield from blocks.get_batch(k).to_pandas().itertuples(index=False)

    return rows()


def in_order(frames: Iterator[pd.DataFrame], run_rows: int = RUN_ROWS) -> Iterator[Any]:
    """The rows of all frames in the order of seq; rows of equal seq as they come."""
    with tempfile.TemporaryDirectory(prefix="keyloom-runs-") as folder:
        runs: list[Iterator[Any]] = []
        held: list[pd.DataFrame] = []
        n = 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= run_rows:
                runs.append(_spooled(pd.concat(held).sort_values("seq", kind="stable"), f"{folder}/{len(runs)}"))
                held, n = [], 0
        if held:
            runs.append(pd.concat(held).sort_values("seq", kind="stable").itertuples(index=False))
            held = []
        yield from runs[0] if len(runs) == 1 else merge(*runs, key=attrgetter("seq"))


class _Down(tuple):
    """A tuple of a heap whose greatest comes first."""

    __slots__ = ()
    __lt__ = tuple.__gt__


class Scores:
    """Members and their scores; the least or greatest by (score, member) is taken from a heap. Heap entries of scores that
    have been replaced are passed over, and cleared when they outnumber the members."""

    def __init__(self, members: dict[str, float] | None = None) -> None:
        self.members = {m: float(s) for m, s in (members or {}).items()}
        self.heaps: dict[bool, list] = {}

    def __len__(self) -> int:
        return len(self.members)

    def put(self, member: str, score: float) -> None:
        self.members[member] = score
        for high, heap in self.heaps.items():
            heappush(heap, _Down((score, member)) if high else (score, member))

    def pop(self, high: bool) -> tuple[str, float]:
        heap = self.heaps.get(high)
        if heap is None or len(heap) > 2 * len(self.members) + 1_000:
            heap = self.heaps[high] = [_Down((s, m)) if high else (s, m) for m, s in self.members.items()]
            heapify(heap)
        while True:
            score, member = heappop(heap)
            if self.members.get(member) is score:
                return member, self.members.pop(member)


def _plain(x: object) -> object:
    return x.members if isinstance(x, Scores) else list(x)


def fold(commands: DataFrame, keys: list[str], schema: str, step: Callable[[dict, Any], list[tuple]], expired: Callable[[dict, int], list[tuple]] | None = None, loaded: Callable[[dict], None] | None = None) -> DataFrame:
    """Rows of each key, in order of seq, folded over a state dict; step gives the reply rows of one command. loaded turns
    the lists and dicts of a state that is read into the deques and `Scores` that step works on."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if loaded:
            loaded(held)
        out: list[tuple] = []
        if state.hasTimedOut:
            out += expired(held, state.getCurrentProcessingTimeMs()) if expired else []
        else:
            for row in in_order(frames):
                out += step(held, row)
                if len(out) >= REPLY_ROWS:
                    yield pd.DataFrame([(*key, *r) for r in out], columns=columns)
                    out = []
        state.update((json.dumps(held, default=_plain),))
        if expired and (waits := [w["deadline"] for w in held.get("waiters", []) if w["deadline"]]):
            state.setTimeoutDuration(max(1, min(waits) - state.getCurrentProcessingTimeMs()))
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expired else GroupStateTimeout.NoTimeout
    return commands.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", timeout)


def _waiting(held: dict) -> None:
    """Those that wait as a queue, and the earliest of their deadlines (it may be of one that has been served since)."""
    held["waiters"] = deque(held.get("waiters", ()))
    held["soonest"] = min((w["deadline"] for w in held["waiters"] if w["deadline"]), default=0)


def _wait(held: dict, waiter: dict) -> None:
    held["waiters"].append(waiter)
    if waiter["deadline"]:
        held["soonest"] = min(held["soonest"] or waiter["deadline"], waiter["deadline"])


def _deadlines(blank: tuple) -> Callable[[dict, int], list[tuple]]:
    def late(held: dict, now: int) -> list[tuple]:
        if not held["soonest"] or held["soonest"] > now:
            return []
        gone = [w for w in held["waiters"] if w["deadline"] and w["deadline"] <= now]
        held["waiters"] = [w for w in held["waiters"] if not w["deadline"] or w["deadline"] > now]
        _waiting(held)
        return [(w["conn"], *blank) for w in gone]

    return late


def validated_entries(entries: DataFrame) -> DataFrame:
    """(key, seq, id_ms, id_seq) -> with `accepted`: an id must exceed every accepted one before it. Late ids are refused."""

    def step(held: dict, r: Any) -> list[tuple]:
        ok = [int(r.id_ms), int(r.id_seq)] > held.get("last", [-1, -1])
        if ok:
            held["last"] = [int(r.id_ms), int(r.id_seq)]
        return [(int(r.seq), int(r.id_ms), int(r.id_seq), bool(ok))]

    kind = entries.schema["key"].dataType.simpleString()
    return fold(entries, ["key"], f"key {kind}, seq long, id_ms long, id_seq long, accepted boolean", step)


def throttled(requests: DataFrame, *, max_burst: int, count: int, period: int, quantity: int = 1) -> DataFrame:
    """(key, seq, now_ms) -> the five-number reply of the rate limiter; state is one arrival time."""
    limit, interval = max_burst + 1, period * NS // count

    def step(held: dict, r: Any) -> list[tuple]:
        now = int(r.now_ms) * 1_000_000
        tat = held.get("tat")
        tat = None if tat is None or tat <= now else tat
        new, reply = throttle_step(tat, now, limit, interval, quantity)
        if new is not None:
            held["tat"] = new
        return [(int(r.seq), *map(int, reply))]

    kind = requests.schema["key"].dataType.simpleString()
    return fold(requests, ["key"], f"key {kind}, seq long, limited int, limit long, remaining long, retry_s long, reset_s long", step)


def blocking_queue(commands: DataFrame, timers: bool = True) -> DataFrame:
    """(queue, seq, op, conn, value, now_ms, deadline_ms) -> (queue, conn, value) replies.

    op: LPUSH, RPUSH, BLPOP, BRPOP. A pop takes at once if it can, else it waits; waiters are served first come, first
    served; a waiter whose deadline (0: never) has passed gets a null value. Bounded runs do without timers, which would
    keep them waiting.
    """
    late = _deadlines((None,))

    def loaded(held: dict) -> None:
        held["items"] = deque(held.get("items", ()))
        _waiting(held)

    def step(held: dict, r: Any) -> list[tuple]:
        items, out = held["items"], late(held, int(r.now_ms))
        if r.op in ("LPUSH", "RPUSH"):
            items.appendleft(r.value) if r.op == "LPUSH" else items.append(r.value)
        else:
            _wait(held, {"conn": str(r.conn), "tail": r.op == "BRPOP", "deadline": int(r.deadline_ms)})
        waiters = held["waiters"]
        while items and waiters:
            w = waiters.popleft()
            out.append((w["conn"], items.pop() if w["tail"] else items.popleft()))
        return out

    return fold(commands, ["queue"], "queue string, conn string, value string", step, late if timers else None, loaded)


def blocking_scores(commands: DataFrame, timers: bool = True) -> DataFrame:
    """As blocking_queue for sorted sets: (queue, seq, op, conn, member, score, now_ms, deadline_ms), op ZADD, BZPOPMIN, BZPOPMAX."""
    late = _deadlines((None, None))

    def loaded(held: dict) -> None:
        held["members"] = Scores(held.get("members"))
        _waiting(held)

    def step(held: dict, r: Any) -> list[tuple]:
        members, out = held["members"], late(held, int(r.now_ms))
        if r.op == "ZADD":
            members.put(r.member, float(r.score))
        else:
            _wait(held, {"conn": str(r.conn), "high": r.op == "BZPOPMAX", "deadline": int(r.deadline_ms)})
        waiters = held["waiters"]
        while members and waiters:
            w = waiters.popleft()
            out.append((w["conn"], *members.pop(w["high"])))
        return out

    return fold(commands, ["queue"], "queue string, conn string, member string, score double", step, late if timers else None, loaded)


def _served(held: dict, have: Callable[[str], bool], serve: Callable[[dict, str], list[tuple]]) -> list[tuple]:
    """Replies to waiters, first come, first served, each from the first of its keys that has elements; a reply may fill
    another key, so the round begins anew after each."""
    out: list[tuple] = []
    while True:
        ready = next(((k, w, key) for k, w in enumerate(held["waiters"]) for key in w["keys"] if have(key)), None)
        if ready is None:
            return out
        k, w, key = ready
        del held["waiters"][k]
        out += serve(w, key)


def blocking_lists(commands: DataFrame, timers: bool = True) -> DataFrame:
    """(grp, seq, op, conn, keys, value, target, side, to_side, n, now_ms, deadline_ms) -> (grp, conn, key, value) replies.

    Keys that one command names together share a group. op: LPUSH, RPUSH (the first of keys); BLPOP, BRPOP; BLMPOP of up to
    n elements from a side (L or R); BLMOVE from keys' side to target's to_side; BRPOPLPUSH. Values that are moved are
    replied and pushed, which may serve others that wait. A waiter whose deadline (0: never) has passed gets nulls.
    """
    late = _deadlines((None, None))

    def loaded(held: dict) -> None:
        held["lists"] = {k: deque(v) for k, v in held.get("lists", {}).items()}
        _waiting(held)

    def step(held: dict, r: Any) -> list[tuple]:
        lists, out = held["lists"], late(held, int(r.now_ms))

        def push(key: str, value: str, left: bool) -> None:
            items = lists.setdefault(key, deque())
            items.appendleft(value) if left else items.append(value)

        def serve(w: dict, key: str) -> list[tuple]:
            items = lists[key]
            taken = [items.pop() if w["tail"] else items.popleft() for _ in range(min(w["n"], len(items)))]
            if not items:
                del lists[key]
            if w["target"] is not None:
                push(w["target"], taken[0], w["to_head"])
            return [(w["conn"], key, v) for v in taken]

        keys = list(r.keys)
        if r.op in ("LPUSH", "RPUSH"):
            push(keys[0], r.value, r.op == "LPUSH")
        elif r.op in ("BLPOP", "BRPOP", "BLMPOP", "BLMOVE", "BRPOPLPUSH"):
            moves = r.op in ("BLMOVE", "BRPOPLPUSH")
            tail = r.op in ("BRPOP", "BRPOPLPUSH") or r.op in ("BLMPOP", "BLMOVE") and r.side == "R"
            _wait(held, {"conn": str(r.conn), "keys": keys, "tail": tail, "n": int(r.n) if r.op == "BLMPOP" else 1, "target": r.target if moves else None, "to_head": r.op == "BRPOPLPUSH" or r.to_side == "L", "deadline": int(r.deadline_ms)})
        else:
            raise ValueError(f"unknown command {r.op}")
        return out + _served(held, lambda k: k in lists, serve)

    return fold(commands, ["grp"], "grp string, conn string, key string, value string", step, late if timers else None, loaded)


def blocking_zsets(commands: DataFrame, timers: bool = True) -> DataFrame:
    """As blocking_lists for sorted sets: (grp, seq, op, conn, keys, member, score, side, n, now_ms, deadline_ms) -> (grp, conn,
    key, member, score). op: ZADD, BZPOPMIN, BZPOPMAX, BZMPOP of up to n members (side MIN or MAX)."""
    late = _deadlines((None, None, None))

    def loaded(held: dict) -> None:
        held["sets"] = {k: Scores(v) for k, v in held.get("sets", {}).items()}
        _waiting(held)

    def step(held: dict, r: Any) -> list[tuple]:
        sets, out = held["sets"], late(held, int(r.now_ms))

        def serve(w: dict, key: str) -> list[tuple]:
            taken = [(w["conn"], key, *sets[key].pop(w["high"])) for _ in range(min(w["n"], len(sets[key])))]
            if not sets[key]:
                del sets[key]
            return taken

        keys = list(r.keys)
        if r.op == "ZADD":
            sets.setdefault(keys[0], Scores()).put(r.member, float(r.score))
        elif r.op in ("BZPOPMIN", "BZPOPMAX", "BZMPOP"):
            high = r.op == "BZPOPMAX" or r.op == "BZMPOP" and r.side == "MAX"
            _wait(held, {"conn": str(r.conn), "keys": keys, "high": high, "n": int(r.n) if r.op == "BZMPOP" else 1, "deadline": int(r.deadline_ms)})
        else:
            raise ValueError(f"unknown command {r.op}")
        return out + _served(held, lambda k: k in sets, serve)

    return fold(commands, ["grp"], "grp string, conn string, key string, member string, score double", step, late if timers else None, loaded)


def consumer_group(commands: DataFrame) -> DataFrame:
    """(key, grp, seq, op, consumer, id_ms, id_seq, n, now_ms) -> (key, grp, seq, op, consumer, id_ms, id_seq, deliveries).

    op: ADD an entry; READ up to n new entries for a consumer; ACK an entry; CLAIM an entry idle for n ms; AUTOCLAIM every
    entry idle for n ms. Replies are the entries delivered, acknowledged or claimed.
    """

    def loaded(held: dict) -> None:
        held["fresh"] = deque(held.get("fresh", ()))
        held.setdefault("pending", {})

    def step(held: dict, r: Any) -> list[tuple]:
        fresh, pending = held["fresh"], held["pending"]
        now, at = int(r.now_ms), f"{int(r.id_ms)}-{int(r.id_seq)}"

        def row(name: str, who: str) -> tuple:
            ms, seq = map(int, name.split("-"))
            return (int(r.seq), r.op, who, ms, seq, pending[name][2] if name in pending else 0)

        if r.op == "ADD":
            if [int(r.id_ms), int(r.id_seq)] > held.get("last", [-1, -1]):
                held["last"] = [int(r.id_ms), int(r.id_seq)]
                fresh.append(at)
            return []
        if r.op == "READ":
            taken = [fresh.popleft() for _ in range(min(int(r.n), len(fresh)))]
            pending.update(dict.fromkeys(taken, [r.consumer, now, 1]))  # one list for all of them: it is never changed in place
            return [row(name, r.consumer) for name in taken]
        if r.op == "ACK":
            return [row(at, held_by[0])] if (held_by := pending.pop(at, None)) else []
        names = [at] if r.op == "CLAIM" else sorted(pending, key=lambda x: tuple(map(int, x.split("-"))))
        claimed = [x for x in names if x in pending and now - pending[x][1] >= int(r.n)]
        for name in claimed:
            pending[name] = [r.consumer, now, pending[name][2] + 1]
        return [row(name, r.consumer) for name in claimed]

    return fold(commands, ["key", "grp"], "key string, grp string, seq long, op string, consumer string, id_ms long, id_seq long, deliveries long", step, loaded=loaded)


def counters(log: DataFrame) -> DataFrame:
    """(key, by) -> running totals in update mode: plain streaming aggregation."""
    from pyspark.sql import functions as F

    return log.groupBy("key").agg(F.sum("by").alias("value"))
