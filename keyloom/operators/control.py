"""Control commands that compute nothing over data: fixed replies, and refusals where an engine without connections or
replicas has nothing to do."""

from __future__ import annotations

from typing import NoReturn


class Unsupported(NotImplementedError):
    """A command that only makes sense for a network server."""


def _refuse(what: str) -> NoReturn:
    raise Unsupported(what)


def auth(*_: str) -> str:
    return "OK"


def hello(version: int = 2) -> dict[str, object]:
    if version not in (2, 3):
        raise ValueError("NOPROTO unsupported protocol version")
    return {"server": "keyloom", "version": "1", "proto": version, "id": 1, "mode": "standalone", "role": "master"}


def role() -> tuple[str, list]:
    return "master", []


def wait(replicas: int, timeout_ms: int) -> int:
    return 0


def latency(*_: str) -> list:
    return []


def module_list() -> list:
    return []


def shrink(kind: str | None) -> int | None:
    if kind is None:
        return None
    if kind in ("set", "hash"):
        return 0
    raise TypeError("WRONGTYPE Operation against a key holding the wrong kind of value")


def repltakeover(seconds: int, *_: str) -> str:
    if seconds < 0:
        raise ValueError("timeout is negative")
    return "OK"


def gat(*_: object) -> NoReturn:
    _refuse("GAT belongs to another protocol")


def replication(*_: object) -> NoReturn:
    _refuse("replicas read the command log as a stream; see keyloom.streaming")


def addreplicaof(*_: object) -> NoReturn:
    _refuse("ADDREPLICAOF is not supported")


def quit_(*_: object) -> str:
    return "OK"
