"""Which function serves which command. Most are found by rule: the command's family names the module, its name in
lower case the function; ALIASES holds the rest."""

from __future__ import annotations

from collections.abc import Callable

from keyloom.operators import bitmaps, control, entries, geo, hashes, json_docs, keys, lists, pubsub, reports, sets, sketches, strings, zsets
from keyloom.session import Session
from keyloom.sources import snapshots
from keyloom.streaming import stateful

PREFIXES = {"JSON.": (json_docs, ""), "BF.": (sketches, "bloom_"), "CF.": (sketches, "cuckoo_"), "CMS.": (sketches, "cms_"), "TOPK.": (sketches, "topk_"), "CL.": (strings, "")}
MODULES = (zsets, sets, hashes, lists, strings, bitmaps, geo, entries, keys, sketches, pubsub, reports, control, snapshots, Session)

ALIASES: dict[str, Callable] = {
    # strings
    "SET": strings.set_, "SETEX": strings.set_, "PSETEX": strings.set_, "MSET": strings.set_, "SUBSTR": strings.substring_bytes,
    "GETRANGE": strings.substring_bytes, "SETRANGE": strings.overwritten, "PREPEND": strings.append, "INCR": strings.incrby,
    "DECR": strings.incrby, "DECRBY": strings.incrby,
    # bitmaps and geo
    "BITFIELD": bitmaps.bitfield_all, "GEORADIUS": geo.geosearch, "GEORADIUS_RO": geo.geosearch,
    "GEORADIUSBYMEMBER": geo.georadiusbymember, "GEORADIUSBYMEMBER_RO": geo.georadiusbymember,
    # sketches
    "BF.RESERVE": sketches.bloom_dims, "BF.MADD": sketches.bloom_add, "BF.MEXISTS": sketches.bloom_exists,
    "CMS.INITBYDIM": sketches.cms_incrby,
    "CMS.INITBYPROB": sketches.cms_dims, "TOPK.ADD": sketches.topk_fold, "TOPK.INCRBY": sketches.topk_fold,
    # JSON
    "JSON.FORGET": json_docs.delete, "JSON.DEL": json_docs.delete, "JSON.SET": json_docs.set_, "JSON.TYPE": json_docs.type_,
    "JSON.DEBUG": json_docs.debug_fields,
    # keys
    "DEL": keys.delete, "UNLINK": keys.delete, "PEXPIRE": keys.expire, "EXPIREAT": keys.expire, "PEXPIREAT": keys.expire,
    "TYPE": keys.type_of, "KEYS": keys.matching, "RENAMENX": keys.rename, "SORT_RO": keys.sort,
    # lists
    "LPUSH": lists.push, "RPUSH": lists.push, "LPUSHX": lists.push, "RPUSHX": lists.push, "LPOP": lists.pop, "RPOP": lists.pop,
    "RPOPLPUSH": lists.lmove, "BLPOP": stateful.blocking_queue, "BRPOP": stateful.blocking_queue, "BLMOVE": stateful.blocking_lists,
    "BRPOPLPUSH": stateful.blocking_lists, "BLMPOP": stateful.blocking_lists,
    # hashes and sets
    "HMSET": hashes.hset, "SISMEMBER": sets.smismember, "SINTERSTORE": sets.sstore, "SUNIONSTORE": sets.sstore, "SDIFFSTORE": sets.sstore,
    # sorted sets
    "ZREVRANK": zsets.zrank, "ZREVRANGE": zsets.zrange, "ZRANGESTORE": zsets.zstore, "ZUNION": zsets.zcombine, "ZINTER": zsets.zcombine,
    "ZUNIONSTORE": zsets.zstore, "ZINTERSTORE": zsets.zstore, "ZDIFFSTORE": zsets.zstore, "ZREVRANGEBYSCORE": zsets.zrangebyscore,
    "ZREVRANGEBYLEX": zsets.zrangebylex, "ZREMRANGEBYSCORE": zsets.zremrange, "ZREMRANGEBYLEX": zsets.zremrange,
    "ZPOPMIN": zsets.zpop, "ZPOPMAX": zsets.zpop, "ZLEXCOUNT": zsets.zcount, "BZMPOP": stateful.blocking_zsets,
    "BZPOPMIN": stateful.blocking_scores, "BZPOPMAX": stateful.blocking_scores,
    # streams
    "XREVRANGE": entries.xrange, "XTRIM": entries.xtrim_maxlen, "XGROUP": entries.xgroup_create, "XINFO": entries.xinfo_stream,
    # publish and subscribe
    "PUBLISH": pubsub.publish_replies, "SPUBLISH": pubsub.publish_replies, "SSUBSCRIBE": pubsub.subscribe,
    "SUNSUBSCRIBE": pubsub.unsubscribe, "PSUBSCRIBE": pubsub.pattern_fanout, "PUNSUBSCRIBE": pubsub.punsubscribe, "PUBSUB": pubsub.numsub,
    # server
    "ECHO": Session.ping, "COMMAND": reports.command_stats, "INFO": reports.keyspace, "CONFIG": Session.config_get, "CLIENT": Session.client,
    "MEMORY": reports.memory_usage, "DEBUG": reports.unique_strings, "BGSAVE": snapshots.save, "MONITOR": Session.command_log,
    "SHUTDOWN": snapshots.save, "MODULE": control.module_list, "FUNCTION": Session.function_load, "SCRIPT": Session.script_load,
    "EVAL_RO": Session.eval, "EVALSHA_RO": Session.evalsha, "FCALL_RO": Session.fcall, "QUIT": control.quit_,
    "REPLCONF": control.replication, "REPLICAOF": control.replication, "SLAVEOF": control.replication, "DFLY": control.replication,
    "SLOWLOG": reports.slowlog,
}


def resolve(command: str) -> Callable:
    """The function that serves a command; KeyError if there is none."""
    name = command.upper()
    if name in ALIASES:
        return ALIASES[name]
    for prefix, (module, stem) in PREFIXES.items():
        if name.startswith(prefix):
            found = getattr(module, stem + name.removeprefix(prefix).lower(), None)
            if found is None:
                raise KeyError(command)
            return found
    for module in MODULES:
        found = module.__dict__.get(name.lower())
        if callable(found):
            return found
    raise KeyError(command)
