"""What remains of the server's commands once there is no server: metadata, settings, sessions."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: Families of operators and their modules.
FAMILIES = {
    "strings": "strings", "hashes": "hashes", "sets": "sets", "sorted sets": "zsets", "lists": "lists", "streams": "streams", "sketches": "hll",
    "json": "json_docs", "protobuf": "proto", "budgets": "budgets", "keyspace": "keyspace", "pubsub": "pubsub", "scripts": "scripts", "merge": "merge",
    "snapshots": "snapshot", "replicas": "replicas", "transactions": "transactions",
}


#: Commands by module that the function of their own name answers.
OWN = {
    "strings": (
        "GET", "SETNX", "SETEX", "GETSET", "GETDEL", "GETEX", "APPEND", "STRLEN", "INCRBY", "INCRBYFLOAT", "MGET", "MSETNX", "SETRANGE", "GETRANGE",
    ),
    "hashes": (
        "HSET", "HSETNX", "HGET", "HMGET", "HGETALL", "HDEL", "HGETDEL", "HEXPIRE", "HTTL", "HPERSIST", "HGETEX", "HSETEX", "HEXISTS", "HLEN", "HKEYS",
        "HVALS", "HSTRLEN", "HINCRBY", "HINCRBYFLOAT", "HRANDFIELD", "HSCAN",
    ),
    "sets": (
        "SADD", "SREM", "SCARD", "SMISMEMBER", "SMEMBERS", "SPOP", "SRANDMEMBER", "SSCAN", "SMOVE", "SUNION", "SINTER", "SDIFF", "SINTERCARD",
    ),
    "zsets": (
        "ZADD", "ZMSCORE", "ZCARD", "ZINCRBY", "ZREM", "ZRANGE", "ZRANGEBYSCORE", "ZRANK", "ZCOUNT", "ZLEXCOUNT", "ZMPOP", "ZRANDMEMBER", "ZRANGEBYLEX",
        "ZREMRANGEBYRANK", "ZUNION", "ZINTER", "ZDIFF", "ZINTERCARD", "ZSCAN",
    ),
    "lists": (
        "LLEN", "LRANGE", "LINDEX", "LSET", "LREM", "LTRIM", "LINSERT", "LPOS", "LMOVE", "LMPOP",
    ),
    "streams": (
        "XADD", "XLEN", "XRANGE", "XREAD", "XDEL", "XTRIM", "XSETID", "XINFO",
    ),
    "hll": (
        "PFADD", "PFCOUNT", "PFMERGE",
    ),
    "keyspace": (
        "EXISTS", "TTL", "EXPIRE", "PERSIST", "KEYS", "SCAN", "RANDOMKEY", "RENAME", "COPY", "DBSIZE", "FLUSHALL", "INFO",
    ),
    "server": (
        "PING", "COMMAND", "TIME",
    ),
    "live": (
        "SUBSCRIBE", "PSUBSCRIBE",
    ),
}
#: Commands by module that another function answers.
OTHER = {
    "strings": {
        "SET": "set_values", "PSETEX": "setex", "INCR": "incrby", "DECR": "incrby", "DECRBY": "incrby", "MSET": "set_values", "SUBSTR": "getrange",
    },
    "hashes": {
        "HMSET": "hset", "HPEXPIRE": "hexpire", "HEXPIREAT": "hexpire", "HPEXPIREAT": "hexpire", "HPTTL": "httl", "HEXPIRETIME": "httl",
        "HPEXPIRETIME": "httl",
    },
    "sets": {
        "SISMEMBER": "smismember", "SUNIONSTORE": "store", "SINTERSTORE": "store", "SDIFFSTORE": "store",
    },
    "zsets": {
        "ZSCORE": "zmscore", "ZREVRANGEBYSCORE": "zrangebyscore", "ZREVRANGE": "zrange", "ZREVRANK": "zrank", "ZPOPMIN": "zpop", "ZPOPMAX": "zpop",
        "ZRANGESTORE": "store", "ZREVRANGEBYLEX": "zrangebylex", "ZREMRANGEBYSCORE": "zremrange", "ZREMRANGEBYLEX": "zremrange", "ZUNIONSTORE": "store",
        "ZINTERSTORE": "store", "ZDIFFSTORE": "store",
    },
    "lists": {
        "LPUSH": "push", "RPUSH": "push", "LPUSHX": "push", "RPUSHX": "push", "LPOP": "pop", "RPOP": "pop", "RPOPLPUSH": "lmove",
    },
    "streams": {
        "XREVRANGE": "xrange",
    },
    "json_docs": {
        "JSON.SET": "edit", "JSON.GET": "json_get", "JSON.MGET": "mget", "JSON.MSET": "mset", "JSON.DEL": "delete", "JSON.FORGET": "delete",
        "JSON.TYPE": "type_of", "JSON.NUMINCRBY": "numincrby", "JSON.NUMMULTBY": "numincrby", "JSON.STRAPPEND": "strappend", "JSON.STRLEN": "strlen",
        "JSON.ARRAPPEND": "arrappend", "JSON.ARRINDEX": "arrindex", "JSON.ARRINSERT": "arrinsert", "JSON.ARRLEN": "arrlen", "JSON.ARRPOP": "arrpop",
        "JSON.ARRTRIM": "arrtrim", "JSON.OBJKEYS": "objkeys", "JSON.OBJLEN": "objlen", "JSON.TOGGLE": "toggle", "JSON.CLEAR": "clear",
        "JSON.MERGE": "merge", "JSON.RESP": "resp_text", "JSON.DEBUG": "debug_memory",
    },
    "proto": {
        "PROTO.SCHEMA": "Registry", "PROTO.BIND": "Registry", "PROTO.UNBIND": "Registry", "PROTO.BINDINGS": "Registry", "PROTO.SET": "validate",
        "PROTO.GET": "get", "PROTO.INFO": "info", "PROTO.GETJSON": "get_json", "PROTO.SETJSON": "set_json", "PROTO.GETFIELD": "get_field",
        "PROTO.SETFIELD": "set_fields", "PROTO.CLEARFIELD": "clear_fields", "PROTO.HSET": "hset", "PROTO.SADD": "sadd", "PROTO.HGETJSON": "get_json",
        "PROTO.HGETFIELD": "get_field",
    },
    "budgets": {
        "BG.CREATE": "create", "BG.TOPUP": "topup", "BG.RESERVE": "reserve", "BG.COMMIT": "settle", "BG.RELEASE": "settle", "BG.DRAW": "draw",
        "BG.INFO": "info", "BG.RECLAIM": "reclaim",
    },
    "keyspace": {
        "DEL": "delete", "UNLINK": "delete", "TYPE": "type_of", "PTTL": "ttl", "EXPIREMEMBER": "expire_members", "EXPIREMEMBERAT": "expire_members",
        "PEXPIREMEMBERAT": "expire_members", "PEXPIRE": "expire", "EXPIREAT": "expire", "PEXPIREAT": "expire", "EXPIRETIME": "ttl",
        "PEXPIRETIME": "ttl", "RENAMENX": "rename", "OBJECT": "object_encoding", "TOUCH": "exists", "FLUSHDB": "flushall", "CLUSTER": "slots",
    },
    "scripts": {
        "EVAL": "evaluate", "EVALSHA": "ScriptRegistry", "SCRIPT": "ScriptRegistry",
    },
    "pubsub": {
        "PUBLISH": "receivers", "PUBSUB": "channels",
    },
    "server": {
        "ECHO": "ping", "CONFIG": "Settings",
    },
    "live": {
        "UNSUBSCRIBE": "subscribe", "PUNSUBSCRIBE": "psubscribe", "BLPOP": "blocking_pop", "BRPOP": "blocking_pop", "BLMPOP": "blocking_pop",
        "BLMOVE": "blocking_move", "BRPOPLPUSH": "blocking_move", "BZPOPMIN": "blocking_zpop", "BZPOPMAX": "blocking_zpop", "BZMPOP": "blocking_zpop",
        "REPLICAOF": "merge_into_table", "SLAVEOF": "merge_into_table",
    },
    "transactions": {
        "MULTI": "executed", "EXEC": "executed", "DISCARD": "executed",
    },
    "merge": {
        "DEBUG": "counter_state",
    },
}


def answered_by(command: str):
    """The function or class that answers a command; KeyError for one that has no place here."""
    import importlib

    name = command.upper()
    for module in {**OWN, **OTHER}:
        function = OTHER.get(module, {}).get(name, name.lower() if name in OWN.get(module, ()) else None)
        if function:
            return getattr(importlib.import_module(f"keyloom.{'streaming' if module == 'live' else 'operators'}.{module}"), function)
    raise KeyError(command)


@dataclass
class Settings:
    """CONFIG GET and SET; unknown names are refused."""

    script_limit_ms: int = 20
    loglevel: str = "WARN"
    budget_token_ttl_ms: int = 60_000
    gc_grace_ms: int = 3_600_000

    def get(self, name: str):
        return asdict(self)[name]

    def set(self, name: str, value) -> None:
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if name not in kinds:
            raise KeyError(f"unknown setting: {name}")
        setattr(self, name, kinds[name](value))


def command(spark: SparkSession) -> DataFrame:
    """COMMAND: (family, operator, arity) of every public operator of this package."""
    import importlib
    import inspect

    rows = []
    for family, module in FAMILIES.items():
        found = importlib.import_module(f"keyloom.operators.{module}")
        for name, f in sorted(vars(found).items()):
            if inspect.isfunction(f) and not name.startswith("_") and f.__module__ == found.__name__:
                rows.append((family, name, len(inspect.signature(f).parameters)))
    return spark.createDataFrame(rows, "family string, operator string, arity int")


def ping(spark: SparkSession, message: str = "PONG") -> DataFrame:
    return spark.createDataFrame([(message,)], "reply string")


def time(now_ms: int) -> tuple[int, int]:
    """Seconds and microseconds of a given moment."""
    return now_ms // 1000, now_ms % 1000 * 1000
