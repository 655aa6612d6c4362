"""A store over a mutation log: the programmatic surface and the commands."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import CommandError, check_key, check_value, glob_to_regex
from tidelog.operators import compact, layout, metrics, scan, state

SCHEMA = "key string, seq long, tombstone boolean, value string"

#: Commands with the number of words each takes, its own name included; negative: at least.
ARITY = {
    "ping": -1, "echo": 2, "set": -3, "get": 2, "del": -2, "exists": -2, "scan": -2, "dbsize": 1,
    "info": -1, "compact": 1, "flushdb": 1, "command": -1, "quit": 1, "hello": -1, "select": 2, "shutdown": -1,
}


@dataclass
class Store:
    """Analytics over a log; writes append to it. For bulk loads use state.put and sources.log.append, not single writes."""

    spark: SparkSession
    log: DataFrame = None
    options: compact.Options = field(default_factory=compact.Options)
    _pending: list = field(default_factory=list)
    _next: int = 0

    def __post_init__(self) -> None:
        if self.log is None:
            self.log = self.spark.createDataFrame([], SCHEMA)
        self._next = self.log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self._settle_pending()

    def _settle_pending(self) -> DataFrame:
        if self._pending:
            rows = self.spark.createDataFrame(self._pending, SCHEMA)
            self.log = self.log.select("key", "seq", "tombstone", "value").unionByName(rows)
            self._pending = []
        return self.log

    def put(self, key: str, value: str) -> None:
        check_key(key)
        check_value(value)
        self._pending.append((key, self._next, False, value))
        self._next += 1

    def get(self, key: str) -> str | None:
        check_key(key)
        row = state.get(self._settle_pending(), key).select("value").first()
        return row and row.value

    def delete(self, key: str) -> bool:
        """Whether the key was alive; a tombstone is written either way."""
        existed = self.get(key) is not None
        self._pending.append((key, self._next, True, None))
        self._next += 1
        return existed

    def scan(self, cursor: str | None = None, count: int = scan.DEFAULT_COUNT, pattern: str | None = None) -> scan.Page:
        return scan.read_page(self._settle_pending(), cursor, count, pattern)

    def count(self) -> int:
        return state.dbsize(self._settle_pending()).first().n

    def truncate(self) -> None:
        self._settle_pending()
        self.log = state.truncate(self.log)

    def settle(self) -> None:
        """Compacts the whole log to its live state, as nothing lies below it."""
        self.log = state.live(self._settle_pending()).select("key", "seq", "tombstone", "value")

    def stats(self) -> DataFrame:
        log = self._settle_pending().withColumn("file_number", F.lit(1).cast("long")).withColumn("level", F.lit(0))
        return metrics.info(log, layout.file_metadata(log), self.options)


class Session:
    """One client's commands: names in any case, arity checked first, keys validated before any is used."""

    def __init__(self, store: Store):
        self.store = store
        self.tokens: dict[int, str] = {}

    def run(self, line: str | list[str]) -> Any:
        words = shlex.split(line) if isinstance(line, str) else line
        name, args = words[0].lower(), words[1:]
        if name not in ARITY:
            raise CommandError(f"ERR unknown command '{words[0]}', with args beginning with: {' '.join(repr(a) for a in args)}")
        n = ARITY[name]
        if (n > 0 and len(words) != n) or len(words) < -n or (name == "ping" and len(args) > 1):
            raise CommandError(f"ERR wrong number of arguments for '{name}' command")
        return getattr(self, f"_{name}")(*args)

    def _ping(self, message: str = "PONG") -> str:
        return message

    def _echo(self, message: str) -> str:
        return message

    def _set(self, key: str, value: str, *options: str) -> str:
        if options:
            raise CommandError("ERR syntax error")
        self.store.put(key, value)
        return "OK"

    def _get(self, key: str) -> str | None:
        return self.store.get(key)

    def _del(self, *keys: str) -> int:
        for k in keys:
            check_key(k)
        return sum(self.store.delete(k) for k in keys)

    def _exists(self, *keys: str) -> int:
        for k in keys:
            check_key(k)
        rows = self.store.spark.createDataFrame([(k,) for k in keys], "key string")
        return state.exists(self.store._settle_pending(), rows).first().n

    def _scan(self, cursor: str, *options: str) -> tuple[int, list[str]]:
        if not cursor.isdigit():
            raise CommandError("ERR invalid cursor")
        if len(options) % 2:
            raise CommandError("ERR syntax error")
        pattern, count = None, scan.DEFAULT_COUNT
        for name, value in zip(options[::2], options[1::2], strict=True):
            if name.lower() == "match":
                pattern = value
                glob_to_regex(pattern)
            elif name.lower() == "count":
                if not value.lstrip("+").isdigit() or int(value) < 1:
                    raise CommandError("ERR value is not an integer or out of range")
                count = int(value)
            else:
                raise CommandError("ERR syntax error")
        if cursor == "0":
            self.tokens.clear()
        page = self.store.scan(self.tokens.get(int(cursor)), count, pattern)
        token = 0
        if page.cursor is not None:
            token = len(self.tokens) + 1
            self.tokens[token] = page.cursor
        return token, page.keys

    def _dbsize(self) -> int:
        return self.store.count()

    def _info(self, section: str = "") -> str:
        rows = self.store.stats().orderBy("section", "name").collect()
        return "\n".join(f"{r.section}.{r.name}:{r.value:g}" for r in rows)

    def _compact(self) -> str:
        self.store.settle()
        return "OK"

    def _flushdb(self) -> str:
        self.store.truncate()
        return "OK"

    def _command(self, *_: str) -> list:
        return []

    def _quit(self) -> str:
        self.store.close()
        return "OK"

    def _hello(self, *_: str) -> None:
        raise CommandError("NOPROTO unsupported protocol version")

    def _select(self, db: str) -> str:
        if db != "0":
            raise CommandError("ERR DB index is out of range")
        return "OK"

    def _shutdown(self, *_: str) -> None:
        raise CommandError("ERR shutdown is not allowed")
