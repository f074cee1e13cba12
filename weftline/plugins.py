"""Plugins: engines, rule packs, formatters and commands, registered by name; results kept for a time; work after edits."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from weftline.operators.graph import shared_folder

KINDS = ("engine", "rule_pack", "formatter", "command")
VERSION = "0.1.0"


class PluginError(ValueError):
    pass


@dataclass
class Registry:
    """engine: DataFrame -> DataFrame; rule_pack: a list of rules as findings.LINE_RULES has them; formatter: rows -> str; command: any."""

    items: dict[tuple[str, str], object] = field(default_factory=dict)

    def add(self, kind: str, name: str, value: object, needs: str = "0.0.0") -> object:
        if kind not in KINDS:
            raise PluginError(f"unknown kind {kind!r}")
        if not re.fullmatch(r"[a-z][a-z0-9_-]*", name):
            raise PluginError(f"not a name: {name!r}")
        if kind == "rule_pack":
            if not all(len(r) == 5 and all(isinstance(x, str) for x in r) for r in value):
                raise PluginError("a rule has id, category, severity, pattern and message")
        elif not isinstance(value, Callable):
            raise PluginError(f"a {kind} is a function")
        if tuple(map(int, needs.split("."))) > tuple(map(int, VERSION.split("."))):
            raise PluginError(f"needs version {needs}")
        self.items[kind, name] = value
        return value

    def get(self, kind: str, name: str) -> object:
        try:
            return self.items[kind, name]
        except KeyError:
            raise PluginError(f"no {kind} {name!r}") from None

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.items if k == kind)

    def load(self, folder: str) -> list[str]:
        """Add the rule packs whose manifests (``*.json``: name, kind, needs, rules with the five fields by name) stand in a folder; names of
        those added. Code is never loaded from files."""
        added = []
        for path in sorted(Path(folder).glob("*.json")):
            try:
                manifest = json.loads(path.read_text())
                if manifest.get("kind") != "rule_pack":
                    raise PluginError(f"{path.name}: only rule packs are loaded from files")
                rules = [tuple(r[f] for f in ("id", "category", "severity", "pattern", "message")) for r in manifest["rules"]]
                self.add("rule_pack", manifest["name"], rules, manifest.get("needs", "0.0.0"))
            except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
                raise PluginError(f"{path.name}: {e}") from e
            added.append(manifest["name"])
        return added

    def rules(self) -> list[tuple]:
        return [r for n in self.names("rule_pack") for r in self.items["rule_pack", n]]


@dataclass
class Engine:
    """An analysis in three steps, each a function of DataFrames: which files it reads, what it finds in them, what it makes of that."""

    name: str
    analyse: Callable[[DataFrame], DataFrame]
    select: Callable[[DataFrame], DataFrame] = lambda files: files
    build: Callable[[DataFrame], DataFrame] = lambda found: found

    def run(self, files: DataFrame) -> DataFrame:
        return self.build(self.analyse(self.select(files)))


@dataclass
class ResultCache:
    """Results of commands for a time: each is written once to the session's shared folder and read from there until its time is over.

    clock gives seconds. Entries are dropped by prefix of their key, or when they are asked for too late; files go with them.
    """

    spark: SparkSession
    seconds: float = 300
    clock: Callable[[], float] = time.monotonic
    entries: dict[str, tuple[float, str, StructType]] = field(default_factory=dict)

    def get(self, key: str, make: Callable[[], DataFrame], seconds: float | None = None) -> DataFrame:
        known = self.entries.get(key)
        if known is None or self.clock() >= known[0]:
            self.drop(key)
            df = make()
            path = f"{shared_folder(self.spark)}/result-{uuid.uuid4().hex}"
            df.write.parquet(path)
            known = self.entries[key] = self.clock() + (self.seconds if seconds is None else seconds), path, df.schema
        return self.spark.read.schema(known[2]).parquet(known[1])

    def drop(self, prefix: str = "") -> int:
        """Forget the entries whose key begins so; how many there were."""
        gone = [k for k in self.entries if k.startswith(prefix)]
        for k in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.entries.pop(k)[1])
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return len(gone)


class EditHook:
    """Runs ``refresh`` for edited files in the background, two at a time; a file that is waiting isn't queued again."""

    def __init__(self, refresh: Callable[[str], object], workers: int = 2):
        self.refresh, self.pool, self.waiting, self.lock = refresh, ThreadPoolExecutor(workers), {}, threading.Lock()

    def edited(self, path: str) -> Future:
        with self.lock:
            if path not in self.waiting or self.waiting[path].running() or self.waiting[path].done():
                self.waiting[path] = self.pool.submit(self.refresh, path)
            return self.waiting[path]

    def close(self) -> None:
        self.pool.shutdown(wait=True)
