"""Named, versioned tables of a working session in the Spark catalog."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: The property of a table that names what it was made from.
SOURCES = "made_from"


class Session:
    """A namespace of tables; names of any characters map to safe ones that cannot collide."""

    def __init__(self, spark: SparkSession, name: str):
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError("a session name has letters, digits, _ and - only")
        self.spark, self.space = spark, "session_" + self._safe(name)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.space}")

    @staticmethod
    def _safe(name: str) -> str:
        return f"{re.sub('[^a-z0-9]', '_', name.lower())[:60]}_{hashlib.sha256(name.encode()).hexdigest()[:10]}"

    def _full(self, name: str) -> str:
        return f"{self.space}.{self._safe(name)}"

    def save(self, name: str, df: DataFrame, made_from: Iterable[str] = ()) -> DataFrame:
        """Write a table. made_from names the tables it is made from; invalidate() follows them."""
        made_from = [*made_from]
        if missing := [n for n in made_from if not self.exists(n)]:
            raise KeyError(f"no such tables: {missing}")
        quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        df.write.mode("overwrite").option("comment", name).saveAsTable(self._full(name))
        self.spark.sql(f"COMMENT ON TABLE {self._full(name)} IS {quoted(name)}")
        self.spark.sql(f"ALTER TABLE {self._full(name)} SET TBLPROPERTIES ({quoted(SOURCES)} = {quoted(json.dumps(made_from))})")
        return self.spark.table(self._full(name))

    def sources(self, name: str) -> list[str]:
        """The tables that a table was made from."""
        found = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._full(name)}").collect()}
        return json.loads(found.get(SOURCES, "[]"))

    def downstream(self, *names: str) -> list[str]:
        """All tables made from the named ones, directly or through others; each once, before what it is made from."""
        made = {n: self.sources(n) for n in self.names()}
        found: list[str] = []
        asked = [*names]
        while asked:
            asked = [n for n, of in made.items() if n not in found and n not in names and any(x in asked for x in of)]
            found += asked
        return found[::-1]

    def invalidate(self, *names: str, keep: bool = True) -> list[str]:
        """Drop what was made from the named tables, and with keep=False those too; all or nothing. What was dropped."""
        if missing := [n for n in names if not self.exists(n)]:
            raise KeyError(f"no such tables: {missing}")
        gone = self.downstream(*names) + ([] if keep else [*names])
        self.drop(*gone)
        return gone

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._full(name))

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._full(name))

    def names(self) -> list[str]:
        return sorted(t.description or t.name for t in self.spark.catalog.listTables(self.space) if not t.isTemporary)

    def drop(self, *names: str) -> None:
        """All or nothing: an unknown name drops none."""
        if missing := [n for n in names if not self.exists(n)]:
            raise KeyError(f"no such tables: {missing}")
        for n in names:
            self.spark.sql(f"DROP TABLE {self._full(n)}")

    def save_version(self, name: str, df: DataFrame) -> int:
        version = max(self.versions(name), default=0) + 1
        self.save(f"{name}@{version}", df)
        return version

    def versions(self, name: str) -> list[int]:
        return sorted(int(n.rpartition("@")[2]) for n in self.names() if n.startswith(f"{name}@"))

    def drop_version(self, name: str, version: int) -> None:
        """The version goes; `latest` is then the largest that is left."""
        self.drop(f"{name}@{version}")

    def latest(self, name: str) -> DataFrame:
        return self.read(f"{name}@{max(self.versions(name))}")

    def group_schema(self, prefixes: tuple[str, ...] = ("appended__", "hn__"), most: int = 60) -> list[dict]:
        """What is known of the session's groups, recovered from its tables: rows and columns of each, the largest first."""
        found = []
        for name in (n for n in self.names() if n.startswith(prefixes)):
            df = self.read(name)
            preview = ", ".join(df.columns[:most]) + (" ..." if len(df.columns) > most else "")
            found.append({"group": name, "rows": df.count(), "columns": df.columns, "preview": preview})
        return sorted(found, key=lambda g: (-g["rows"], g["group"]))

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.space} CASCADE")
