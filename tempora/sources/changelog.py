"""A table as an append-only change log in Parquet: atomic commits, snapshots, differences and compaction.

A commit writes one segment folder and then creates the manifest of the next version, which must not exist yet: of two
writers that started from one version, one succeeds. Readers see only segments that a manifest names, so what a failed or
unfinished transaction wrote is never seen. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.operators import temporal


class ConflictError(RuntimeError):
    """Another transaction committed first."""


class PrunedError(RuntimeError):
    """A time before what the log was pruned to."""


class Files:
    """The few file operations a log needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = False) -> None:
        """Creates the file; without overwrite fails if it is there."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, overwrite)
        except Exception as e:
            raise ConflictError(path) from e
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Journal:
    """The commits of one database. A commit that changes several tables is one file, the intent, which must not exist yet; the tables'
    manifests follow from it, and whoever finds an intent finishes it first, so a commit is seen whole or not at all."""

    def __init__(self, files: Files, path: str):
        self.files, self.path = files, path

    def settle(self) -> None:
        """Finishes a commit that was left under way."""
        if self.files.exists(self.path):
            self._finish(json.loads(self.files.read(self.path)))

    def publish(self, parts: list[tuple[ChangeLog, dict, dict]]) -> None:
        """Commits (log, manifest it rests on, next manifest) of all tables, or raises ConflictError and commits none."""
        intent = [[log.place(old["version"] + 1), json.dumps(new | {"version": old["version"] + 1})] for log, old, new in parts]
        if not intent:
            return
        self.settle()
        self.files.write(self.path, json.dumps(intent))
        self._finish(intent)

    def _finish(self, intent: list[list[str]]) -> None:
        there = [self.files.exists(path) for path, _ in intent]
        late = [path for (path, text), t in zip(intent, there) if t and self.files.read(path) != text]
        if not late:
            for (path, text), t in zip(intent, there):
                if not t:
                    try:
                        self.files.write(path, text)
                    except ConflictError:  # another one finishes the same intent
                        pass
        self.files.delete(self.path)
        if late:
            raise ConflictError(f"{late[0]} was committed first")


class ChangeLog:
    """One table's log. A record: lsn, ts, txn, op (I, U, D), old and new row, user."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.row = spark, path, schema
        self.files = Files(spark)
        self.schema = T.StructType().add("lsn", "long").add("ts", "timestamp").add("txn", "long").add("op", "string").add("old", schema).add("new", schema).add("user", "string")

    # ---- versions

    def version(self) -> int:
        return max((int(n[1:-5]) for n in self.files.list(f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return json.loads(self.files.read(f"{self.path}/manifest/v{v:012d}.json")) if v else {"version": 0, "segments": [], "base": None, "lsn": 0}

    def place(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:012d}.json"

    def _publish(self, old: dict, new: dict) -> None:
        self.files.write(self.place(old["version"] + 1), json.dumps(new | {"version": old["version"] + 1}))

    def append(self, changes: DataFrame, txn: int, user: str, base: int | None = None, ts: int | None = None) -> int:
        """Commits changes (op, old, new) in the order of their column n, if any; returns their number. base: the version they rest on."""
        n, old, new = self.prepare(changes, txn, user, base, ts)
        if n:
            self._publish(old, new)
        return n

    def prepare(self, changes: DataFrame, txn: int, user: str, base: int | None = None, ts: int | None = None) -> tuple[int, dict, dict]:
        """Writes changes as a segment that no manifest names yet: (their number, the manifest they rest on, the one to publish)."""
        old = self.manifest()
        if base is not None and old["version"] != base:
            raise ConflictError(f"{self.path}: version {old['version']} instead of {base}")
        at = ts if ts is not None else max(time.time_ns() // 1000, old.get("ts", 0) + 1)
        first = old["lsn"] + 1
        order = F.col("n") if "n" in changes.columns else F.monotonically_increasing_id()
        rows = changes.select((F.lit(first) + order).alias("lsn"), F.timestamp_micros(F.lit(at)).alias("ts"), F.lit(txn).cast("long").alias("txn"), "op", F.col("old").cast(self.row).alias("old"), F.col("new").cast(self.row).alias("new"), F.lit(user).alias("user"))
        name = f"s{old['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/segments/{name}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/segments/{name}").agg(F.count(F.lit(1)), F.max("lsn")).first()
        return written[0], old, old | {"segments": [*old["segments"], {"name": name, "rows": written[0], "ts": at, "lsn": written[1]}], "lsn": written[1], "ts": at}

    # ---- reading

    def _segments(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/segments/{s['name']}" for s in segments))

    def log(self) -> DataFrame:
        """All committed records."""
        return self._segments(self.manifest()["segments"])

    def live(self, version: int | None = None) -> DataFrame:
        """The rows of the current or a given version: the last checkpoint's and the segments after it."""
        m = self.manifest(version)
        if m["base"] is None:
            return temporal.snapshot(self._segments(m["segments"]), self.row)
        after = self._segments([s for s in m["segments"] if s["lsn"] > m["base"]["lsn"]])
        return temporal.forward(self.spark.read.schema(self.row).parquet(f"{self.path}/base/{m['base']['name']}"), after)

    def as_of(self, us: int) -> DataFrame:
        """The rows at a time in microseconds, inclusive: forward from nothing, or back from the live rows, whichever reads less."""
        m = self.manifest()
        before = [s for s in m["segments"] if s["ts"] <= us]
        after = [s for s in m["segments"] if s["ts"] > us]
        self._reaches(m, us)
        if not after:
            return self.live()
        if "kept_from" not in m and sum(s["rows"] for s in before) < sum(s["rows"] for s in after):
            return temporal.snapshot(self._segments(before), self.row)
        return temporal.reverse(self.live(), self._segments(after))

    def diff(self, from_us: int, to_us: int) -> DataFrame:
        self._reaches(self.manifest(), from_us)
        return temporal.diff(self._segments([s for s in self.manifest()["segments"] if from_us < s["ts"] <= to_us]), self.row)

    def back(self, us: int) -> DataFrame:
        """The changes (op, old, new) that turn the live rows into those of a time."""
        self._reaches(self.manifest(), us)
        return self.undo(temporal.diff(self._segments([s for s in self.manifest()["segments"] if s["ts"] > us]), self.row))

    def undo(self, gone: DataFrame) -> DataFrame:
        """Changes that take back signed rows (column weight)."""
        w = F.col("weight")
        rows = gone.select(F.explode(F.sequence(F.lit(1), F.abs(w).cast("int"))), w.alias("w"), F.struct(*self.row.names).alias("r"))
        none = F.lit(None).cast(self.row)
        return rows.select(F.when(F.col("w") > 0, "D").otherwise("I").alias("op"), F.when(F.col("w") > 0, F.col("r")).otherwise(none).alias("old"), F.when(F.col("w") < 0, F.col("r")).otherwise(none).alias("new"))

    def recover(self, us: int, txn: int, user: str) -> int:
        """Appends what turns the live rows into those of a time; the log keeps everything."""
        return self.append(self.back(us), txn, user, self.version())

    def _reaches(self, manifest: dict, us: int) -> None:
        if us < manifest.get("kept_from", us):
            raise PrunedError(f"{self.path}: the log begins at {manifest['kept_from']}")

    def prune(self, us: int) -> int:
        """Drops the segments of a time and before; returns their number. The live rows become the base first, and times from us on are read back from
        them. A transaction that began on an older version can't read on."""
        gone = [s["name"] for s in self.manifest()["segments"] if s["ts"] <= us]
        if not gone:
            return 0
        self.checkpoint()
        m = self.manifest()
        self._publish(m, m | {"segments": [s for s in m["segments"] if s["ts"] > us or s["lsn"] > m["base"]["lsn"]], "kept_from": us})
        for name in gone:
            self.files.delete(f"{self.path}/segments/{name}")
        return len(gone)

    def checkpoint(self) -> None:
        """Writes the live rows as a base that later reads start from."""
        m = self.manifest()
        name = f"b{m['version']:012d}-{uuid.uuid4().hex[:8]}"
        self.live().write.parquet(f"{self.path}/base/{name}")
        self._publish(m, m | {"base": {"name": name, "lsn": m["lsn"]}})
