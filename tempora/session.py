"""A session: statements in, DataFrames or messages out. Catalog, users, transactions, constraints and time travel."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.dialect.lexer import DialectError
from tempora.dialect.parser import ColumnDef, Command, CreateTable, Delete, ForeignKey, Insert, Parser, Select, Update, parse
from tempora.functions.scalar import SPARK_TYPES, as_of_micros, coerce
from tempora.operators import analytics, constraints, learning
from tempora.plans.lower import column, lower, predicate
from tempora.sources.changelog import ChangeLog, ConflictError, Files, Journal

#: What each role may do.
RIGHTS = {"SUPERADMIN": {"read", "write", "define", "admin"}, "ADMIN": {"read", "write", "define"}, "NORMAL": {"read", "write"}, "READONLY": {"read"}, "DENIED": set()}
#: The right that commands ask for, beside those that ask on their own.
ASKED = {"BEGIN": "write", "COMMIT": "write", "ROLLBACK": "write", "CHECKPOINT": "define", "SHOW USER": "admin"}
RESERVED = ("system",)


class SessionError(RuntimeError):
    """A statement that cannot be carried out."""


@dataclass
class Result:
    message: str = ""
    data: DataFrame | None = None
    count: int = 0
    success: bool = True


@dataclass
class _Txn:
    number: int
    base: dict[str, int] = field(default_factory=dict)
    changes: dict[str, DataFrame] = field(default_factory=dict)


class Session:
    def __init__(self, spark: SparkSession, root: str, user: str = "root", password: str | None = None, database: str = "main"):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.user, self.database, self.txn, self.running = user, database, None, True
        self.before: list[Callable[[str, str, str], bool]] = []
        self.after: list[Callable[[str, str, int], None]] = []
        self.external: dict[str, DataFrame] = {}
        self.learned = learning.Bandit()
        if not self.files.exists(self._users_path()):
            self._save_users({"root": {"hash": _hash("root", password or "root"), "roles": {"*": "SUPERADMIN"}}})
        if database not in self.databases():
            self.files.write(f"{self.root}/{database}/catalog.json", json.dumps({}), True)
        if self.files.exists(self._learned_path()):
            self.learned = learning.Bandit.loads(self.files.read(self._learned_path()))

    # ---- catalog

    def _users_path(self) -> str:
        return f"{self.root}/_users.json"

    def _learned_path(self) -> str:
        return f"{self.root}/_learned.json"

    def _users(self) -> dict:
        return json.loads(self.files.read(self._users_path()))

    def _save_users(self, users: dict) -> None:
        self.files.write(self._users_path(), json.dumps(users), True)

    def databases(self) -> list[str]:
        return [n for n in self.files.list(self.root) if not n.startswith("_") and self.files.exists(f"{self.root}/{n}/catalog.json")]

    def catalog(self) -> dict[str, dict]:
        return json.loads(self.files.read(f"{self.root}/{self.database}/catalog.json"))

    def _save_catalog(self, c: dict) -> None:
        self.files.write(f"{self.root}/{self.database}/catalog.json", json.dumps(c), True)

    def definition(self, table: str) -> CreateTable:
        c = self.catalog()
        if table not in c:
            raise SessionError(f"no table {table!r}")
        d = c[table]
        return CreateTable(table, [ColumnDef(**x) for x in d["columns"]], [ForeignKey(**x) for x in d["foreign"]], d["checks"])

    def log_of(self, table: str) -> ChangeLog:
        d = self.definition(table)
        schema = T.StructType([T.StructField(c.name, SPARK_TYPES[c.type]) for c in d.columns])
        return ChangeLog(self.spark, f"{self.root}/{self.database}/{self.catalog()[table]['folder']}", schema)

    def table(self, name: str, as_of: int | None = None) -> DataFrame:
        """A table's rows now, with the open transaction's changes, or at a time in microseconds."""
        if name in self.external:
            return self.external[name]
        self._journal().settle()
        log = self.log_of(name)
        if as_of is not None:
            return self._past(name, as_of)
        rows = log.live(self.txn.base.setdefault(name, log.version()) if self.txn else None)  # a transaction reads one version of a table
        if self.txn and name in self.txn.changes:
            from tempora.operators.temporal import forward

            rows = forward(rows, self.txn.changes[name])
        return rows

    def _journal(self) -> Journal:
        return Journal(self.files, f"{self.root}/{self.database}/intent.json")

    def _past(self, name: str, us: int) -> DataFrame:
        """A table's rows at a time, in its present columns: times before an ALTER are read from the log of then."""
        past = [h for h in self.catalog()[name].get("history", []) if us < h["until"]]
        if not past:
            return self.log_of(name).as_of(us)
        schema = T.StructType([T.StructField(c["name"], SPARK_TYPES[c["type"]]) for c in past[0]["columns"]])
        rows = ChangeLog(self.spark, f"{self.root}/{self.database}/{past[0]['folder']}", schema).as_of(us)
        for h in past:
            rows = self._altered(rows, *h["change"])
        return rows

    def _altered(self, rows: DataFrame, kind: str, column: str, to: str | None, default) -> DataFrame:
        if kind == "ALTER ADD":
            return rows.withColumn(column, F.lit(coerce(default, to)).cast(SPARK_TYPES[to]))
        return rows.drop(column) if kind == "ALTER DROP" else rows.withColumnRenamed(column, to)

    # ---- rights

    def role(self) -> str:
        roles = self._users().get(self.user, {}).get("roles", {})
        return roles.get(self.database) or roles.get("*") or "DENIED"

    def _may(self, right: str) -> None:
        if right not in RIGHTS[self.role()]:
            raise SessionError(f"{self.user} ({self.role()}) may not {right}")

    # ---- statements

    def execute(self, text: str) -> Result:
        s = parse(text)
        if isinstance(s, Select):
            self._may("read")
            self._ask("SELECT", s.table, text)
            at = None if s.as_of is None else as_of_micros(s.as_of)
            return Result(data=lower(s, lambda t: self.table(t, at)))
        if isinstance(s, (Insert, Update, Delete)):
            self._may("write")
            kind = type(s).__name__.upper()
            self._ask(kind, s.table, text)
            n = self._atomic({"INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete}[kind], s)
            for seen in self.after:
                seen(kind, s.table, n)
            return Result(f"{kind} {n}", count=n)
        if isinstance(s, CreateTable):
            self._may("define")
            return self._create(s)
        return self._command(s)

    def _ask(self, kind: str, table: str, text: str) -> None:
        for hook in self.before:
            if not hook(kind, table, text):
                raise SessionError(f"{kind} on {table} was vetoed")

    def fetch(self, text: str) -> list[Row]:
        """A SELECT's rows on the driver. What it took is counted for the scan that was advised; Spark reads alike for either."""
        s = parse(text)
        if not isinstance(s, Select):
            raise SessionError("only a SELECT has rows to fetch")
        entry = self.catalog().get(s.table, {"indexes": {}, "columns": []})
        f = learning.features(s, 0, len(entry["columns"]), frozenset(entry["indexes"].values()))
        arm, start = self.learned.choose(s.table, bool(f["has_index"]), f["selectivity"]), time.monotonic()
        rows = self.execute(text).data.collect()
        self.learned.record(arm, s.table, 1000 * (time.monotonic() - start))
        return rows

    def execute_batch(self, statements: list[str]) -> list[Result]:
        """All of them, each with its own outcome."""
        out = []
        for s in statements:
            try:
                out.append(self.execute(s))
            except Exception as e:  # a batch reports each statement's failure and goes on
                out.append(Result(f"{type(e).__name__}: {e}", success=False))
        return out

    def run_script(self, text: str) -> list[Result]:
        """Statements of a script, without its comments."""
        plain = re.sub(r"('[^']*')|/\*.*?\*/|--[^\n]*|#[^\n]*", lambda m: m[1] or " ", text, flags=re.S)
        parts = re.findall(r"(?:'[^']*'|[^;'])+;", plain)
        return self.execute_batch([p.strip() for p in parts if p.strip(" ;\n\t")])

    # ---- writing

    def _atomic(self, work: Callable[[Any], int], s: Any, tries: int = 4) -> int:
        """Runs a statement in the open transaction, or in one of its own that begins anew if another writer was first."""
        if self.txn:
            kept = dict(self.txn.changes)
            try:
                return work(s)
            except Exception:
                self.txn.changes = kept  # a failed statement leaves no part of itself in the transaction
                raise
        for left in range(tries - 1, -1, -1):
            self.txn = _Txn(0)
            try:
                n = work(s)
                t, self.txn = self.txn, None
                self._publish(t)
                return n
            except ConflictError:
                if not left:
                    raise
            finally:
                self.txn = None

    def _publish(self, t: _Txn) -> None:
        """Commits all of a transaction's tables at once."""
        parts = [(log := self.log_of(table), *log.prepare(changes, t.number, self.user, t.base[table])) for table, changes in t.changes.items()]
        self._journal().publish([(log, old, new) for log, n, old, new in parts if n])

    def _commit(self, table: str, changes: DataFrame) -> int:
        n = changes.count()
        if not n:
            return 0
        log = self.log_of(table)
        self.txn.base.setdefault(table, log.version())
        kept = self.txn.changes.get(table)
        self.txn.changes[table] = changes if kept is None else kept.unionByName(changes)
        return n

    def _insert(self, s: Insert) -> int:
        d = self.definition(s.table)
        log = self.log_of(s.table)
        names = list(s.columns) or [c.name for c in d.columns]
        by = {c.name: c for c in d.columns}
        if unknown := [n for n in names if n not in by]:
            raise SessionError(f"no column {unknown[0]!r}")
        auto = [c for c in d.columns if c.auto and c.name not in names]
        start = {c.name: (self.table(s.table).agg(F.max(c.name)).first()[0] or 0) for c in auto}
        rows = []
        for k, values in enumerate(s.rows):
            if len(values) != len(names):
                raise SessionError(f"{len(values)} values for {len(names)} columns")
            given = dict(zip(names, values))
            rows.append(tuple(start[c.name] + k + 1 if c in auto else coerce(given.get(c.name, c.default), c.type) for c in d.columns))
        new = self.spark.createDataFrame(rows, log.row)
        self._check(d, new, new)
        none = F.lit(None).cast(log.row)
        return self._commit(s.table, new.select(F.lit("I").alias("op"), none.alias("old"), F.struct(*new.columns).alias("new")))

    def _check(self, d: CreateTable, new: DataFrame, inserted: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Refuses rows that break a declared constraint. new: the rows to hold; gone: those they take the place of."""
        for c in d.columns:
            if not c.nullable and not c.auto and not new.filter(F.col(c.name).isNull() | (F.col(c.name).cast("string") == "")).isEmpty():
                raise SessionError(f"{c.name} may not be null")
        for text in [*(c.check for c in d.columns if c.check), *d.checks]:
            p = Parser(text + " ;")
            if not constraints.check_violations(new, predicate(new, p.conditions(), lambda i: column(new, i.column))).isEmpty():
                raise SessionError(f"CHECK ({text}) fails")
        keys = [[c.name for c in d.columns if c.primary]] + [[c.name] for c in d.columns if c.unique and not c.primary]
        kept = self.table(d.name)
        if gone is not None:
            kept = kept.exceptAll(gone)
        for key in filter(None, keys):
            if not constraints.duplicates(kept.select(*key).unionByName(new.select(*key)), key).join(new.select(*key), key, "left_semi").isEmpty():
                raise SessionError(f"duplicate {', '.join(key)}")
        for f in d.foreign:
            parents = kept.unionByName(new) if f.table == d.name else self.table(f.table)
            if not constraints.missing_parents(new, parents.alias("p"), list(zip(f.columns, f.references))).isEmpty():
                raise SessionError(f"no such {f.table} ({', '.join(f.references)})")

    def _where(self, s: Update | Delete, df: DataFrame) -> DataFrame:
        return df.filter(predicate(df, s.where, lambda i: column(df, i.column))) if s.where else df

    def _update(self, s: Update) -> int:
        d, rows = self.definition(s.table), self.table(s.table)
        c = next((c for c in d.columns if c.name == s.column), None)
        if c is None:
            raise SessionError(f"no column {s.column!r}")
        hit = self._where(s, rows)
        old = F.struct(*rows.columns)
        value = F.lit(coerce(s.value, c.type)).cast(SPARK_TYPES[c.type])
        both = hit.select(F.lit("U").alias("op"), old.alias("old"), F.struct(*(value.alias(n) if n == s.column else F.col(n) for n in rows.columns)).alias("new"))
        return self._replace(d, both)

    def _replace(self, d: CreateTable, both: DataFrame) -> int:
        """Puts new rows in the place of old ones, then applies the ON UPDATE actions of foreign keys whose key is gone."""
        self._check(d, both.select("new.*"), None, both.select("old.*"))
        n = self._commit(d.name, both)
        for child, f, pairs in self._referring(d.name) if n else ():
            moved = both.select(*(F.col("old")[r].alias(r) for r in f.references), *(F.col("new")[r].alias(f"_n{i}") for i, r in enumerate(f.references)))
            keys = [(r, r) for r in f.references]
            moved = constraints.missing_parents(moved, self.table(d.name), keys).distinct()
            rows = self.table(child)
            if (hit := constraints.with_parents(rows, moved, pairs)).isEmpty():
                continue
            if f.on_update == "CASCADE":
                on = [hit[c] == moved[r] for c, r in pairs]
                to = {c: F.col(f"_n{i}") for i, c in enumerate(f.columns)}
                hit = hit.join(moved, on).select(*(hit[n] for n in hit.columns), *(f"_n{i}" for i in range(len(pairs))))
            else:
                to = self._emptied(child, f, f.on_update)
            self._replace(self.definition(child), self._changed(hit, rows.columns, to))
        return n

    def _delete(self, s: Delete) -> int:
        gone = self._where(s, self.table(s.table))
        return self._remove(s.table, gone)

    def _remove(self, table: str, gone: DataFrame) -> int:
        """Deletes rows, then what their foreign keys' actions take with them; rows already gone are not met again, so cycles end."""
        n = self._commit(table, gone.select(F.lit("D").alias("op"), F.struct(*gone.columns).alias("old"), F.lit(None).cast(self.log_of(table).row).alias("new")))
        for child, f, pairs in self._referring(table) if n else ():
            rows = self.table(child)
            if (hit := constraints.cascade(rows, gone, pairs)).isEmpty():
                continue
            if f.on_delete == "CASCADE":
                self._remove(child, hit)
            else:
                self._replace(self.definition(child), self._changed(hit, rows.columns, self._emptied(child, f, f.on_delete)))
        return n

    def _referring(self, table: str) -> list[tuple[str, Any, list[tuple[str, str]]]]:
        """(table, foreign key, column pairs) of every foreign key to a table."""
        return [(child, f, list(zip(f.columns, f.references))) for child in self.catalog() for f in self.definition(child).foreign if f.table == table]

    def _emptied(self, child: str, f: Any, action: str) -> dict[str, Any]:
        """What SET NULL or SET DEFAULT puts into a foreign key's columns; other actions refuse."""
        if action not in ("SET NULL", "SET DEFAULT"):
            raise SessionError(f"{child} refers to rows of {f.table}")
        by = {c.name: c for c in self.definition(child).columns}
        return {n: F.lit(coerce(by[n].default, by[n].type) if action == "SET DEFAULT" else None).cast(SPARK_TYPES[by[n].type]) for n in f.columns}

    def _changed(self, hit: DataFrame, columns: list[str], to: dict[str, Any]) -> DataFrame:
        return hit.select(F.lit("U").alias("op"), F.struct(*columns).alias("old"), F.struct(*(to[n].alias(n) if n in to else F.col(n) for n in columns)).alias("new"))

    # ---- definitions and commands

    def _create(self, s: CreateTable) -> Result:
        c = self.catalog()
        if s.name in c:
            raise SessionError(f"table {s.name!r} exists")
        names = [x.name for x in s.columns]
        if not names or len(set(names)) < len(names):
            raise SessionError("a table needs columns of different names")
        for f in s.foreign:
            if not set(f.references) <= set(names if f.table == s.name else [x["name"] for x in c.get(f.table, {"columns": []})["columns"]]):
                raise SessionError(f"no such {f.table} ({', '.join(f.references)})")
        folder = f"{s.name}-{len(self.files.list(f'{self.root}/{self.database}'))}"
        c[s.name] = {"columns": [asdict(x) for x in s.columns], "foreign": [asdict(x) for x in s.foreign], "checks": s.checks, "indexes": {}, "folder": folder}
        self._save_catalog(c)
        return Result("CREATE TABLE")

    def _frame(self, names: list[str], rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"`{n}` string" for n in names))

    def _command(self, s: Command) -> Result:
        name, a = s.name, s.args
        if right := ASKED.get(name) or ("read" if name.startswith(("SHOW", "DESCRIBE")) else None):
            self._may(right)
        if name == "BEGIN":
            if self.txn:
                raise SessionError("a transaction is open")
            self.txn = _Txn(1)
        elif name in ("COMMIT", "ROLLBACK"):
            t, self.txn = self.txn, None
            if t and name == "COMMIT":
                self._publish(t)
        elif name == "CHECKPOINT":
            for table in self.catalog():
                self.log_of(table).checkpoint()
            self.files.write(self._learned_path(), self.learned.dumps(), True)
        elif name == "RECOVER":
            self._may("define")
            if a[0] is not None:
                self.recover(as_of_micros(a[0]))
        elif name == "LOGIN":
            u = self._users().get(a[0])
            if not u or u["hash"] != _hash(*a):
                raise SessionError("wrong user or password")
            self.user = a[0]
        elif name in ("CREATE USER", "UPDATE USER", "DELETE USER", "DROP USER"):
            self._may("admin")
            users = self._users()
            if (a[0] in users) == (name == "CREATE USER"):
                raise SessionError(f"user {a[0]!r} {'exists' if name == 'CREATE USER' else 'does not exist'}")
            if name == "CREATE USER":
                users[a[0]] = {"hash": _hash(a[0], a[1]), "roles": {"*": a[2]}}
            elif name == "UPDATE USER":
                users[a[0]]["roles"][a[2] or "*"] = a[1]
            else:
                del users[a[0]]
            self._save_users(users)
        elif name in ("CREATE DATABASE", "DROP DATABASE"):
            self._may("define")
            if a[0] in RESERVED or (a[0] in self.databases()) == (name == "CREATE DATABASE") or (name == "DROP DATABASE" and a[0] == self.database):
                raise SessionError(f"{name} {a[0]} is not possible")
            if name == "CREATE DATABASE":
                self.files.write(f"{self.root}/{a[0]}/catalog.json", json.dumps({}), True)
            else:
                self.files.delete(f"{self.root}/{a[0]}")
        elif name == "USE":
            if a[0] not in self.databases():
                raise SessionError(f"no database {a[0]!r}")
            self.database = a[0]
        elif name == "DROP TABLE":
            self._may("define")
            c = self.catalog()
            if a[0] not in c:
                if a[1]:
                    return Result("DROP TABLE")
                raise SessionError(f"no table {a[0]!r}")
            if any(f["table"] == a[0] for t, d in c.items() if t != a[0] for f in d["foreign"]):
                raise SessionError(f"another table refers to {a[0]}")
            self.files.delete(f"{self.root}/{self.database}/{c.pop(a[0])['folder']}")
            self._save_catalog(c)
        elif name in ("CREATE INDEX", "DROP INDEX"):
            self._may("define")
            c = self.catalog()
            if name == "CREATE INDEX":
                if a[2] not in {x.name for x in self.definition(a[1]).columns}:
                    raise SessionError(f"no column {a[2]!r}")
                c[a[1]]["indexes"][a[0]] = a[2]
            else:
                owner = next((t for t, d in c.items() if a[0] in d["indexes"]), None)
                if owner is None and not a[1]:
                    raise SessionError(f"no index {a[0]!r}")
                if owner:
                    del c[owner]["indexes"][a[0]]
            self._save_catalog(c)
        elif name.startswith("ALTER"):
            self._may("define")
            self._alter(name, a)
        elif name == "DESCRIBE":
            rows = [(c.name, c.type, "YES" if c.nullable else "NO", "PRI" if c.primary else "UNI" if c.unique else "", "" if c.default is None else c.default, "auto_increment" if c.auto else "") for c in self.definition(a[0]).columns]
            return Result(data=self._frame(["Column", "Type", "Nullable", "Key", "Default", "Extra"], rows))
        elif name == "SHOW CREATE TABLE":
            return Result(data=self._frame(["Table", "Create Table"], [(a[0], _ddl(self.definition(a[0])))]))
        elif name == "SHOW TABLES":
            return Result(data=self._frame(["Table"], [(t,) for t in sorted(self.catalog())]))
        elif name == "SHOW DATABASES":
            return Result(data=self._frame(["Database"], [(d,) for d in self.databases()]))
        elif name == "STATUS":
            return Result(data=self._frame(["Variable", "Value"], [("user", self.user), ("database", self.database), ("role", self.role()), ("authenticated", True)]))
        elif name == "WHOAMI":
            return Result(data=self._frame(["Current User", "Current DB", "Role"], [(self.user, self.database, self.role())]))
        elif name == "SHOW USER":
            return Result(data=self._frame(["Username", "Roles"], [(u, ",".join(f"{d}:{r}" for d, r in v["roles"].items())) for u, v in self._users().items()]))
        elif name == "SHOW AI STATUS":
            return Result(data=self._frame(["Component", "Status", "Details"], [("hooks", "on" if self.before or self.after else "off", f"{len(self.before)} before, {len(self.after)} after")]))
        elif name == "SHOW ANOMALIES":
            return Result(data=analytics.anomalies(analytics.dense_rates(self.mutations(), "table", F.lit(1)), "table").filter("severity <> 'NONE'").limit(50))
        elif name == "SHOW EXECUTION STATS":
            return Result(data=self._frame(["Strategy", "Pulls", "Avg Reward", "UCB Score"], [(n, p, f"{q:.4f}", f"{u:.4f}") for n, p, q, u in self.learned.stats()]))
        elif name == "STOP":
            self._may("admin")
            self.running = False
        else:
            raise DialectError(f"unknown command {name}")
        return Result(name)

    def mutations(self) -> DataFrame:
        """(ts, table, user) of every committed change of the database."""
        out = self.spark.createDataFrame([], "ts timestamp, table string, user string")
        for t in self.catalog():
            out = out.union(self.log_of(t).log().select("ts", F.lit(t), "user"))
        return out

    def recover(self, at: int) -> None:
        """All tables back to a time in microseconds, in one commit."""
        if not 0 < at <= time.time_ns() // 1000 + 60_000_000:
            raise SessionError("RECOVER needs a time that has been")
        t = _Txn(0)
        for name, entry in self.catalog().items():
            log = self.log_of(name)
            t.base[name] = log.version()
            if any(at < h["until"] for h in entry.get("history", [])):
                one, then = F.lit(1).cast("long"), self._past(name, at)
                live = log.live()
                t.changes[name] = log.undo(live.exceptAll(then).withColumn("weight", one).unionByName(then.exceptAll(live).withColumn("weight", -one)))
            else:
                t.changes[name] = log.back(at)
        self._publish(t)

    def retain(self, asked_us: list[int] = (), now_us: int | None = None) -> int:
        """Prunes the logs of all tables to the time they are kept for: a week, or longer where old times (asked_us, those most asked for) need it.
        Returns the earliest time that AS OF still reaches. Rows stay; what tables were before an ALTER stays too."""
        self._may("admin")
        if self.txn:
            raise SessionError("a log can't be pruned inside a transaction")
        now = time.time_ns() // 1000 if now_us is None else now_us
        cutoff = now - int(analytics.retention_cutoff_s([(now - t) / 1e6 for t in asked_us]) * 1e6)
        self._journal().settle()
        for table in self.catalog():
            self.log_of(table).prune(cutoff)
        return cutoff

    def _alter(self, name: str, a: tuple) -> None:
        """Begins a new log with the altered rows; the old one stays, for times before."""
        if self.txn:
            raise SessionError("a definition can't change inside a transaction")
        self._journal().settle()
        c, d, old = self.catalog(), self.definition(a[0]), self.log_of(a[0])
        version, before = old.version(), list(c[a[0]]["columns"])
        change = [name, a[1].name, a[1].type, a[1].default] if name == "ALTER ADD" else [name, a[1], a[2] if name == "ALTER RENAME" else None, None]
        live = self._altered(old.live(version), *change)
        if name == "ALTER ADD":
            d.columns.append(a[1])
        elif name == "ALTER DROP":
            d.columns = [x for x in d.columns if x.name != a[1]]
        else:
            for x in d.columns:
                x.name = a[2] if x.name == a[1] else x.name
        folder = f"{a[0]}-{len(self.files.list(f'{self.root}/{self.database}'))}"
        schema = T.StructType([T.StructField(x.name, SPARK_TYPES[x.type]) for x in d.columns])
        log, at = ChangeLog(self.spark, f"{self.root}/{self.database}/{folder}", schema), max(time.time_ns() // 1000, old.manifest().get("ts", 0) + 1)
        log.append(live.select(F.lit("I").alias("op"), F.lit(None).cast(log.row).alias("old"), F.struct(*live.columns).alias("new")), 0, self.user, ts=at)
        if old.version() != version:
            raise ConflictError(f"{a[0]} changed while it was altered")
        c[a[0]]["history"] = [*c[a[0]].get("history", []), {"folder": c[a[0]]["folder"], "columns": before, "until": at, "change": change}]
        c[a[0]] |= {"columns": [asdict(x) for x in d.columns], "folder": folder}
        self._save_catalog(c)


def _hash(user: str, password: str) -> str:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), user.encode(), 100_000).hex()


def _ddl(d: CreateTable) -> str:
    def one(c: ColumnDef) -> str:
        parts = [c.name, f"VARCHAR({c.length})" if c.type == "VARCHAR" else c.type]
        parts += ["PRIMARY KEY"] * c.primary + ["NOT NULL"] * (not c.nullable and not c.primary) + ["UNIQUE"] * c.unique + ["AUTO_INCREMENT"] * c.auto
        if c.default is not None:
            parts.append("DEFAULT " + (f"'{c.default}'" if isinstance(c.default, str) else str(c.default)))
        return " ".join(parts + ([f"CHECK ({c.check})"] if c.check else []))

    keys = [f"FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.table} ({', '.join(f.references)}) ON DELETE {f.on_delete} ON UPDATE {f.on_update}" for f in d.foreign]
    return f"CREATE TABLE {d.name} (\n  " + ",\n  ".join([*map(one, d.columns), *keys, *(f"CHECK ({t})" for t in d.checks)]) + "\n);"


def threat_level(text: str) -> str:
    """The gravest hostile pattern in a text."""
    low = text.lower()
    levels = ("HIGH", "MEDIUM", "LOW")
    return next((v for v in levels if any(p in low for kinds in (analytics.SQL_PATTERNS, analytics.SCRIPT_PATTERNS) for p in kinds[v])), "NONE")


def threat_veto(kind: str, table: str, text: str) -> bool:
    """A before-hook: refuses statements that hold a hostile pattern of medium gravity or more."""
    return threat_level(text) not in ("HIGH", "MEDIUM")
