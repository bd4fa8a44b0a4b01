"""Statements of the dialect as dataclasses, by recursive descent."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tempora.dialect.lexer import DialectError, Token, tokens

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
OPERATORS = ("=", "<", ">", "<=", ">=", "!=", "<>")
ROLES = ("SUPERADMIN", "ADMIN", "NORMAL", "READONLY", "DENIED")
TYPES = ("INT", "BIGINT", "DECIMAL", "VARCHAR", "BOOLEAN", "TIMESTAMP")


@dataclass(frozen=True)
class Item:
    """A column, or an aggregate of one; '*' stands for all."""

    column: str
    aggregate: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (f"{self.aggregate.lower()}({self.column})" if self.aggregate else self.column.split(".")[-1])


@dataclass(frozen=True)
class Condition:
    """left op right; link says how it is joined to what stands before it."""

    left: Item
    op: str
    right: Any
    link: str = "AND"


#: What may follow a table in a SELECT, so that it isn't another name for it.
AFTER_TABLE = ("INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "JOIN", "ON", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET")


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    on: tuple[tuple[str, str, str], ...] = ()
    alias: str = ""


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    distinct: bool = False
    joins: tuple[Join, ...] = ()
    where: tuple[Condition, ...] = ()
    group: tuple[str, ...] = ()
    having: tuple[Condition, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    limit: int = 0
    offset: int = 0
    as_of: int | str | None = None
    alias: str = ""


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Any, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Any
    where: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Delete:
    table: str
    where: tuple[Condition, ...] = ()


@dataclass
class ColumnDef:
    name: str
    type: str
    length: int = 255
    primary: bool = False
    nullable: bool = True
    unique: bool = False
    auto: bool = False
    default: Any = None
    check: str | None = None


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    references: list[str]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnDef]
    foreign: list[ForeignKey] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Command:
    """Any other statement: what it is called and its arguments."""

    name: str
    args: tuple = ()


Statement = Select | Insert | Update | Delete | CreateTable | Command


def parse(text: str) -> Statement:
    return Parser(text).statement()


class Parser:
    def __init__(self, text: str):
        self.text, self.all, self.i = text, tokens(text), 0

    # ---- tokens

    @property
    def now(self) -> Token:
        return self.all[self.i]

    def sees(self, *concepts: str) -> bool:
        return all(self.all[min(self.i + k, len(self.all) - 1)].says(c) for k, c in enumerate(concepts))

    def take(self, *concepts: str) -> bool:
        if self.sees(*concepts):
            self.i += len(concepts)
            return True
        return False

    def need(self, *concepts: str) -> None:
        if not self.take(*concepts):
            raise DialectError(f"expected {' '.join(concepts)} at {self.now.at}, found {self.now.text!r}")

    def symbol(self, s: str) -> bool:
        if self.now.kind == "sym" and self.now.text == s:
            self.i += 1
            return True
        return False

    def need_symbol(self, s: str) -> None:
        if not self.symbol(s):
            raise DialectError(f"expected {s!r} at {self.now.at}, found {self.now.text!r}")

    def name(self) -> str:
        if self.now.kind != "word":
            raise DialectError(f"expected a name at {self.now.at}, found {self.now.text!r}")
        self.i += 1
        return self.all[self.i - 1].text

    def column(self) -> str:
        out = self.name()
        return f"{out}.{self.name()}" if self.symbol(".") else out

    def names(self) -> list[str]:
        self.need_symbol("(")
        out = [self.name()]
        while self.symbol(","):
            out.append(self.name())
        self.need_symbol(")")
        return out

    def integer(self) -> int:
        if self.now.kind != "num" or "." in self.now.text:
            raise DialectError(f"expected a whole number at {self.now.at}")
        self.i += 1
        return int(self.all[self.i - 1].text)

    def value(self) -> Any:
        t = self.now
        self.i += 1
        if t.kind == "str":
            return t.text
        if t.kind == "num":
            return float(t.text) if "." in t.text else int(t.text)
        for concept, v in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if t.says(concept):
                return v
        raise DialectError(f"expected a value at {t.at}, found {t.text!r}")

    def done(self, out: Statement) -> Statement:
        self.need_symbol(";")
        if self.now.kind != "end":
            raise DialectError(f"text after the statement at {self.now.at}")
        return out

    # ---- statements

    def statement(self) -> Statement:
        if self.take("SELECT"):
            return self.done(self.select())
        if self.take("INSERT"):
            return self.done(self.insert())
        if self.take("DELETE"):
            if self.take("USER"):
                return self.done(Command("DELETE USER", (self.text_or_name(),)))
            self.need("FROM")
            if self.sees("TABLE"):
                self.i += 1
            return self.done(Delete(self.name(), self.where()))
        if self.take("UPDATE"):
            return self.done(self.update())
        if self.take("CREATE"):
            return self.done(self.create())
        if self.take("DROP"):
            return self.done(self.drop())
        if self.take("ALTER"):
            return self.done(self.alter())
        if self.take("TRUNCATE"):
            self.take("TABLE")
            return self.done(Delete(self.name()))
        if self.take("SHOW"):
            return self.done(self.show())
        if self.take("DESCRIBE"):
            return self.done(Command("DESCRIBE", (self.name(),)))
        if self.take("USE"):
            return self.done(Command("USE", (self.name(),)))
        if self.take("LOGIN"):
            return self.done(Command("LOGIN", (self.text_or_name(), self.text_or_name())))
        if self.take("RECOVER"):
            self.need("TO")
            if self.take("LATEST") or self.take("NOW") or self.take("CURRENT"):
                return self.done(Command("RECOVER", (None,)))
            return self.done(Command("RECOVER", (self.value(),)))
        for concept in ("BEGIN", "COMMIT", "ROLLBACK", "CHECKPOINT", "WHOAMI", "STATUS"):
            if self.take(concept):
                return self.done(Command(concept))
        if self.take("STOP"):
            self.symbol(";")
            return Command("STOP")
        raise DialectError(f"no statement starts with {self.now.text!r}")

    def text_or_name(self) -> str:
        if self.now.kind == "str":
            self.i += 1
            return self.all[self.i - 1].text
        return self.name()

    def item(self) -> Item:
        for a in AGGREGATES:
            if self.sees(a) and self.all[self.i + 1].text == "(":
                self.i += 2
                column = "*" if self.symbol("*") else self.column()
                self.need_symbol(")")
                return Item(column, a, self.name() if self.take("AS") else None)
        column = self.column()
        return Item(column, None, self.name() if self.sees("AS") and not self.sees("AS", "OF") and self.take("AS") else None)

    def conditions(self) -> tuple[Condition, ...]:
        out, link = [], "AND"
        while True:
            left = self.item()
            if self.take("IN"):
                self.need_symbol("(")
                values = [self.value()]
                while self.symbol(","):
                    values.append(self.value())
                self.need_symbol(")")
                out.append(Condition(left, "IN", tuple(values), link))
            elif self.take("LIKE"):
                out.append(Condition(left, "LIKE", self.value(), link))
            else:
                if self.now.text not in OPERATORS:
                    raise DialectError(f"expected a comparison at {self.now.at}, found {self.now.text!r}")
                op = self.now.text
                self.i += 1
                out.append(Condition(left, "!=" if op == "<>" else op, self.value(), link))
            if self.take("AND"):
                link = "AND"
            elif self.take("OR"):
                link = "OR"
            else:
                return tuple(out)

    def where(self) -> tuple[Condition, ...]:
        return self.conditions() if self.take("WHERE") else ()

    def select(self) -> Select:
        distinct = self.take("DISTINCT") or self.take("UNIQUE")
        if self.symbol("*"):
            items = (Item("*"),)
        else:
            found = [self.item()]
            while self.symbol(","):
                found.append(self.item())
            items = tuple(found)
        self.need("FROM")
        table, alias, joins, group, having, order = self.name(), self.alias(), [], [], (), []
        while (kind := self.join_kind()) is not None:
            other, own, on = self.name(), self.alias(), []
            if kind != "cross":
                self.need("ON")
                while True:
                    a, op = self.column(), self.now.text
                    if op not in OPERATORS:
                        raise DialectError(f"expected a comparison at {self.now.at}")
                    self.i += 1
                    on.append((a, "!=" if op == "<>" else op, self.column()))
                    if not self.take("AND"):
                        break
            joins.append(Join(kind, other, tuple(on), own))
        where = self.where()
        if self.take("GROUP", "BY"):
            group.append(self.column())
            while self.symbol(","):
                group.append(self.column())
        if self.take("HAVING"):
            having = self.conditions()
        if self.take("ORDER", "BY"):
            while True:
                key = self.item().name
                down = self.take("DESC")
                if not down:
                    self.take("ASC")
                order.append((key, down))
                if not self.symbol(","):
                    break
        limit = self.integer() if self.take("LIMIT") else 0
        offset = self.integer() if self.take("OFFSET") else 0
        as_of = self.value() if self.take("AS", "OF") else None
        return Select(items, table, distinct, tuple(joins), where, tuple(group), having, tuple(order), limit, offset, as_of, alias)

    def alias(self) -> str:
        """The other name that may follow a table's name, with or without AS."""
        if self.sees("AS", "OF"):
            return ""
        if self.take("AS"):
            return self.name()
        return "" if self.now.kind != "word" or any(self.sees(k) for k in AFTER_TABLE) else self.name()

    def join_kind(self) -> str | None:
        for concept, kind in (("INNER", "inner"), ("LEFT", "left"), ("RIGHT", "right"), ("FULL", "full"), ("OUTER", "full"), ("CROSS", "cross"), ("JOIN", "inner")):
            if self.sees(concept):
                if concept != "JOIN":
                    self.i += 1
                    self.take("OUTER")
                self.need("JOIN")
                return kind
        return None

    def insert(self) -> Insert:
        self.need("INTO")
        table, columns, rows = self.name(), (), []
        if self.now.text == "(":
            columns = tuple(self.names())
        self.need("VALUES")
        while True:
            self.need_symbol("(")
            row = [self.value()]
            while self.symbol(","):
                row.append(self.value())
            self.need_symbol(")")
            rows.append(tuple(row))
            if not self.symbol(","):
                return Insert(table, columns, tuple(rows))

    def update(self) -> Statement:
        if self.take("USER"):
            user = self.text_or_name()
            self.need("ROLE")
            role = self.role()
            return Command("UPDATE USER", (user, role, self.name() if self.take("IN") else None))
        table = self.name()
        self.need("SET")
        column = self.name()
        self.need_symbol("=")
        return Update(table, column, self.value(), self.where())

    def role(self) -> str:
        for r in ROLES:
            if self.take(r):
                return r
        raise DialectError(f"expected a role at {self.now.at}")

    def create(self) -> Statement:
        if self.take("DATABASE"):
            return Command("CREATE DATABASE", (self.name(),))
        if self.take("USER"):
            user = self.text_or_name()
            self.need("PASS")
            password = self.text_or_name()
            self.need("ROLE")
            return Command("CREATE USER", (user, password, self.role()))
        if self.take("INDEX"):
            index = self.name()
            self.need("ON")
            table = self.name()
            return Command("CREATE INDEX", (index, table, self.names()[0]))
        self.need("TABLE")
        out = CreateTable(self.name(), [])
        self.need_symbol("(")
        while True:
            if self.take("FOREIGN", "KEY"):
                columns = self.names()
                out.foreign.append(self.references(columns))
            elif self.take("CHECK"):
                out.checks.append(self.check())
            elif self.take("PRIMARY", "KEY"):
                keys = self.names()
                for c in out.columns:
                    if c.name in keys:
                        c.primary, c.nullable = True, False
            else:
                out.columns.append(self.column_def(out))
            if not self.symbol(","):
                break
        self.need_symbol(")")
        return out

    def column_def(self, table: CreateTable) -> ColumnDef:
        name = self.name()
        kind = next((t for t in TYPES if self.take(t)), None)
        if kind is None:
            raise DialectError(f"expected a type at {self.now.at}, found {self.now.text!r}")
        out = ColumnDef(name, kind)
        if self.symbol("("):
            out.length = self.integer()
            self.need_symbol(")")
        while True:
            if self.take("PRIMARY"):
                self.take("KEY")
                out.primary, out.nullable = True, False
            elif self.take("NOT", "NULL"):
                out.nullable = False
            elif self.take("UNIQUE") or self.take("DISTINCT"):
                out.unique = True
            elif self.take("AUTO_INCREMENT"):
                out.auto = True
            elif self.take("DEFAULT"):
                out.default = self.value()
            elif self.take("CHECK"):
                out.check = self.check()
            elif self.sees("REFERENCES"):
                table.foreign.append(self.references([name]))
            else:
                return out

    def check(self) -> str:
        self.need_symbol("(")
        start = self.now.at
        self.conditions()
        end = self.now.at
        self.need_symbol(")")
        return self.text[start:end].strip()

    def references(self, columns: list[str]) -> ForeignKey:
        self.need("REFERENCES")
        out = ForeignKey(columns, self.name(), self.names())
        while self.take("ON"):
            which = "on_delete" if self.take("DELETE") else "on_update"
            if which == "on_update":
                self.need("UPDATE")
            if self.take("CASCADE"):
                action = "CASCADE"
            elif self.take("RESTRICT"):
                action = "RESTRICT"
            elif self.take("NO", "ACTION"):
                action = "NO ACTION"
            else:
                self.need("SET")
                action = "SET DEFAULT" if self.take("DEFAULT") else "SET NULL"
                if action == "SET NULL":
                    self.need("NULL")
            setattr(out, which, action)
        return out

    def drop(self) -> Statement:
        for kind in ("TABLE", "INDEX", "DATABASE", "USER"):
            if self.take(kind):
                maybe = self.take("IF", "EXISTS")
                return Command(f"DROP {kind}", (self.name(), maybe))
        raise DialectError(f"nothing to drop at {self.now.at}")

    def alter(self) -> Statement:
        self.need("TABLE")
        table = self.name()
        if self.take("ADD"):
            self.take("COLUMN")
            return Command("ALTER ADD", (table, self.column_def(CreateTable(table, []))))
        if self.take("DROP"):
            self.take("COLUMN")
            return Command("ALTER DROP", (table, self.name()))
        self.need("RENAME")
        self.take("COLUMN")
        old = self.name()
        self.need("TO")
        return Command("ALTER RENAME", (table, old, self.name()))

    def show(self) -> Statement:
        if self.take("CREATE", "TABLE"):
            return Command("SHOW CREATE TABLE", (self.name(),))
        if self.take("AI"):
            self.need("STATUS")
            return Command("SHOW AI STATUS")
        if self.take("EXECUTION"):
            self.need("STATS")
            return Command("SHOW EXECUTION STATS")
        for concept, name in (("TABLE", "SHOW TABLES"), ("DATABASES", "SHOW DATABASES"), ("STATUS", "STATUS"), ("USER", "SHOW USER"), ("ANOMALIES", "SHOW ANOMALIES")):
            if self.take(concept):
                return Command(name)
        if self.now.text.upper() == "TABLES":
            self.i += 1
            return Command("SHOW TABLES")
        raise DialectError(f"nothing to show at {self.now.at}")
