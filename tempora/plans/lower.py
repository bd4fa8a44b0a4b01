"""Lowers a SELECT to a DataFrame; Catalyst does the rest."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.dialect.lexer import DialectError
from tempora.dialect.parser import Condition, Item, Select
from tempora.functions.scalar import EPSILON, parse_time

#: Rows of a key, of each side, that a task of a join by an equality and further comparisons compares with one another, and how many such blocks a partition has (both about).
BLOCK, BLOCKS = 4096, 8
_AGG = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def column(df: DataFrame, name: str) -> Column:
    if "." not in name and name not in df.columns:
        raise DialectError(f"no column {name!r}")
    return _named(name)


def kind_of(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c.alias("c")).schema["c"].dataType


def literal(value, kind: T.DataType):
    if isinstance(value, str) and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(parse_time(value)).cast(kind)
    if isinstance(value, int) and not isinstance(value, bool) and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(dt.datetime(1970, 1, 1) + dt.timedelta(seconds=value)).cast(kind)
    return F.lit(value)


def compare(df: DataFrame, c: Column, op: str, value, kind: T.DataType | None = None) -> Column:
    """A typed comparison; equality of doubles is within EPSILON, as the dialect has it."""
    kind = kind or kind_of(df, c)
    if op == "IN":
        return reduce(lambda a, b: a | b, (compare(df, c, "=", v, kind) for v in value)) if isinstance(kind, T.DoubleType) else c.isin([literal(v, kind) for v in value])
    if op == "LIKE":
        return c.like(value.replace("\\", "\\\\"))
    v = literal(value, kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(value, (int, float)) and not isinstance(value, bool):
        near = F.abs(c - v) < EPSILON
        return {"=": near, "!=": ~near, "<": c < v, ">": c > v, "<=": (c < v) | near, ">=": (c > v) | near}[op]
    return {"=": c == v, "!=": c != v, "<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[op]


def predicate(df: DataFrame, conditions: tuple[Condition, ...], of: Callable[[Item], Column]) -> Column:
    """AND and OR from the left, without precedence: a OR b AND c is (a OR b) AND c."""
    out = None
    for c in conditions:
        now = compare(df, of(c.left), c.op, c.right)
        out = now if out is None else (out & now if c.link == "AND" else out | now)
    return out


def _named(name: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


def _of(df: DataFrame, table: str, name: str) -> bool:
    """Whether a column name belongs to df, a table of that name."""
    of, _, own = name.rpartition(".")
    return of.lower() == table.lower() if of else own.lower() in {c.lower() for c in df.columns}


def _same(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type in which keys of two types are compared, if that needs no more than a cast to long."""
    return a if a == b else T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else None


def join(df: DataFrame, other: DataFrame, conditions: tuple[tuple[str, str, str], ...], kind: str, name: str) -> DataFrame:
    """A join by comparisons of columns with a table of that name.

    By an equality and further comparisons, an inner join compares all rows of a key, and a key has one task: where that may be more than BLOCK rows with as many
    others, both sides' rows of the key are dealt to blocks by a hash, and each block of one side meets each of the other, in partitions as many as the pairs need.
    """
    on = []
    for a, op, b in conditions:
        x, y = _named(a), _named(b)
        on.append({"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op])
    plain = df.join(other, reduce(lambda a, b: a & b, on), kind)
    equal = [(b, a) if _of(other, name, a) else (a, b) for a, op, b in conditions if op == "="]
    if kind != "inner" or not equal or len(equal) == len(on) or any(_of(other, name, a) or not _of(other, name, b) for a, b in equal):
        return plain
    types = [_same(kind_of(df, _named(a)), kind_of(other, _named(b))) for a, b in equal]
    if None in types:
        return plain
    taken, base = {c.lower() for c in [*df.columns, *other.columns]}, "_block"
    while any(c.startswith(base) for c in taken):
        base += "_"
    keys = [f"{base}k{i}" for i in range(len(equal))]
    left = [_named(a).cast(t) for (a, _), t in zip(equal, types)]
    right = [_named(b).cast(t) for (_, b), t in zip(equal, types)]
    n, m, l, r = (base + c for c in ("n", "m", "l", "r"))

    def sizes(side: DataFrame, by: list[Column], name: str) -> DataFrame:
        return side.groupBy(*(c.alias(k) for c, k in zip(by, keys))).agg(F.count(F.lit(1)).alias(name))

    pairs = F.col(n).cast("double") * F.col(m)
    both = sizes(df, left, n).join(sizes(other, right, m), keys)
    much = pairs > BLOCK * BLOCK
    total, large = both.agg(F.sum(pairs), F.count_if(much)).first()
    if not large:
        return plain
    # keys of so many pairs are few beside the rows: each has BLOCK rows of one side at least
    large = F.broadcast(both.filter(much).select(*keys, *(F.ceil(F.col(c) / BLOCK).alias(c) for c in (n, m))))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (BLOCKS * BLOCK * BLOCK)))

    def dealt(side: DataFrame, by: list[Column], end: str, own: str, others: str, mine: str, theirs: str) -> DataFrame:
        """The side's rows, each once for each of the other side's blocks; equal rows have the same block."""
        side = side.withColumn(base + "h", F.xxhash64(F.col("*")))
        for c, k in zip(by, keys):
            side = side.withColumn(k + end, c)
        side = side.join(large, reduce(lambda a, b: a & b, (F.col(k + end) == F.col(k) for k in keys)), "left")
        one = F.lit(1).cast("long")
        side = side.withColumn(mine + end, F.pmod(F.col(base + "h"), F.coalesce(own, one)))
        side = side.withColumn(theirs + end, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(others, one) - 1)))
        return side.drop(*keys, n, m, base + "h").repartition(parts, *(F.col(k + end) for k in [*keys, l, r]))

    a = dealt(df, left, "a", n, m, l, r)
    b = dealt(other, right, "b", m, n, r, l)
    met = [F.col(k + "a") == F.col(k + "b") for k in [*keys, l, r]]
    met += [c for c, (_, op, _) in zip(on, conditions) if op != "="]
    return a.join(b.hint("merge"), reduce(lambda x, y: x & y, met)).drop(*(k + e for k in [*keys, l, r] for e in "ab"))


def lower(s: Select, table: Callable[[str], DataFrame]) -> DataFrame:
    """filter, join, group, having, project, distinct, sort, offset, limit."""
    df = table(s.table).alias(s.alias or s.table)
    for j in s.joins:
        other = table(j.table).alias(j.alias or j.table)
        if j.kind == "cross":
            df = df.crossJoin(other)
            continue
        df = join(df, other, j.on, j.kind, j.alias or j.table)
    if s.where:
        df = df.filter(predicate(df, s.where, lambda i: column(df, i.column)))
    aggregated = bool(s.group) or any(i.aggregate for i in s.items) or any(c.left.aggregate for c in s.having)
    if aggregated:
        if any(i.column == "*" and not i.aggregate for i in s.items):
            raise DialectError("* cannot be grouped")
        stray = [i.column for i in s.items if not i.aggregate and i.column not in s.group]
        if stray:
            raise DialectError(f"{stray[0]!r} is neither grouped nor aggregated")
        wanted = {(i.aggregate, i.column) for i in s.items if i.aggregate} | {(c.left.aggregate, c.left.column) for c in s.having if c.left.aggregate}
        made = {k: f"_a{n}" for n, k in enumerate(sorted(wanted))}
        base = df
        aggs = [_AGG[a](F.lit(1) if c == "*" else column(base, c)).alias(n) for (a, c), n in made.items()]
        keys = [column(base, g).alias(f"_g{n}") for n, g in enumerate(s.group)]
        df = base.groupBy(*keys).agg(*aggs) if aggs else base.select(*keys).distinct()
        alias = {i.name: i for i in s.items}

        def of(i: Item) -> Column:
            i = alias.get(i.column, i) if not i.aggregate else i
            return F.col(made[i.aggregate, i.column]) if i.aggregate else F.col(f"_g{s.group.index(i.column)}")

        if s.having:
            df = df.filter(predicate(df, s.having, of))
        out = df.select(*(of(i).alias(i.name) for i in s.items))
    elif s.items == (Item("*"),):
        out = df
    else:
        out = df.select(*(column(df, i.column).alias(i.name) for i in s.items))
    if s.distinct:
        out = out.distinct()
    if s.order:
        have = set(out.columns)
        keys = [k if k in have or "." not in k else k.split(".")[-1] for k, _ in s.order]
        hidden = [k for k in keys if k not in have]
        if hidden and (s.distinct or aggregated):
            raise DialectError(f"cannot sort by {hidden[0]!r}: it is not selected")
        order = [F.col(f"`{k}`").desc() if down else F.col(f"`{k}`").asc() for k, (_, down) in zip(keys, s.order)]
        if hidden:
            out = df.orderBy(*order).select(*(column(df, i.column).alias(i.name) for i in s.items))
        else:
            out = out.orderBy(*order)
    if s.offset:
        out = out.offset(s.offset)
    if s.limit:
        out = out.limit(s.limit)
    return out
