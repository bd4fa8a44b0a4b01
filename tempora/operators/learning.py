"""Learned choices: which scan a table's queries should use, how their filters and limits should run, and what a query looks like.

The choices are advice. Spark's optimizer picks the physical plan; these are the figures a person or a tool would act upon. Feedback tables of any
size are summed by DataFrames; ``Bandit`` keeps the sums of one session, an entry for each arm of each table.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.dialect.parser import Condition, Select
from tempora.functions.scalar import reward, ucb1

#: Observations before anything is learned, pulls an arm needs, pulls an arm needs in one table, weight of exploration.
LEAST_TOTAL, LEAST_PULLS, LEAST_IN_TABLE, EXPLORE = 30, 5, 10, 1.414
#: Queries that keep fewer or more rows than these favour the index or the whole scan, if its reward is near the other's.
FEW, MANY, NEAR = 0.05, 0.5, 0.8
#: The share of rows a condition is taken to keep, and what it costs to evaluate.
SELECTIVITY = {"=": 0.1, "<": 0.33, ">": 0.33, "<=": 0.33, ">=": 0.33, "!=": 0.9, "<>": 0.9, "LIKE": 0.25}
COST = {"=": 1.0, "!=": 1.0, "<>": 1.0, "<": 1.5, ">": 1.5, "<=": 1.5, ">=": 1.5, "IN": 3.0, "LIKE": 5.0}
SCANS = ("Sequential Scan", "Index Scan")


def _units(ms: Column) -> Column:
    return F.floor(reward(ms) * 10000).cast("long")


def choose_by_table(feedback: DataFrame, features: DataFrame) -> DataFrame:
    """(table_name, arm, own): the scan to use for each row of features (table_name, has_index, selectivity); 0 sequential, 1 by index.

    Feedback (arm, table_name, ms) counts for all tables together, or for a table alone once both its arms have LEAST_IN_TABLE pulls (own). Rewards are
    whole ten-thousandths, so no order of rows changes a choice; on a tie the sequential scan is chosen. A table without feedback goes by the sums of all.
    """
    pulls = lambda a: F.count_if(F.col("arm") == a)
    won = lambda a: F.coalesce(F.sum(F.when(F.col("arm") == a, _units(F.col("ms")))), F.lit(0))
    each = feedback.groupBy("table_name").agg(pulls(0).alias("p0"), pulls(1).alias("p1"), won(0).alias("r0"), won(1).alias("r1"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.upper() + "_all")
    every = each.agg(*map(total, ("p0", "p1", "r0", "r1")))
    t = features.join(each, "table_name", "left").fillna(0, ["p0", "p1", "r0", "r1"]).crossJoin(F.broadcast(every))
    n = F.col("P0_all") + F.col("P1_all")
    own = (F.col("p0") >= LEAST_IN_TABLE) & (F.col("p1") >= LEAST_IN_TABLE)
    mean = lambda r, p: F.when(F.col(p) > 0, F.col(r) / 10000.0 / F.col(p)).otherwise(0.0)
    score = [F.when(own, ucb1(mean(f"r{a}", f"p{a}"), F.col(f"p{a}"), n)).otherwise(ucb1(mean(f"R{a}_all", f"P{a}_all"), F.col(f"P{a}_all"), n)) for a in (0, 1)]
    seq, index = mean("R0_all", "P0_all"), mean("R1_all", "P1_all")
    best = F.when(score[1] > score[0], 1).otherwise(0)
    nudged = (
        F.when((F.col("selectivity") < FEW) & (best == 0) & (index > 0) & (index > seq * NEAR), 1)
        .when((F.col("selectivity") > MANY) & (best == 1) & (seq > 0) & (seq > index * NEAR), 0)
        .otherwise(best)
    )
    arm = (
        F.when(~F.col("has_index"), 0)
        .when(n < LEAST_TOTAL, F.when(n % 2 == 0, 1).otherwise(0))
        .when(F.col("P0_all") < LEAST_PULLS, 0)
        .when(F.col("P1_all") < LEAST_PULLS, 1)
        .otherwise(nudged)
    )
    return t.select("table_name", arm.cast("int").alias("arm"), own.alias("own"))


def plan_arms(feedback: DataFrame) -> DataFrame:
    """(kind, arm, pulls, avg_reward, ucb) of the filter orders (0 as written, 1 by selectivity, 2 by cost) and limits (0 whole, 1 early end).

    Feedback: filter_arm, limit_arm, n_conditions, had_limit, had_order, ms. A query speaks for a filter order if it has several conditions, for a
    limit if it has one and no order; for both it counts twice.
    """
    kinds = F.array_compact(
        F.array(
            F.when(F.col("n_conditions") > 1, F.struct(F.lit("filter").alias("kind"), F.col("filter_arm").alias("arm"))),
            F.when(F.col("had_limit") & ~F.col("had_order"), F.struct(F.lit("limit").alias("kind"), F.col("limit_arm").alias("arm"))),
        )
    )
    each = feedback.select(F.explode(kinds).alias("k"), _units(F.col("ms")).alias("won")).groupBy("k.kind", "k.arm").agg(F.count(F.lit(1)).alias("pulls"), F.sum("won").alias("won"))
    totals = each.groupBy("kind").agg(F.sum("pulls").alias("n"))
    s = each.join(F.broadcast(totals), "kind").withColumn("avg_reward", F.col("won") / 10000.0 / F.col("pulls"))
    return s.select("kind", "arm", "pulls", "avg_reward", ucb1(F.col("avg_reward"), F.col("pulls"), F.col("n")).alias("ucb"))


# ---- one query


def selectivity(conditions: tuple[Condition, ...]) -> float:
    """The share of rows that conditions are taken to keep, each by its operator; IN keeps all."""
    return math.prod((SELECTIVITY.get(c.op, 1.0) for c in conditions), start=1.0)


def features(s: Select, rows: int, n_columns: int, indexed: frozenset[str] = frozenset()) -> dict[str, float]:
    """What marks a query for the choice of its scan; the size of its table is log2 of its rows, 0 if it has none."""
    first = s.where[0] if s.where else None
    return {
        "log2_rows": math.log2(rows) if rows > 0 else 0.0,
        "conditions": float(len(s.where)),
        "first_is_equality": float(first is not None and first.op == "="),
        "has_index": float(first is not None and first.left.column.split(".")[-1] in indexed),
        "selectivity": selectivity(s.where),
        "columns": float(n_columns if any(i.column == "*" and not i.aggregate for i in s.items) else len(s.items)),
        "ordered": float(bool(s.order)),
        "limited": float(s.limit > 0),
    }


def filter_order(conditions: tuple[Condition, ...], arm: int, learned: dict[tuple[str, str], float] | None = None) -> list[int]:
    """The order to evaluate conditions in: as written, by the share of rows they keep (learned by column and operator, else 0.5), or by cost."""
    keys = {
        0: lambda i: 0,
        1: lambda i: (learned or {}).get((conditions[i].left.column, conditions[i].op), 0.5),
        2: lambda i: COST.get(conditions[i].op, 2.0),
    }
    return sorted(range(len(conditions)), key=keys[arm])


# ---- one session


class Bandit:
    """Pulls and rewards (ten-thousandths) of each scan, in all and by table: the rules of ``choose_by_table``, one execution at a time."""

    def __init__(self):
        self.pulls, self.won = [0, 0], [0, 0]
        self.tables: dict[str, list[list[int]]] = {}

    def record(self, arm: int, table: str, ms: float) -> None:
        won = int(10000 / (1 + ms / 100))
        self.pulls[arm] += 1
        self.won[arm] += won
        own = self.tables.setdefault(table, [[0, 0], [0, 0]])
        own[arm][0] += 1
        own[arm][1] += won

    def mean(self, arm: int) -> float:
        return self.won[arm] / 10000 / self.pulls[arm] if self.pulls[arm] else 0.0

    def _score(self, won: int, pulls: int) -> float:
        return won / 10000 / pulls + EXPLORE * math.sqrt(math.log(sum(self.pulls)) / pulls) if pulls else math.inf

    def ready(self) -> bool:
        return sum(self.pulls) >= LEAST_TOTAL

    def choose(self, table: str, has_index: bool, kept: float = 1.0) -> int:
        if not has_index:
            return 0
        if not self.ready():
            return int(sum(self.pulls) % 2 == 0)
        for arm in (0, 1):
            if self.pulls[arm] < LEAST_PULLS:
                return arm
        own = self.tables.get(table)
        if own and all(p >= LEAST_IN_TABLE for p, _ in own):
            scores = [self._score(won, p) for p, won in own]
        else:
            scores = [self._score(self.won[a], self.pulls[a]) for a in (0, 1)]
        best = int(scores[1] > scores[0])
        other = 1 - best
        leans = kept < FEW if other else kept > MANY
        return other if leans and 0 < self.mean(other) and self.mean(other) > NEAR * self.mean(best) else best

    def decay(self, factor: float) -> None:
        """Leaves a share of what was learned; a table's arm with fewer than two pulls is forgotten, and 0 forgets all."""
        if factor >= 1:
            return
        cut = lambda n: int(n * max(factor, 0.0))
        self.pulls, self.won = [*map(cut, self.pulls)], [*map(cut, self.won)]
        shrunk = {t: [[cut(p), cut(w)] if cut(p) >= 2 else [0, 0] for p, w in arms] for t, arms in self.tables.items()}
        self.tables = {t: arms for t, arms in shrunk.items() if arms != [[0, 0], [0, 0]]}

    def stats(self) -> list[tuple[str, int, float, float]]:
        """(scan, pulls, mean reward, score) of both arms."""
        return [(SCANS[a], self.pulls[a], self.mean(a), self._score(self.won[a], self.pulls[a])) for a in (0, 1)]

    def dumps(self) -> str:
        return json.dumps({"pulls": self.pulls, "won": self.won, "tables": self.tables})

    @classmethod
    def loads(cls, text: str) -> Bandit:
        out, state = cls(), json.loads(text)
        out.pulls, out.won, out.tables = state["pulls"], state["won"], state["tables"]
        return out
