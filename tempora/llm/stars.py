"""Connected groups of similar rows from shared keys, without all pairs of a key.

Rows that share a key are tied to the key's least row first, and these pairs are verified. Only where that leaves a key's rows in several
groups are its rows of different groups compared as well. A key that too many rows share is first split by further numbers of the
rows' fingerprints, which joins most of its groups at little cost. Where a large key's rows still are in several groups then, all its rows of
different groups are compared, block by block, so that no pair that shares a key is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import components, drop_staged, staged

#: The columns of memberships: a group of rows that share a key, a row, the group's least row, whether the group is small, and whether it is all of a large key.
MET = "grp long, node long, lead long, small boolean, large boolean"
#: Rows of a large key (about) that a task compares with as many others.
BLOCK = 512


def met_in(key: np.ndarray, node: np.ndarray, further: list[np.ndarray], small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, row, least row, whether small) of every row that shares its key with another; a key's nodes differ, and keys leave eight bits free."""
    out, rows, base = [], np.arange(len(key)), 0
    key = key.astype(np.uint64)
    for more in [*further, None]:
        order = rows[np.lexsort((node[rows], key[rows]))]
        k = key[order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(k)])
        group, lead = np.repeat(np.arange(len(starts)), sizes), order[np.repeat(starts, sizes)]
        of = np.repeat(sizes, sizes)
        two = of > 1
        out.append((group[two] + base, order[two], lead[two], (of <= small)[two]))
        many = of > small
        base += len(starts)
        if more is None or not many.any():
            break
        rows = order[many]
        key[rows] = group[many].astype(np.uint64) << np.uint64(8) | more[rows].astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def met(part: int, key: np.ndarray, node: np.ndarray, further: list[np.ndarray], small: int) -> pa.Table:
    """The memberships of a part's rows, as MET has them."""
    group, row, lead, few = met_in(key, node, further, small)
    large = ~few & (group < len(np.unique(key)))  # the keys themselves are numbered before their parts
    return pa.table({"grp": pa.array(group.astype(np.int64) | part << 40), "node": pa.array(node[row]), "lead": pa.array(node[lead]), "small": pa.array(few), "large": pa.array(large)})


def blocks(members: DataFrame) -> DataFrame:
    """(grp, i, j, b, node, root): the rows of members (grp, node, root) for each pair of blocks that has to be compared; b, the row's own block, is i or j.

    The rows of a group's most frequent root are all linked: their blocks meet those of the others only. Groups of one root are left out.
    """
    sizes = members.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(F.sum("c").alias("n"), F.max("c").alias("m"), F.max_by("root", F.struct("c", "root")).alias("mode"), F.count(F.lit(1)).alias("k"))
    one = F.col("n") <= BLOCK
    sizes = sizes.filter("k > 1").select("grp", "mode", F.when(one, 1).otherwise(F.ceil((F.col("n") - F.col("m")) / BLOCK)).alias("others"), F.when(one, 0).otherwise(F.ceil(F.col("m") / BLOCK)).alias("same"))
    number = F.xxhash64("node", F.lit(5))
    b = F.when((F.col("same") > 0) & (F.col("root") == F.col("mode")), F.col("others") + F.pmod(number, F.greatest("same", F.lit(1)))).otherwise(F.pmod(number, "others"))
    rows = members.join(sizes, "grp").withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") + F.col("same") - 1)))
    return rows.filter(F.least("b", "o") < F.col("others")).select("grp", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", "root")


def _by_pairs(verify: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def rest(rows: DataFrame) -> DataFrame:
        left = rows.filter("b = i").select("grp", "i", "j", F.col("node").alias("x"), F.col("root").alias("r"))
        right = rows.filter("b = j").select("grp", "i", "j", F.col("node").alias("y"), F.col("root").alias("s"))
        return verify(left.join(right, ["grp", "i", "j"]).filter("r <> s").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    return rest


def roots(memberships: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of the connected groups of the pairs (a, b) that verify() lets through; nodes without one don't appear.

    rest() gives, of rows as blocks() has them, links (a, b) that join all groups which any verified pair of a block pair would join.
    """
    ties = memberships.filter("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    good = staged(verify(ties))
    first = staged(components(good))
    of = first.select(F.col("node").alias("n"), "root")
    members = memberships.filter("small").select("grp", "node")
    members = members.join(of, members.node == of.n, "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
    members = staged(members)
    mixed = members.groupBy("grp").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("c")).filter("x <> y AND c > 2").select("grp")
    left = members.join(mixed, "grp")
    right = left.select("grp", F.col("node").alias("b"), F.col("root").alias("s"))
    # rows of different groups, at most `small` rows a key; ties are known already
    across = left.join(right, "grp").filter("root < s").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    across = across.join(ties, ["a", "b"], "left_anti")
    both = staged(good.union(verify(across)))
    out = staged(components(both))
    for x in (first, members):
        drop_staged(x)
    # what neither ties nor parts of a large key have joined: the groups that its rows are in now
    of = out.select(F.col("node").alias("n"), "root")
    members = memberships.filter("large").select("grp", "node")
    members = staged(members.join(of, members.node == of.n, "left").select("grp", "node", F.coalesce("root", "node").alias("root")))
    found = staged((rest or _by_pairs(verify))(blocks(members)))
    drop_staged(members)
    if found.isEmpty():
        return out
    # the groups' roots are few beside all links: only they are joined further
    to = components(found.join(of.toDF("a", "x"), "a", "left").join(of.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    to = staged(to.select(F.col("node").alias("n"), F.col("root").alias("to")))
    new = to.join(out, to.n == out.node, "left_anti").select(F.col("n").alias("node"), F.col("to").alias("root"))
    return out.join(to, out.root == to.n, "left").select("node", F.coalesce("to", "root").alias("root")).union(new)
