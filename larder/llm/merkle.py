"""Merkle manifest of a table: a leaf per row, a tree per source, a tree over the sources.

A leaf is the SHA-256 of the row's fields, each written as ``-`` if null and else as UTF-8 byte count, ``:``
and value. Leaves of a source ascend by id; every 16 consecutive nodes become the hash of their hex digests until
one is left. The subroots, in the order of their sources (null first, bytewise), are reduced alike to the root.

Rows are placed by one range exchange of (source, id, leaf). A superblock is 4096 consecutive leaves of a
source, or several whole sources where they are smaller; a source with a third of all rows is many
superblocks. On the way up each superblock gives one node, and those nodes are superblocks of the next
round. On the way down the nodes of a round are cogrouped with the outer nodes that their superblock
needs, the siblings on its way to the root (at most 15 a level). The last cogroup holds the leaves: it
finishes the local reduction, joins local and outer siblings to proofs and folds the presented leaves. No group
exceeds two superblocks; the driver sees a count of open trees per round and the root.

Rows: null ids come first in their source and are never altered by the query; ties of source and id
are ordered by leaf, and rows equal in all fields are leaves of their own with the same digest; null and
empty texts differ (``-`` and ``0:``); texts of any length are hashed whole; an empty table gives an empty result;
columns that are no field take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import column, stage, union_all
from larder.operators.positions import with_positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 16, 3
BROADCAST_GROUPS = 100_000  # rows of three values; more sources are joined by a shuffle


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hash of length-prefixed fields."""

    def written(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[written(c) for c in fields.values()]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels above ``nodes`` until one is left."""
    h = 0
    while ARITY**h < nodes:
        h += 1
    return h


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and each level above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def _sides(levels: list[list[str]], outer: list[str]) -> list[list[str]]:
    """Siblings of each lowest node up to the root: before and after it, parted by ``|``, one text a level."""
    above = [outer]
    for below in reversed(levels[:-1]):
        mine = []
        for i in range(len(below)):
            first = i - i % ARITY
            mine.append([f"{''.join(below[first:i])}|{''.join(below[i + 1 : first + ARITY])}", *above[i // ARITY]])
        above = mine
    return above


def fold(leaf: str, sides: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for side in sides:
        before, after = side.split("|")
        leaf = digest(before + leaf + after)
    return leaf


def _outer(frame: pd.DataFrame) -> dict[int, tuple[list[str], str]]:
    return {int(t): (list(s), sub) for t, s, sub in zip(frame["of"], frame["sides"], frame["subroot"], strict=True)}


@dataclass(frozen=True)
class Superblocks:
    """Rounds of reduction by superblocks of ``ARITY ** levels`` nodes."""

    levels: int = LEVELS

    @property
    def size(self) -> int:
        return ARITY**self.levels

    def trees(self, frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, list[list[str]]]]:
        """(tree, its rows in order, its levels within the superblock) of a superblock."""
        for tree, rows in frame.sort_values(["tree", "at"]).groupby("tree", sort=False):
            n = int(rows["n"].iloc[0])
            yield int(tree), rows, reduced(rows["node"].tolist(), self.levels if n > self.size else height(n))

    def unit(self, round_: int) -> Column:
        """Superblock of a node: a big tree's is named by its first leaf, small trees lie together by theirs."""
        first = F.col("tree") + F.floor(F.col("at") / self.size) * self.size * self.size**round_
        small = -1 - F.floor(F.col("tree") / self.size) if round_ == 0 else F.col("tree")
        return F.when(F.col("n") > self.size, first).otherwise(small).cast("long")

    def climb(self, leaves: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
        """(nodes of each round, one row per tree: tree, node, last round)."""

        def tops(frame: pd.DataFrame) -> pd.DataFrame:
            out = [
                (tree, int(rows["at"].iloc[0]) // self.size, -(-int(rows["n"].iloc[0]) // self.size), levels[-1][0])
                for tree, rows, levels in self.trees(frame)
            ]
            return pd.DataFrame(out, columns=["tree", "at", "n", "node"])

        rounds, ended = [leaves.withColumn("unit", self.unit(0))], []
        while True:
            nodes = rounds[-1].select("unit", "tree", "at", "n", "node")
            found = stage(nodes.groupBy("unit").applyInPandas(tops, "tree long, at long, n long, node string"), label)
            ended.append(found.filter("n = 1").select("tree", "node", F.lit(len(ended)).alias("last")))
            rest = found.filter("n > 1")
            if rest.isEmpty():
                return rounds, union_all(ended)
            rounds.append(rest.withColumn("unit", self.unit(len(rounds))))

    def handed_down(self, nodes: DataFrame, outer: DataFrame) -> DataFrame:
        """(tree, at, sides, subroot): siblings of each node up to the root."""

        def paths(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            of, out = _outer(known), []
            for tree, mine, levels in self.trees(rows):
                sides, subroot = of[tree]
                out += [(tree, at, s, subroot) for at, s in zip(mine["at"], _sides(levels, sides), strict=True)]
            return pd.DataFrame(out, columns=["tree", "at", "sides", "subroot"])

        nodes = nodes.select("unit", "tree", "at", "n", "node")
        return nodes.groupBy("unit").cogroup(outer.groupBy("unit")).applyInPandas(paths, "tree long, at long, sides array<string>, subroot string")

    def descend(self, rounds: list[DataFrame], outer: DataFrame, label: str) -> DataFrame:
        """Outer nodes of the superblocks of the lowest round, from those of whole trees (tree, last, sides, subroot).

        Their tree is named ``of``: the two sides of a cogroup must share no column, as they come from one table.
        """
        above = None
        for r in reversed(range(len(rounds))):
            bundle = -1 - F.floor(F.col("tree") / self.size) if r == 0 else F.col("tree")
            needed = outer.filter(F.col("last") == r).select(bundle.cast("long").alias("unit"), F.col("tree").alias("of"), "sides", "subroot")
            needed = needed if above is None else needed.unionByName(above)
            if r:
                unit = (F.col("tree") + F.col("at") * self.size**r).alias("unit")
                above = stage(self.handed_down(rounds[r], needed).select(unit, F.col("tree").alias("of"), "sides", "subroot"), label)
        return needed

    def proofs(self, leaves: DataFrame, outer: DataFrame) -> DataFrame:
        """Leaves with their proof and the root that the presented leaf folds to."""

        def prove(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            of, out = _outer(known), []
            for tree, mine, levels in self.trees(rows):
                sides, subroot = of[tree]
                for row, leaf, shown, s in zip(mine["id"], mine["node"], mine["shown"], _sides(levels, sides), strict=True):
                    out.append((row, leaf, subroot, "".join(s).replace("|", ""), fold(shown, s)))
            return pd.DataFrame(out, columns=["id", "leaf", "subroot", "proof", "folded_root"])

        id_type = leaves.schema["id"].dataType.simpleString()
        schema = f"id {id_type}, leaf string, subroot string, proof string, folded_root string"
        return leaves.groupBy("unit").cogroup(outer.groupBy("unit")).applyInPandas(prove, schema)


def _source_outers(trees: DataFrame, blocks: Superblocks) -> tuple[DataFrame, str | None]:
    """(outer nodes of each source's tree, root) from one row per source."""
    placed = stage(with_positions(trees, ["tree"], "at").withColumnRenamed("tree", "source_tree"), "merkle-sources")
    total = placed.count()
    nodes = placed.select(F.lit(0).cast("long").alias("tree"), "at", F.lit(total).cast("long").alias("n"), "node")
    rounds, top = blocks.climb(nodes, "merkle-sources")
    root = top.first()
    above = top.select("tree", "last", F.array().cast("array<string>").alias("sides"), F.lit("").alias("subroot"))
    found = blocks.handed_down(rounds[0], blocks.descend(rounds, above, "merkle-source-paths"))
    joined = placed.join(found.select("at", "sides"), "at")
    return joined.select(F.col("source_tree").alias("tree"), "last", "sides", F.col("node").alias("subroot")), root and root["node"]


def manifest(
    docs: DataFrame,
    shown: dict[str, Column] | None = None,
    altered: Column | None = None,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    blocks: Superblocks = Superblocks(),
) -> DataFrame:
    """(id_col, leaf, subroot, root, proof, folded_root): proof of each row and what its presented form folds to.

    ``shown`` gives fields as a holder presents them where ``altered`` is true; other rows are presented as they are.
    ``proof`` joins the siblings of each level up to the root, left to right.
    """
    own = {f: column(f) for f in fields}
    leaf = leaf_hash(own)
    presented = leaf_hash(own | shown) if shown else None
    if presented is not None and altered is not None:
        presented = F.when(altered, presented)
    narrow = docs.select(
        column(id_col).alias("id"),
        column(group_col).cast("string").alias("source"),
        leaf.alias("node"),
        (F.lit(None).cast("string") if presented is None else presented).alias("shown"),
    )
    placed = with_positions(stage(narrow, "merkle-leaves"), ["source", "id", "node"], "position")
    sources = stage(placed.groupBy("source").agg(F.min("position").alias("tree"), F.count("*").alias("n")), "merkle-sources")
    small = sources.count() <= BROADCAST_GROUPS
    named = sources.withColumnRenamed("source", "of")
    leaves = placed.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("of")))
    leaves = leaves.select("id", "node", F.coalesce("shown", "node").alias("shown"), "tree", (F.col("position") - F.col("tree")).alias("at"), "n")
    rounds, trees = blocks.climb(leaves, "merkle-tops")
    outers, root = _source_outers(stage(trees, "merkle-subroots"), blocks)
    needed = blocks.descend(rounds, stage(outers, "merkle-outers"), "merkle-paths")
    proved = blocks.proofs(rounds[0], needed)
    return proved.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof", "folded_root")
