"""Connected components and star-shaped candidate links, for the near-duplicate operators.

Everything here is joins and partial aggregates on narrow rows; each round's edges are written to the shared folder,
which cuts the lineage, and only counts reach the driver. A hub may stand in a third of all rows: least neighbours and
group sizes are partial aggregates, and they are joined back by :func:`join_sums`, whose large partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftwell.llm.common import materialise

#: Groups of up to so many rows compare all rows of different components after the first round; larger ones use hubs.
SMALL_GROUP = 12
HUB_ROUNDS = 3


def join_sums(rows: DataFrame, sums: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with an aggregate of one row for each ``key``.

    The join is by a hash of the key. An aggregate is already dealt out by its key, and a join on that key would read it
    as it lies, so that the partition of a hot key couldn't be split; this way both sides are dealt out for the join.
    """
    mine = sums.select(F.xxhash64(key).alias("_at"), F.col(key).alias("_key"), *(c for c in sums.columns if c != key))
    return rows.join(mine, (F.xxhash64(key) == F.col("_at")) & (F.col(key) == F.col("_key")), how).drop("_at", "_key")


def _star(edges: DataFrame) -> DataFrame:
    """One small-star and one large-star step on edges ``(u, v)`` with ``u > v``.

    Small-star: a vertex and its smaller neighbours move to the least of these. Large-star: every larger neighbour of a
    vertex moves to the least of its neighbourhood, which is its own smaller neighbour, if it has one.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    low = join_sums(edges, least, "u")
    pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    small = low.select(F.explode(pairs).alias("p")).select("p.u", "p.v").filter(F.col("u") != F.col("v")).distinct()
    up = small.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
    return join_sums(small, up, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``edges (a, b)``: the least id reachable. Any orderable type of id.

    Rounds of both star steps until nothing changes; how many edges a round leaves, and a sum of their hashes, are
    observed while it is written.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("h")), "components")
        return out, (seen.get["n"], seen.get["h"])

    clean = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, was = written(clean)
    while was[0]:
        now, mark = written(_star(now))
        if mark == was:
            break
        was = mark
    own = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)


def with_hubs(rows: DataFrame) -> DataFrame:
    """``rows (key, id, ...)`` of the keys of two ids or more, with ``n``, how many ids the key has, ``hub``, the least, and ``top``, the greatest."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub"), F.max("id").alias("top")).filter("n > 1")
    return join_sums(rows, sizes, "key")


def cross_pairs(left: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` of one key and different components, of ``left (key, id, component)``."""
    other = left.select("key", F.col("id").alias("b"), F.col("component").alias("other"))
    return left.join(other, "key").filter((F.col("id") < F.col("b")) & (F.col("component") != F.col("other"))).select(F.col("id").alias("a"), "b")


def link_groups(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], rounds: int = HUB_ROUNDS, rest: Callable[[DataFrame], DataFrame] = cross_pairs) -> DataFrame:
    """Confirmed links ``(a, b)`` between members of the same groups: two members that share a key and are like each
    other are linked or in one component.

    ``members (key, id, n, hub, top)`` are rows of :func:`with_hubs`, written. ``confirm`` takes pairs ``(a, b)`` and keeps the true
    ones. Round 0 pairs each member with its group's least id, and in large groups with the greatest as well, so a group
    of n gives 2 n pairs at most. A hub need not be like all members, so further ``rounds`` look at the groups that still
    span several components: small groups pair all members of different components; in larger ones another member, drawn
    by a hash of the key, becomes the hub. Large groups (without rounds, all) that still span several components then go
    to ``rest (key, id, component)``, which must return every pair of a key and different components that ``confirm``
    could keep.
    """
    hubs = F.when(F.col("n") > SMALL_GROUP, F.array("hub", "top")).otherwise(F.array("hub"))
    pairs = members.select("id", F.explode(hubs).alias("to")).filter(F.col("id") != F.col("to"))
    pairs = materialise(pairs.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct(), "pairs")
    links = materialise(confirm(pairs), "links")
    tried = pairs

    def torn_groups(turn: int) -> DataFrame:
        parts = connected_components(links)
        placed = members.join(parts, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
        torn = placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("id", "component"), F.xxhash64("id", "key", F.lit(turn))).alias("to")
        ).filter("low != high").select("key", "to")
        return join_sums(placed, torn, "key")

    def untried(found: DataFrame) -> DataFrame:
        fresh = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return materialise(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")

    for turn in range(1, rounds + 1):
        placed = materialise(torn_groups(turn), "torn-groups")
        large = placed.filter((F.col("n") > SMALL_GROUP) & (F.col("to.component") != F.col("component"))).select(F.col("to.id").alias("a"), F.col("id").alias("b"))
        fresh = untried(large if turn > 1 else large.unionByName(cross_pairs(placed.filter(F.col("n") <= SMALL_GROUP).select("key", "id", "component"))))
        if not fresh.isEmpty():
            links = links.unionByName(materialise(confirm(fresh), "links"))
            tried = tried.unionByName(fresh)
    left = materialise(torn_groups(0).filter(F.col("n") > (SMALL_GROUP if rounds else 1)).select("key", "id", "component"), "torn-groups")
    if left.isEmpty():
        return links
    return links.unionByName(materialise(confirm(untried(rest(left))), "links"))
