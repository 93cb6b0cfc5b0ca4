"""Mix sources to target weights by Pareto order sampling.

Each source gets a target number of words (water filling: shares by weight, no source above ``max_repeats`` times its
size). Within a source a document's expected number of copies is in proportion to its weight, ``max_repeats`` at most
(water filling again, so that the source's expected words are its target). The whole part of that number is taken for
certain; the fraction is the inclusion probability of one copy more. Documents are ranked by random odds over inclusion
odds, and the first ranks whose words fill what the certain copies leave of the target are taken.

A source may hold a third of all rows: ranks are never sorted source by source. Ranks fall into ``BUCKETS`` ranges;
words are summed by (source, range) with partial aggregates, the running sum goes over this small table, and only the
one range of each source in which the target is reached is ordered row by row.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in the
order of sources; a null weight counts as 1 and one below 0 as 0, and a document of weight 0 is taken only if its source
can't do without it; rows that are equal in id, source and text share a rank and are taken alike, so reruns agree; an empty
table gives an empty result; columns of the input with the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import WORD, materialise

BUCKETS = 4096
#: Weights count in so many steps from one power of two to the next, so that few of them differ.
STEPS = 8
RESULTS = ["size", "source_size", "target", "copies", "taken"]


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``(source, source_size, target)`` of a table ``(source, size)``.

    Weights repeat ``cycle`` over the sources by code point, null last. Water filling in closed form: by rising
    ``max_repeats * size / weight``, sources are full as long as the level that the rest would get is above theirs.
    The table has one row for each source, so windows over all of it are small.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, cycle))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(cycle)).cast("double"))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(max_repeats)))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = F.col("left") / F.col("weight_left")
    full = level * F.col("weight") > F.col("most")
    per = per.withColumns({"full": full, "level": F.max(F.when(~full, level)).over(everything)})
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def length_odds(text_col: str = "text") -> Column:
    """A weight that rises with the length of a text: twice the characters add 1 to it."""
    return F.log2(2.0 + F.coalesce(F.char_length(text_col), F.lit(0)))


def _unit(*cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the columns only."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(2**53))


def _features(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | Column | None, seed: int) -> dict[str, Column]:
    text = F.col(text_col)
    weight = F.lit(1.0) if weight_col is None else F.coalesce((F.col(weight_col) if isinstance(weight_col, str) else weight_col).cast("double"), F.lit(1.0))
    step = F.round(STEPS * F.log2(F.when(weight > 0, weight)))
    return {
        "_source": F.col(source_col),
        "_size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
        "_weight": F.coalesce(F.pow(F.lit(2.0), step / STEPS), F.lit(0.0)),
        "_hash": F.xxhash64(F.col(id_col), F.col(source_col), text),
        "_u": _unit(F.col(id_col), text, F.lit(seed)),
    }


def _scales(slim: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """``targets`` with ``scale``: a document's expected copies are ``scale`` times its weight, ``max_repeats`` at most; null
    if all are taken so often. A table of one row for each source and weight, by falling weight: those that reach
    ``max_repeats`` are the first ones, and the scale is what the target leaves to the others."""
    per = slim.groupBy(F.col("_source").alias("w"), "_weight").agg(F.sum("_size").alias("words")).join(targets, F.col("w").eqNullSafe(F.col("s")))
    falling = Window.partitionBy("s").orderBy(F.desc("_weight"))
    before = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("words") * F.col("_weight")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("scale", F.when(left > 0, (F.col("target") - max_repeats * before) / left))
    fits = per.filter(F.col("scale") * F.col("_weight") <= max_repeats).groupBy(F.col("s").alias("f")).agg(F.max_by("scale", "_weight").alias("scale"))
    return targets.join(fits, F.col("s").eqNullSafe(F.col("f")), "left").drop("f")


def _ranked(rows: DataFrame, per: DataFrame, max_repeats: int) -> DataFrame:
    """Join the sources' figures and add certain copies, rank and range. Rows with no chance of one copy more get
    negative ranges, spread by hash, so that they never meet in one task."""
    rows = rows.join(per, F.col("_source").eqNullSafe(F.col("s")), "left").drop("s")
    most = F.when(F.col("_weight") > 0, F.lit(float(max_repeats))).otherwise(0.0)
    expected = F.coalesce(F.least(F.lit(float(max_repeats)), F.col("scale") * F.col("_weight")), most)
    rows = rows.withColumn("_expected", expected)
    rows = rows.withColumns({"_certain": F.floor("_expected").cast("long"), "_p": F.col("_expected") - F.floor("_expected")})
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    rows = rows.withColumn("_rank", F.when((F.col("_p") > 0) & (F.col("_size") > 0), odds))
    place = F.floor(F.col("_rank") / (1 + F.col("_rank")) * BUCKETS).cast("int")
    return rows.withColumn("_bucket", F.coalesce(place, (-1 - F.pmod(F.col("_hash"), F.lit(BUCKETS))).cast("int")))


def _marks(slim: DataFrame, cycle: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row per source: ``s, source_size, target, scale, edge, last``. Ranges below ``edge`` are taken, and
    in ``edge`` what ranks up to ``last``."""
    sizes = slim.select(F.col("_source").alias("source"), F.col("_size").alias("size"))
    targets = materialise(source_targets(sizes, cycle, max_repeats).withColumnRenamed("source", "s"), "mix-targets")
    per = materialise(_scales(slim, targets, max_repeats), "mix-scales")
    ranked = _ranked(slim, per, max_repeats)

    ranges = ranked.groupBy(F.col("_source").alias("r"), F.col("_bucket").alias("b")).agg(F.sum(F.col("_certain") * F.col("_size")).alias("sure"), F.sum("_size").alias("words"), F.first("target").alias("t"))
    whole = Window.partitionBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.partitionBy("r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("rest", F.col("t") - F.sum("sure").over(whole)).filter(F.col("b") >= 0)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    past = F.col("before") + F.col("words") > F.col("rest")
    edges = ranges.filter(past).groupBy("r").agg(F.min(F.struct("b", "rest", "before")).alias("e")).select("r", "e.*")
    edges = materialise(edges, "mix-edges")

    # The one range of each source in which it reaches its target: the only rows that are put in order.
    fits = ranked.join(edges, F.col("_source").eqNullSafe(F.col("r")) & (F.col("_bucket") == F.col("b")))
    order = Window.partitionBy("r").orderBy("_rank", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    fits = fits.withColumn("done", F.col("before") + F.coalesce(F.sum("_size").over(order), F.lit(0)))
    # A document is taken if that leaves the sum nearer to the target than without it.
    last = fits.filter(F.col("done") + F.col("_size") / 2 <= F.col("rest")).groupBy("r").agg(F.max(F.struct("_rank", "_hash")).alias("last"))
    last = last.withColumnRenamed("r", "l")
    marks = per.join(edges.select("r", F.col("b").alias("edge")), F.col("s").eqNullSafe(F.col("r")), "left")
    marks = marks.join(last, F.col("s").eqNullSafe(F.col("l")), "left").drop("r", "l")
    return materialise(marks, "mix-marks")


def _decided(rows: DataFrame, marks: DataFrame, max_repeats: int) -> DataFrame:
    ranked = _ranked(rows, marks, max_repeats)
    at_edge = (F.col("_bucket") == F.col("edge")) & (F.struct("_rank", "_hash") <= F.col("last"))
    more = (F.col("_bucket") >= 0) & (F.col("edge").isNull() | (F.col("_bucket") < F.col("edge")) | F.coalesce(at_edge, F.lit(False)))
    return ranked.withColumn("_copies", F.col("_certain") + more.cast("long"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | Column | None = None,
    cycle: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken`` (sizes in words)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in _features(docs, id_col, text_col, source_col, weight_col, seed).items()))
    slim = materialise(slim, "mix-sizes")
    result = _decided(slim, _marks(slim, cycle, max_repeats), max_repeats)
    return result.select(
        "doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), F.coalesce("source_size", F.lit(0)).alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | Column | None = None,
    cycle: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_sources` takes it, with the columns of ``docs``.

    What is taken follows from a row and its source's marks alone, so texts are never shuffled. Documents of no words
    are taken as often as their source's certain copies say.
    """
    features = _features(docs, id_col, text_col, source_col, weight_col, seed)
    slim = materialise(docs.select(*(c.alias(k) for k, c in features.items())), "mix-sizes")
    taken = _decided(docs.withColumns(features), _marks(slim, cycle, max_repeats), max_repeats).filter(F.col("_copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
