"""Trees by identifier: every node gets the interval of its subtree, and needs no path.

The tree's Euler tour enters and leaves each node once. Each of these steps knows the step that comes
next from its node, its first child and its next sibling alone; pointer doubling over the steps then
gives every step the number of nodes that are entered from it on. `at` is that number where a node is
entered, so nodes of a tree are numbered from its end, and the subtree of a node holds exactly the nodes
with `low` <= at <= its own. Names, equal siblings and depth do not matter; a tree of n folders takes
about log2(2 n) rounds, and rounds go on while the number of open steps falls.

Membership is a range join on intervals. An interval is cut into aligned blocks of up to 2 ** LEVELS
numbers, a node lies in one block of each size, and the two meet by equality: no block holds more than
2 ** LEVELS nodes, however large a subtree is. Sums over subtrees are two values of a running sum, which
is taken over blocks first. Only folders go through the rounds; files meet their folder's row.

Defined cases: a null or missing parent is a root; a node on a cycle, or below one, is in no tree and is
left out; ids are unique; siblings are in order of id; an empty table gives no rows; other columns are
not read. Tables between rounds lie in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import kept

#: The largest aligned block of a range join has 2 ** LEVELS numbers; a running sum is taken over blocks of so many.
LEVELS, SUM_BLOCK = 10, 1 << 16


def next_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent) with `next`, the sibling of the next larger id. Rows are sorted by range over all
    tasks, so a folder of any size is spread; the row after a task's last one is a later task's first."""
    placed = kept(nodes.repartitionByRange("parent", "id").select("*", F.spark_partition_id().alias("_part")), "siblings")
    inside = Window.partitionBy("_part").orderBy("parent", "id")
    near = placed.withColumns({"_id": F.lead("id").over(inside), "_up": F.lead("parent").over(inside)})
    firsts = placed.groupBy("_part").agg(F.min(F.struct("parent", "id")).alias("_first"))  # a row a task
    after = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"))
    met = near.join(F.broadcast(after), "_part", "left")
    up, own = F.when(F.col("_id").isNotNull(), F.col("_up")).otherwise(F.col("_after.parent")), F.coalesce("_id", "_after.id")
    return met.select("id", "parent", F.when(up == F.col("parent"), own).alias("next"))


def intervals(nodes: DataFrame) -> DataFrame:
    """(id, root, at, low, depth) of nodes (id, parent) that are in a tree."""
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    rows = kept(nodes.select("id", "parent").join(known, "parent", "left").select("id", F.when(F.col("_there"), F.col("parent")).alias("parent")), "nodes")
    below = rows.filter("parent is not null")
    first = below.groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("_first"))
    beside = next_siblings(below).select("id", "next")
    steps = rows.join(first, "id", "left").join(beside, "id", "left")
    enter = steps.select("id", F.lit(False).alias("out"), F.coalesce("_first", "id").alias("to"), F.col("_first").isNull().alias("to_out"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d"))
    leave = steps.select("id", F.lit(True).alias("out"), F.coalesce("next", "parent").alias("to"), F.col("next").isNull().alias("to_out"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"))
    state = kept(enter.unionByName(leave).withColumn("end", F.when(F.col("to").isNull(), F.col("id"))), "tour")
    open_steps = state.filter("to is not null").count()
    while open_steps:
        there = state.select(F.col("id").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("_to"), F.col("to_out").alias("_out"), F.col("n").alias("_n"), F.col("d").alias("_d"), F.col("end").alias("_end"))
        moved = state.filter("to is not null").join(there, ["to", "to_out"]).select("id", "out", F.col("_to").alias("to"), F.col("_out").alias("to_out"), (F.col("n") + F.col("_n")).alias("n"), (F.col("d") + F.col("_d")).alias("d"), F.col("_end").alias("end"))
        state = kept(state.filter("to is null").unionByName(moved), "tour")
        left = state.filter("to is not null").count()
        if left == open_steps:  # steps that never end are on cycles
            break
        open_steps = left
    of_step = lambda test, c: F.max(F.when(test, F.col(c)))
    ended = state.filter("to is null").groupBy("id").agg(F.max("end").alias("root"), of_step(~F.col("out"), "n").alias("at"), (of_step(F.col("out"), "n") + 1).alias("low"), (-of_step(~F.col("out"), "d")).alias("depth"))
    return kept(ended, "intervals")


def _pieces(low: str, high: str) -> Column:
    """The aligned blocks (level, block) that make up low to high: at most two of each size below the
    largest, and as many of the largest as there are. The ends of a size k are ceil(low / 2^k) and
    floor((high + 1) / 2^k)."""
    l, r = f"-shiftright(-{low}, k)", f"shiftright({high} + 1L, k)"
    odd = lambda x: f"(({x}) & 1L) = 1L"
    left = f"if({odd(l)} and {l} < {r}, struct(k as level, {l} as block), null)"
    right = f"if({odd(r)} and {l} + (({l}) & 1L) < {r}, struct(k as level, {r} - 1L as block), null)"
    small = f"flatten(transform(sequence(0, {LEVELS - 1}), k -> array({left}, {right})))"
    top = f"-shiftright(-{low}, {LEVELS})", f"shiftright({high} + 1L, {LEVELS})"
    large = f"if({top[0]} < {top[1]}, transform(sequence({top[0]}, {top[1]} - 1L), b -> struct({LEVELS} as level, b as block)), array())"
    return F.expr(f"filter(concat({small}, {large}), x -> x is not null)")


def _in_blocks(points: DataFrame) -> DataFrame:
    """points (root, at, ..) once for each size of block."""
    return points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("block", F.expr("shiftright(at, level)"))


def members(labels: DataFrame) -> DataFrame:
    """(ancestor, id, depth): every node of every subtree, the top included, and how far down it is."""
    own = labels.select(F.col("id").alias("ancestor"), "root", F.col("depth").alias("_up"), F.inline(_pieces("low", "at")))
    points = _in_blocks(labels.select("root", "at", "id", F.col("depth").alias("_down")))
    return own.join(points, ["root", "level", "block"]).select("ancestor", "id", (F.col("_down") - F.col("_up")).alias("depth"))


def subtree_sums(labels: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """(id, columns..): sums over each node's subtree of values (id, columns..; a row an id, numbers that
    add up exactly); nodes without values count nothing."""
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in columns]
    rows = labels.join(values, "id", "left").select("id", "root", "at", "low", *zero).withColumn("_block", F.floor(F.col("at") / SUM_BLOCK))
    blocks = rows.groupBy("root", "_block").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = Window.partitionBy("root").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("root", "_block", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("root", "_block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = kept(rows.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in columns]).join(starts, ["root", "_block"]).select("id", "root", "at", "low", *[(F.col(f"_in_{c}") + F.col(f"_{c}")).alias(c) for c in columns]), "running")
    below = running.select("root", (F.col("at") + 1).alias("low"), *[F.col(c).alias(f"_{c}") for c in columns])
    met = running.join(below, ["root", "low"], "left")
    return met.select("id", *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns])


def subtree_best(labels: DataFrame, values: DataFrame, *aggregates: Column) -> DataFrame:
    """(id, aggregates..) over each node's subtree of values (id, ..; any rows an id), for aggregates that
    can be taken of each other by name, such as a greatest, a least or whether any is true. Blocks are
    aggregated first, so a subtree meets a row for each of its blocks."""
    points = _in_blocks(labels.select("id", "root", "at").join(values, "id"))
    held = points.groupBy("root", "level", "block").agg(*aggregates)
    own = labels.select("id", "root", F.inline(_pieces("low", "at")))
    return own.join(held, ["root", "level", "block"]).groupBy("id").agg(*aggregates)
