"""Queries of trees by identifier over the shared tables, with their DuckDB SQL.

Parts are a tree with six children a node in which siblings often share a name; the first 5,000 orders are
a chain; some parts are their own parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import intervals, nodes, walk
from siltstone.sources import tables as S

CHAIN = 5_000


def _part_tree(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    up = F.when(k % 397 == 396, k).when(k > 1, F.expr("(p_partkey + 4) div 6"))
    name = F.when(k % 211 == 1, "").otherwise(F.concat(F.lit("b"), (k % 4).cast("string")))
    return S.table(spark, sf, "part").select(k.alias("id"), up.alias("parent"), name.alias("name"))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    chain = S.table(spark, sf, "orders").filter(k < CHAIN).select((-k - 1).alias("id"), F.when(k > 0, -k).alias("parent"), F.lit("c").alias("name"))
    return _part_tree(spark, sf).unionByName(chain)


_PARTS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 397 = 396 THEN p_partkey WHEN p_partkey > 1 THEN (p_partkey + 4) // 6 END AS parent, CASE WHEN p_partkey % 211 = 1 THEN '' ELSE 'b' || (p_partkey % 4) END AS name FROM part"
_NODES = f"""n AS ({_PARTS} UNION ALL SELECT -o_orderkey - 1, CASE WHEN o_orderkey > 0 THEN -o_orderkey END, 'c' FROM orders WHERE o_orderkey < {CHAIN}),
d AS (SELECT id, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, d.depth + 1 FROM d JOIN n ON n.parent = d.id)"""


def node_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with its depth and the size of its subtree, and the largest id and the sum of ids in it."""
    tree = _tree(spark, sf)
    labels = intervals.intervals(tree)
    ids = tree.select("id", F.col("id").alias("v"))
    sums = intervals.subtree_sums(labels, ids, "v").withColumnRenamed("v", "total")
    most = intervals.subtree_best(labels, ids, F.max("v").alias("v")).withColumnRenamed("v", "largest")
    return labels.select("id", "depth", (F.col("at") - F.col("low") + 1).alias("nodes")).join(sums, "id").join(most, "id")


def node_members(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.members(_part_tree(spark, sf))


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of all parts down to the fourth level by their keys alone, most of which exist, and some that do not."""
    k = F.col("p_partkey")
    name = lambda n: F.when(n % 211 == 1, "").otherwise(F.concat(F.lit("b"), (n % 4).cast("string")))
    up = lambda n: F.floor((n + 4) / 6)
    steps = [up(up(up(k))), up(up(k)), up(k), k]
    path = F.concat_ws("/", *[F.nullif(name(n), F.lit("")) for n in steps])
    return S.table(spark, sf, "part").select(F.concat(path, F.when(k % 5 == 0, "/none").otherwise("")).alias("path")).distinct()


_UP = "(({}) + 4) // 6"
_NAME = "CASE WHEN ({0}) % 211 = 1 THEN '' ELSE 'b' || (({0}) % 4) END"
_STEPS = [_UP.format(_UP.format(_UP.format("p_partkey"))), _UP.format(_UP.format("p_partkey")), _UP.format("p_partkey"), "p_partkey"]
_WANTED = "SELECT DISTINCT concat_ws('/', " + ", ".join(f"nullif({_NAME.format(s)}, '')" for s in _STEPS) + ") || CASE WHEN p_partkey % 5 = 0 THEN '/none' ELSE '' END AS path FROM part"


def node_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.resolve(_wanted(spark, sf), _part_tree(spark, sf))


ODD_NAMES = [".hidden", "Duplicates", "Holiday.photoslibrary", "plain", "App.app", "link", "docs", "x.logicx", "DUPLICATES", "more"]


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Folders are parts, in a tree; files are orders, dealt to folders; every name has its key but those of odd folders."""
    k = F.col("p_partkey")
    pick = F.element_at(F.array(*[F.lit(n) for n in ODD_NAMES]), (k % len(ODD_NAMES) + 1).cast("int"))
    name = F.when(k % 7 == 0, pick).otherwise(F.concat(F.lit("d"), k.cast("string")))
    none = F.lit(None).cast("string")
    dirs = S.table(spark, sf, "part").select(k.alias("id"), F.when(k > 0, F.expr("(p_partkey + 2) div 3 - 1")).alias("parent"), name.alias("name"), F.lit(True).alias("is_dir"), (k % 31 == 30).alias("is_link"), none.alias("reason"))
    o, total = F.col("o_orderkey"), S.table(spark, sf, "part").count()
    file = F.when(o % 17 == 0, F.concat(F.lit("."), o.cast("string"))).otherwise(F.concat(F.lit("f"), o.cast("string")))
    reason = F.when(F.col("o_totalprice") < 2_000, "empty").when(F.col("o_orderstatus") == "P", "recently-modified")
    files = S.table(spark, sf, "orders").select((-o - 1).alias("id"), (o * 7 % total).alias("parent"), file.alias("name"), F.lit(False).alias("is_dir"), (o % 41 == 40).alias("is_link"), reason.alias("reason"))
    return dirs.unionByName(files)


_ENTRIES = f"""e AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey + 2) // 3 - 1 END AS parent, CASE WHEN p_partkey % 7 = 0 THEN ({ODD_NAMES})[1 + p_partkey % {len(ODD_NAMES)}] ELSE 'd' || p_partkey END AS name, true AS is_dir, p_partkey % 31 = 30 AS is_link, NULL::VARCHAR AS reason FROM part
UNION ALL SELECT -o_orderkey - 1, o_orderkey * 7 % (SELECT count(*) FROM part), CASE WHEN o_orderkey % 17 = 0 THEN '.' || o_orderkey ELSE 'f' || o_orderkey END, false, o_orderkey % 41 = 40, CASE WHEN o_totalprice < 2000 THEN 'empty' WHEN o_orderstatus = 'P' THEN 'recently-modified' END FROM orders),
c AS (SELECT *, CASE WHEN NOT is_dir THEN NULL WHEN name LIKE '.%' THEN 'hidden' WHEN lower(name) = 'duplicates' THEN 'quarantine' WHEN regexp_matches(lower(name), '\\.(photoslibrary|musiclibrary|tvlibrary|aplibrary|pkpass|app|bundle|framework|plugin|rtfd|fcpbundle|imovielibrary|logicx|band)$') THEN 'bundle' WHEN is_link THEN 'link' END AS why FROM e),
w AS (SELECT id, '' AS rel, 0 AS depth FROM c WHERE id = 0 UNION ALL SELECT c.id, CASE WHEN w.rel = '' THEN c.name ELSE w.rel || '/' || c.name END, w.depth + 1 FROM w JOIN c ON c.parent = w.id WHERE c.is_dir AND c.why IS NULL AND w.depth < 6),
m AS (SELECT c.id, CASE WHEN w.rel = '' THEN c.name ELSE w.rel || '/' || c.name END AS rel, w.rel AS dir_rel, is_dir, CASE WHEN is_dir THEN coalesce(why, CASE WHEN w.depth >= 6 THEN 'too-deep' END) WHEN is_link THEN 'symlink' ELSE reason END AS reason
  FROM c JOIN w ON w.id = c.parent WHERE c.id <> 0 AND (is_dir OR name NOT LIKE '.%'))"""


def walked_entries(spark: SparkSession, sf: str) -> DataFrame:
    return walk.walk(_entries(spark, sf), 0, cap=6)


def walk_skips(spark: SparkSession, sf: str) -> DataFrame:
    return walk.skips(walk.walk(_entries(spark, sf), 0, cap=6))


QUERIES = {f.__name__: f for f in (node_intervals, node_members, node_lookup, walked_entries, walk_skips)}
ORACLE_SQL = {
    "node_intervals": f"""
WITH RECURSIVE {_NODES},
c AS (SELECT id AS ancestor, id FROM d UNION ALL SELECT c.ancestor, n.id FROM c JOIN n ON n.parent = c.id)
SELECT ancestor AS id, any_value(d.depth)::BIGINT AS depth, count(*) AS nodes, sum(c.id)::BIGINT AS total, max(c.id) AS largest FROM c JOIN d ON d.id = ancestor GROUP BY 1""",
    "node_members": f"""
WITH RECURSIVE n AS ({_PARTS}), d AS (SELECT id FROM n WHERE parent IS NULL UNION ALL SELECT n.id FROM d JOIN n ON n.parent = d.id),
c AS (SELECT id AS ancestor, id, 0::BIGINT AS depth FROM d UNION ALL SELECT c.ancestor, n.id, c.depth + 1 FROM c JOIN n ON n.parent = c.id)
SELECT ancestor, id, depth FROM c""",
    "node_lookup": f"""
WITH RECURSIVE n AS ({_PARTS}), p AS (SELECT id, name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, CASE WHEN n.name = '' THEN p.path WHEN p.path = '' THEN n.name ELSE p.path || '/' || n.name END FROM p JOIN n ON n.parent = p.id),
k AS (SELECT path, min(id) AS id FROM p WHERE path <> '' GROUP BY 1)
SELECT w.path, k.id FROM ({_WANTED}) w LEFT JOIN k USING (path)""",
    "walked_entries": f"WITH RECURSIVE {_ENTRIES} SELECT * FROM m WHERE NOT is_dir OR reason IS NOT NULL",
    "walk_skips": f"WITH RECURSIVE {_ENTRIES} SELECT reason, count(*) AS entries FROM m WHERE reason IS NOT NULL GROUP BY 1",
}
