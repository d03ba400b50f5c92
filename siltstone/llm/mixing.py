"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain -> language -> source. A token budget enters at the root and is
shared by weight among a node's children. A child gets no more than its subtree can supply
(its tokens times `max_epochs`); what it cannot take goes to its siblings by weight, and only what
the whole subtree lacks is seen one level up, because a node never receives more than its supply.
The fill level of each family of siblings has a closed form over their supply-to-weight ratios, so
every level is one window over a table with a row per node.

A leaf with budget b and t tokens repeats all its documents floor(b / t) times and takes the rest
from the next epoch: the documents in that epoch's seeded order whose tokens start before the rest
is used up. The order is by MD5 of seed, epoch and document id. To find where a leaf's prefix ends
without ordering a hot leaf in one task, tokens are first summed over `blocks` ranges of the digest, then
over as many ranges of the one in which the prefix ends; only the last of these is ordered. Documents
meet their leaf's row by shuffle, those of hot leaves by a broadcast of a bounded number of rows.

Defined cases: null domain, language or source are the value ''; a null or empty text has one
token, as every document has at least one; nodes without a weight get `default_weight`; nodes of
zero weight get what their siblings cannot take; repeated ids stand at one place and are chosen
together; an empty table gives no rows; other columns of docs pass through as they are, and only the
names of the three new ones may not be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.joins import hot_split_join

from .common import fresh, written

LEVELS = ["domain", "lang", "source"]


def token_count(text: Column) -> Column:
    """Words between white space, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def share(nodes: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """Water-filling: adds `share` to nodes (parent columns, name, weight, supply, `budget`).

    Children in rising order of supply / weight are filled to the brim while
    supply before + ratio * weight from here on <= budget; all others share what is left by weight.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = [F.col("_ratio").asc(), F.col(name).asc()]
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = by.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumn("_ratio", F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(float("inf"))))
    n = n.withColumns({"_before": F.coalesce(F.sum("supply").over(before), F.lit(0).cast("double")), "_weights": F.sum("weight").over(onward)})
    n = n.withColumn("_full", F.when(F.col("weight") > 0, F.col("_before") + F.col("_ratio") * F.col("_weights") <= F.col(budget)).otherwise(F.lit(False)))
    n = n.withColumns({"_taken": F.coalesce(F.sum(F.when(F.col("_full"), F.col("supply"))).over(by), F.lit(0).cast("double")), "_open": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(by), F.lit(0).cast("double")), "_idle": F.coalesce(F.sum(F.when(F.col("weight") <= 0, F.col("supply"))).over(by), F.lit(0).cast("double"))})
    left = F.greatest(F.lit(0.0), F.col(budget) - F.col("_taken"))
    got = (
        F.when(F.col("_full"), F.col("supply"))
        .when(F.col("weight") > 0, F.least(F.col("supply"), left * F.col("weight") / F.col("_open")))
        .when((F.col("_open") <= 0) & (F.col("_idle") > 0), F.least(F.col("supply"), left * F.col("supply") / F.col("_idle")))
        .otherwise(F.lit(0.0))
    )
    return n.withColumn("share", got).drop("_ratio", "_before", "_weights", "_full", "_taken", "_open", "_idle")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: Column, max_epochs: int, default_weight: float) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `budget`, the tokens each is to give."""

    def weight(level: str) -> Column:
        out = F.lit(float(default_weight))
        for key, w in sorted(weights.get(level, {}).items()):
            out = F.when(F.col(level) == key, F.lit(float(w))).otherwise(out)
        return out

    leaf = leaves.withColumn("supply", (F.col("tokens") * max_epochs).cast("double"))
    total = leaf.agg(F.sum("supply").alias("_all"), F.sum("tokens").alias("_tokens"))
    root = total.select(F.least(F.col("_all"), budget.cast("double")).alias("_budget"))
    known = root.crossJoin(leaf.groupBy("domain").agg(F.sum("supply").alias("supply")))  # one row
    domains = share(known.withColumn("weight", weight("domain")), [], "domain", "_budget").select("domain", F.col("share").alias("_budget"))
    langs = leaf.groupBy("domain", "lang").agg(F.sum("supply").alias("supply")).join(domains, "domain")
    langs = share(langs.withColumn("weight", weight("lang")), ["domain"], "lang", "_budget").select("domain", "lang", F.col("share").alias("_budget"))
    out = share(leaf.join(langs, ["domain", "lang"]).withColumn("weight", weight("source")), ["domain", "lang"], "source", "_budget")
    return out.select(*LEVELS, "tokens", F.floor(F.col("share") + F.lit(1e-6)).cast("long").alias("budget"))


def _leaf(domain: Column, lang: Column, source: Column) -> Column:
    return F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip((domain, lang, source), LEVELS, strict=True)])


def plan_mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, float]],
    seed: int,
    budget_share: float = 1.0,
    max_epochs: int = 1,
    default_weight: float = 1.0,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    id_col: str = "doc_id",
    blocks: int = 256,
) -> tuple[DataFrame, int]:
    """(a row per leaf: tokens, budget, full epochs, `rows` of docs, and the order key up to which the
    next epoch's documents are taken (null: none); the number of rows of docs)."""
    leaf_of = _leaf(domain, F.col(lang), F.col(source))
    thin = written(docs.select(F.col(id_col).alias("id"), leaf_of.alias("leaf"), token_count(F.col(text)).alias("tokens")), "mix-documents")
    total = thin.count()
    counted = thin.groupBy("leaf").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).select("leaf.*", "tokens", "rows")
    planned = budgets(counted, weights, F.floor(F.col("_tokens") * F.lit(budget_share)), max_epochs, default_weight)
    planned = planned.join(counted.select(*LEVELS, "rows"), LEVELS).withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    leaf = written(planned.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).select(F.struct(*LEVELS).alias("leaf"), "tokens", "budget", "epochs", "rest", "rows"), "mix-leaves")
    keyed = hot_split_join(thin, leaf.select("leaf", "epochs", "rest", "rows"), "leaf", "rows", total).filter("rest > 0")
    keyed = keyed.select("leaf", "rest", "tokens", _order_key(seed, F.col("epochs"), F.col("id")).alias("key"))

    def range_of(step: int) -> Column:
        """Which of `blocks` to the power `step` equal ranges the key's first 32 bits lie in."""
        return F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * blocks**step / 2**32)

    # The range in which a leaf's prefix ends, then the range within it: what is left to be ordered is
    # a blocks-squared part of the leaf.
    at = keyed.withColumn("start", F.lit(0).cast("long"))
    for step in (1, 2):
        at = at.withColumn("block", range_of(step))
        sums = at.groupBy("leaf", "rest", "start", "block").agg(F.sum("tokens").alias("n"), F.count("*").alias("_rows"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("leaf").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("start")
        last = sums.withColumn("_start", before).withColumn("_all", F.sum("_rows").over(Window.partitionBy("leaf"))).filter("_start < rest and _start + n >= rest")
        met = hot_split_join(at.drop("start"), last.select("leaf", F.col("block").alias("_block"), F.col("_start").alias("start"), F.col("_all").alias("_rows")), "leaf", "_rows", total)
        at = written(met.filter("block = _block").select("leaf", "rest", "start", "tokens", "key"), "mix-range")
    places = at.groupBy("leaf", "rest", "start", "key").agg(F.sum("tokens").alias("n"))
    within = Window.partitionBy("leaf").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ends = places.withColumn("at", F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))).filter("at < rest").groupBy("leaf").agg(F.max("key").alias("last_key"))
    return written(leaf.join(ends, "leaf", "left"), "mix-plan"), total


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], seed: int, names: tuple[str, str, str] = ("mix_domain", "mix_epoch", "mix_budget"), **options) -> DataFrame:
    """docs, each row as often as its leaf's budget takes it, with its domain, epoch and leaf's budget in
    new columns `names`; a name that docs has already is an error."""
    clash = [n for n in names if fresh(docs, n) != n]
    if clash:
        raise ValueError(f"docs has columns {clash}: pass other names")
    plan, total = plan_mix(docs, domain, weights, seed, **options)
    lang, source, id_col = (options.get(k, d) for k, d in (("lang", "lang"), ("source", "source"), ("id_col", "doc_id")))
    leaf, of, rows = (fresh(docs, n) for n in ("_mix_leaf", "_mix_plan", "_mix_rows"))
    plan = plan.select(F.col("leaf").alias(leaf), F.struct("leaf.domain", "budget", "epochs", "last_key").alias(of), F.col("rows").alias(rows))
    met = hot_split_join(docs.withColumn(leaf, _leaf(domain, F.col(lang), F.col(source))), plan, leaf, rows, total)
    taken = F.coalesce(_order_key(seed, F.col(f"{of}.epochs"), F.col(id_col)) <= F.col(f"{of}.last_key"), F.lit(False))
    times = F.col(f"{of}.epochs") + taken.cast("int")
    met = met.withColumn(names[1], F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return met.select(*docs.columns, F.col(f"{of}.domain").alias(names[0]), names[1], F.col(f"{of}.budget").alias(names[2]))
