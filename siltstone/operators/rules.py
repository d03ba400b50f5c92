"""Command rules: generation, whole-command wildcard matching, set algebra with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Forms of push that take or rewrite more than a branch, and other commands to deny.
PUSH_FORMS = [" *--force*", " -f*", " * -f", " * -f *", " * +*", " *--mirror*", " *--all", " *--all *", " *--prune*", " *--delete*", " * -d *", " * :*"]
OTHER_RULES = ["git reset --hard*", "git -C * reset --hard*", "git branch -D*", "git branch * -D*", "git -C * branch -D*", "git branch *--delete --force*", "git branch *--force --delete*", "git clean *", "git -C * clean -*", "gh pr merge*"]
BRANCH_FORMS = [" {}", ":{}", ":refs/heads/{}", " refs/heads/{}", " '{}'", ' "{}"', ":{}'", ':{}"']
PREFIXES = ["git push", "git -C * push", "git -c * push"]


def deny_rules(spark: SparkSession, base: str, work: str) -> DataFrame:
    """(n, rule): every rule of a run on branch `work` that started from `base`, in order, each once:
    forms of push, other commands, then pushes to main, master and base, but never to work."""
    protected = [b for b in dict.fromkeys(["main", "master", base]) if b and b != work]
    first = [p + f for p in PREFIXES for f in PUSH_FORMS] + OTHER_RULES
    fixed = spark.createDataFrame([(n, r) for n, r in enumerate(dict.fromkeys(first))], "n int, rule string")
    if not protected:
        return fixed.withColumn("n", F.col("n") + 1)
    branches = generate(spark, PREFIXES, BRANCH_FORMS, protected).join(fixed.select("rule"), "rule", "left_anti")
    both = fixed.withColumn("part", F.lit(0)).unionByName(branches.withColumn("part", F.lit(1)))
    return both.select(F.row_number().over(Window.orderBy("part", "n")).alias("n"), "rule")  # a few hundred rules


def generate(spark: SparkSession, prefixes: list[str], forms: list[str], branches: list[str]) -> DataFrame:
    """(n, rule): prefixes x branches x forms in that order, with and without arguments after, each once."""
    made = [f"{p} *{f.format(b)}{end}" for p in prefixes for b in dict.fromkeys(x for x in branches if x) for f in forms for end in ("", " *")]
    return spark.createDataFrame(list(enumerate(dict.fromkeys(made), 1)), "n int, rule string")


def pattern(rule: Column) -> Column:
    """The rule as a regular expression over a whole command: * is anything, and one * at the end
    after a space may be missing with its space."""
    body = F.replace(F.concat(F.lit(r"\Q"), rule, F.lit(r"\E")), F.lit("*"), F.lit(r"\E.*\Q"))
    stars = F.length(rule) - F.length(F.replace(rule, F.lit("*"), F.lit("")))
    open_end = F.concat(F.lit(r"\Q"), F.substring(rule, F.lit(1), F.length(rule) - 2), F.lit(r"\E( .*)?"))
    return F.concat(F.lit("(?s)^"), F.when(rule.endswith(" *") & (stars == 1), open_end).otherwise(body), F.lit("$"))


#: More rules than this are no list that a run generates.
MOST_RULES = 1_000


def match(commands: DataFrame, rules: DataFrame) -> DataFrame:
    """(command, rules): each distinct command with the number of rules that block it.

    The rules are read once (MOST_RULES at most, else an error) and become constant patterns of one
    projection, so commands are neither joined nor multiplied.
    """
    found = [r["p"] for r in rules.select(pattern(F.col("rule")).alias("p")).limit(MOST_RULES + 1).collect()]
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    patterns = F.array(*[F.lit(p) for p in found]) if found else F.array().cast("array<string>")
    hits = F.filter(patterns, lambda p: F.rlike(F.col("command"), p))
    return commands.select("command").distinct().withColumn("rules", F.size(hits).cast("long"))


# Fixed value: a run counts as live for this many seconds after its last sign.
LIVE_SECONDS = 1_800


def switch_state(managed: Column, user: Column, project: Column, local: Column, parse_failed: Column) -> Column:
    """Whether a setting is on, and by what: policy first, then the user's own value; without either it
    is off where any project file names it or a file does not parse, else on."""
    named = project.isNotNull() | local.isNotNull()
    return (
        F.when(managed.isNotNull(), F.when(managed, "on: policy").otherwise("off: policy"))
        .when(user.isNotNull(), F.when(user, "on: user").otherwise("off: user"))
        .when(named, "off: named in a project")
        .when(parse_failed, "off: a file does not parse")
        .otherwise("on: default")
    )


def kept_hooks(hooks: Column, marker: str) -> Column:
    """Hooks (array of structs with `command`) without those whose command holds the marker; hooks
    without a command are kept."""
    return F.filter(hooks, lambda h: ~F.coalesce(F.contains(h["command"], F.lit(marker)), F.lit(False)))


def kept_settings(settings: Column, marker: str) -> Column:
    """Settings (JSON text) without the hooks whose command holds the marker.

    Hooks lie by event in groups, each with a list of hooks. A value of any other shape, at any level,
    stays exactly as it is, as does all else in the settings; a group, an event and the hooks themselves go
    where the removal leaves them empty. Text that is no JSON object stays as it is. Keys come out in the
    order of their names, as a variant holds them.
    """
    whole = F.try_parse_json(settings)
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    command = lambda h: get(h, "$.command", "string")
    ours = lambda h: F.coalesce((F.schema_of_variant(h).startswith("OBJECT")) & F.contains(command(h), F.lit(marker)), F.lit(False))
    stays = lambda h: ~ours(h)

    def of_group(group: Column) -> Column:
        """The group as it stays, null where it goes."""
        hooks = get(group, "$.hooks", "array<variant>")
        left = F.filter(hooks, stays)
        others = F.map_filter(get(group, "$", "map<string,variant>"), lambda k, _: k != "hooks")
        changed = F.to_variant_object(F.map_concat(others, F.map_from_arrays(F.array(F.lit("hooks")), F.array(F.to_variant_object(left)))))
        return F.when(hooks.isNull() | (F.size(left) == F.size(hooks)), group).when(F.size(left) > 0, changed)

    def of_event(groups: Column) -> Column:
        """The event as it stays, null where it goes."""
        rows = get(groups, "$", "array<variant>")
        hit = F.exists(rows, lambda g: F.coalesce(F.exists(get(g, "$.hooks", "array<variant>"), ours), F.lit(False)))
        left = F.filter(F.transform(rows, of_group), lambda g: g.isNotNull())
        return F.when(rows.isNull() | ~hit, groups).when(F.size(left) > 0, F.to_variant_object(left))

    hooks = get(whole, "$.hooks", "map<string,variant>")
    after = F.map_filter(F.transform_values(hooks, lambda _, v: of_event(v)), lambda _, v: v.isNotNull())
    others = F.map_filter(get(whole, "$", "map<string,variant>"), lambda k, _: k != "hooks")
    rebuilt = F.when(F.size(after) > 0, F.map_concat(others, F.map_from_arrays(F.array(F.lit("hooks")), F.array(F.to_variant_object(after))))).otherwise(others)
    touched = F.coalesce(F.to_json(F.to_variant_object(after)) != F.to_json(F.to_variant_object(hooks)), F.lit(False))
    return F.when(touched, F.to_json(F.to_variant_object(rebuilt))).otherwise(settings)


def legacy_state(commands: Column, marker: str, heartbeat_age: Column) -> Column:
    """none, installed or live: an old install is live while its heartbeat is recent."""
    hit = F.exists(commands, lambda c: F.contains(c, F.lit(marker)))
    return F.when(~F.coalesce(hit, F.lit(False)), "none").when(heartbeat_age <= LIVE_SECONDS, "live").otherwise("installed")


def may_uninstall(state: Column, forced: Column) -> Column:
    """A live run is not taken away unless told to."""
    return (state != "live") | forced


def reconcile(have: DataFrame, want: DataFrame, ours: DataFrame) -> DataFrame:
    """(rule, action): add what is wanted and missing, adopt what is there but not recorded as ours,
    remove what is ours and no longer wanted, keep the rest that is ours."""
    flag = lambda df, name: df.select("rule").distinct().withColumn(name, F.lit(True))
    all_rules = flag(have, "h").join(flag(want, "w"), "rule", "full").join(flag(ours, "o"), "rule", "full").na.fill(False)
    action = F.when(F.col("w") & ~F.col("h"), "add").when(F.col("w") & ~F.col("o"), "adopt").when(F.col("o") & F.col("h") & ~F.col("w"), "remove").when(F.col("w"), "keep").otherwise("foreign")
    return all_rules.select("rule", action.alias("action"))
