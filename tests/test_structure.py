"""Trees by id, walks, as-of joins, repeated digests, memo, settings of any shape, against plain loops."""

import json
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from siltstone.functions.joins import asof_join
from siltstone.operators import findings, identity, intervals, reconcile, records, report, rules, walk, zones
from siltstone.sources import memo, scratch
from siltstone.sources import tables as S


def climb(parents, i):
    out, seen = [i], {i}
    while parents[out[-1]] in parents:
        up = parents[out[-1]]
        if up in seen:
            return None
        seen.add(up)
        out.append(up)
    return out


def test_intervals_against_climbing(spark):
    """A hot folder, a chain, several trees, cycles, a missing parent."""
    rng = random.Random(3)
    rows = [(1, None), (2, 99_999)] + [(i, rng.randint(1, i - 1)) for i in range(3, 200)] + [(1_000, 1_001), (1_001, 1_000), (1_002, 1_001), (1_003, 1_003)]
    rows += [(5_000 + i, 5_000 + i - 1 if i else None) for i in range(400)] + [(10_000 + i, 1) for i in range(600)]
    parents = dict(rows)
    ups = {i: climb(parents, i) for i in parents}
    want = {(a, i, n) for i, u in ups.items() if u for n, a in enumerate(u)}
    labels = intervals.intervals(spark.createDataFrame([(*r, "x", 0) for r in rows], "id long, parent long, root string, at int").repartition(4))
    assert {r.id: r.depth for r in labels.collect()} == {i: len(u) - 1 for i, u in ups.items() if u}
    assert set(map(tuple, intervals.members(labels).collect())) == want
    values = spark.createDataFrame([(i, i % 7, -i) for i in parents if i % 3], "id long, v long, w long")
    sums, most = {}, {}
    for a, i, _ in want:
        s = sums.setdefault(a, [0, 0])
        if i % 3:
            s[0], s[1], most[a] = s[0] + i % 7, s[1] - i, max(most.get(a, -(10**9)), -i)
    assert {r.id: [r.v, r.w] for r in intervals.subtree_sums(labels, values, "v", "w").collect()} == sums
    assert {r.id: r.w for r in intervals.subtree_best(labels, values, F.max("w").alias("w")).collect()} == most
    none = intervals.intervals(spark.createDataFrame([], "id long, parent long"))
    assert none.count() == 0 and intervals.members(none).count() == 0


def test_folder_rollup_counts_first_links_and_weighs_years(spark):
    labels = intervals.intervals(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent long"))
    files = [(3, 10, 1, "jA:J9", 2001, "x"), (3, 10, 0, "jA:J9", 2011, "x"), (2, 30, 1, None, 2004, "y"), (2, None, 1, "jC:J8", None, "x"), (1, 20, 1, "jB:J3", None, "y")]
    df = spark.createDataFrame(files, "folder long, size long, hl_first int, cls string, year int, category string")
    got = {r.id: (r.files, r.bytes, r.junk_bytes, r.year, r.categories) for r in report.folder_rollup(labels, df, ["x", "y"]).collect()}
    assert got == {1: (5, 60, 30, 2003, {"x": 10, "y": 50}), 2: (4, 40, 10, 2003, {"x": 10, "y": 30}), 3: (2, 10, 10, 2001, {"x": 10})}


def test_walk_stops_at_closed_folders(spark):
    d, f = True, False
    rows = [
        (0, None, "root", d, f, None), (1, 0, ".git", d, f, None), (2, 1, "inside", f, f, None), (3, 0, "duplicates", d, f, None), (4, 3, "x", f, f, None), (5, 0, "Pics.PhotosLibrary", d, f, None),
        (6, 0, "a", d, f, None), (7, 6, "linked", d, True, None), (8, 6, "file", f, f, None), (9, 6, ".hid", f, f, None), (10, 6, "sym", f, True, "empty"), (11, 6, "zero", f, f, "empty"),
        (12, 6, "b", d, f, None), (13, 12, "deep", d, f, None), (14, 13, "lost", f, f, None), (15, 16, "ring", d, f, None), (16, 15, "ring", d, f, None), (17, 99, "stray", f, f, None), (18, 0, None, f, f, None),
    ]
    df = spark.createDataFrame(rows, "id long, parent long, name string, is_dir boolean, is_link boolean, reason string")
    got = {r.id: (r.rel, r.dir_rel, r.reason) for r in walk.walk(df, 0, cap=2).collect()}
    assert got == {
        1: (".git", "", "hidden"), 3: ("duplicates", "", "quarantine"), 5: ("Pics.PhotosLibrary", "", "bundle"), 7: ("a/linked", "a", "link"), 8: ("a/file", "a", None), 10: ("a/sym", "a", "symlink"),
        11: ("a/zero", "a", "empty"), 13: ("a/b/deep", "a/b", "too-deep"), 18: ("", "", None),
    }
    assert walk.walk(df.limit(0), 0).count() == 0 and walk.walk(df, 77).count() == 0


def test_asof_join_against_a_scan(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 5 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(40)])) for i in range(300)]
    right = [(key(), rng.choice([None, *range(40)]), rng.randint(0, 9)) for _ in range(200)]
    l, r = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, t long, v long")
    want = {i: (max(((tt, v) for kk, tt, v in right if kk == k and tt is not None and t is not None and tt <= t), default=(0, None))[1]) for i, k, t in left}
    for blocks in (2, 16):
        assert {x.id: x.v for x in asof_join(l, r, "k", "t", ["v"], blocks).collect()} == want
    assert {x.v for x in asof_join(l, r.limit(0), "k", "t", ["v"]).collect()} == {None} and asof_join(l.limit(0), r, "k", "t", ["v"]).count() == 0


def test_states_of_runs(spark):
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    found = [(day(0), "a"), (day(0), "b"), (day(10), "b"), (day(10), "c"), (day(20), "a"), (day(20), "c"), (day(20), "c"), (None, "x"), (day(20), None)]
    accepted = [("c", day(5), day(12)), ("b", day(-9), None), ("b", day(8), day(9))]
    got = {(r.run, r.key): r.state for r in findings.states_of_runs(spark.createDataFrame(found, "run date, key string"), spark.createDataFrame(accepted, "key string, run date, expires date")).collect()}
    assert got == {(day(0), "a"): "NEW", (day(0), "b"): "ACCEPTED", (day(10), "a"): "FIXED", (day(10), "b"): "REGRESSION", (day(10), "c"): "ACCEPTED", (day(20), "b"): "FIXED", (day(20), "a"): "NEW", (day(20), "c"): "REGRESSION"}


def test_seen_again_keeps_all_repeats_and_little_else(spark, monkeypatch):
    rows = [(f"h{i}", i) for i in range(3_000)] + [(f"h{i % 50}", i) for i in range(200)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "hash string, _at long")
    got = [r["hash"] for r in identity.seen_again(df).collect()]
    assert sorted(h for h in got if int(h[1:]) < 50) == sorted([f"h{i}" for i in range(50)] + [f"h{i % 50}" for i in range(200)])
    assert len(got) < 250 + 0.3 * 3_000 and identity.seen_again(df.limit(0)).count() == 0
    monkeypatch.setattr(identity, "MOST_BITS", 10)
    assert identity.seen_again(df).count() == 3_200


def test_memo_reads_what_is_new_without_an_exchange_of_the_memo(spark):
    name = "memo_test"
    memo.create(spark, name, f"{scratch.root(spark)}/{name}")
    asked = []

    def read(files):
        asked.append(sorted(r.path or "" for r in files.collect()))
        return files.filter("path <> 'broken'").select("path", F.concat(F.lit("h"), "path", F.col("mtime_ns").cast("string")).alias("hash"))

    files = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime_ns long")
    one = [(f"p{i}", i, 1) for i in range(100)] + [("broken", 1, 1), (None, 1, 1)]
    first = memo.digests(files(one), name, read)
    assert first.count() == 102 and first.filter("fresh").count() == 100
    two = [(f"p{i}", i, 1 + (i % 10 == 0)) for i in range(100)]
    second = {r.path: (r.hash, r.fresh) for r in memo.digests(files(two), name, read).collect()}
    assert second == {f"p{i}": (f"hp{i}{1 + (i % 10 == 0)}", i % 10 == 0) for i in range(100)}
    assert not memo.digests(files(two), name, read).filter("fresh").count() and [len(a) for a in asked] == [102, 10, 0]
    assert spark.table(name).count() == 100
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = memo.recall(files(two), name)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # that of the files
    spark.sql(f"DROP TABLE {name}")


def test_settings_of_any_shape(spark):
    ours, other = {"command": "x /loop/ y"}, {"command": "z"}
    cases = [
        ({"hooks": {"A": [{"hooks": [ours, other], "m": 1}], "B": "text"}, "k": [1, {"z": None}]}, {"hooks": {"A": [{"hooks": [other], "m": 1}], "B": "text"}, "k": [1, {"z": None}]}),
        ({"hooks": {"A": [{"hooks": [ours]}]}, "k": 1.5}, {"k": 1.5}),
        ({"hooks": {"A": [{"hooks": [ours]}, 7, None, {"hooks": {}}], "B": [{"hooks": [other]}]}}, {"hooks": {"A": [7, None, {"hooks": {}}], "B": [{"hooks": [other]}]}}),
        ({"hooks": {"A": [{"hooks": [{"command": ["/loop/"]}, "/loop/", None]}]}}, None),
    ]
    texts = [json.dumps(a) for a, _ in cases] + [None, "", "no json", "[]", "3", '{"hooks": []}', '{ "hooks" : {} }']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", "t", rules.kept_settings(F.col("t"), "/loop/").alias("k"))
    got = {r.i: (r.t, r.k) for r in df.collect()}
    for i, (before, after) in enumerate(cases[:3]):
        assert json.loads(got[i][1]) == after
    assert all(t == k for i, (t, k) in got.items() if i >= len(cases))


def test_placeholders_are_no_empty_files(spark):
    rows = [(1, "d", "none.dat", 0, True), (2, "d", "none2.dat", 0, False), (3, "d", "sunset.jpg", 50_000, True), (4, "d", "dawn.jpg", 50_000, False), (5, "d", "noon.dat", 0, None)]
    df = spark.createDataFrame([(i, d, n, s, 1_700_000_000, None, 1, g) for i, d, n, s, g in rows], "id long, dir string, name string, size long, mtime long, hash string, hl_first int, dataless boolean")
    got = {r.id: r.cls for r in zones.file_classes(df, df.select("dir").distinct(), 1_710_000_000).collect()}
    assert got == {1: None, 2: "jA:J9", 3: "ph:unk", 4: None, 5: "jA:J9"}
    assert report.inventory_totals(df.withColumn("blocks", F.lit(2))).first().asDict() == {"files": 5, "bytes": 100_000, "physical": 5_120, "dataless_files": 2, "dataless_bytes": 50_000, "errors": 0}


def test_late_lower_ranks_are_refused(spark):
    ranks = lambda xs: spark.createDataFrame([(x,) for x in xs], "rank int")
    items, there = ranks([1, 2, 9, 10]), ranks([9])
    assert records.order_guard(items, there).first().asDict() == {"lowest": 1, "highest": 9, "refused": True}
    assert records.deliver(items, there, 10).count() == 0 and records.deliver(items, there, 10, allow_unordered=True).count() == 3
    assert records.deliver(ranks([9, 10, 11]), there, 10).count() == 2 and records.deliver(items, ranks([]), 10).count() == 4


def test_field_lint_sees_every_field(spark):
    schema = "id long, rank string, term string, headword string, gloss string, pos string, sent_display string, sent_native string, sent_en string"
    rows = [(1, "1", "t", "<b>word</b>", "", "n", "", "", ""), (2, "x", "t&amp;", "हा", "é", None, "it’s – so", "a<b", "a > b"), (3, " 4 ", "t", "w", "g", "n", None, None, None)]
    got = {tuple(r) for r in records.field_lint(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, "headword", "raw_html"), (1, "gloss", "empty_field"), (2, "rank", "empty_field"), (2, "pos", "empty_field"), (2, "term", "raw_html"), (2, "sent_native", "raw_html"), (2, "sent_en", "raw_html"),
        (2, "headword", "native_leak"), (2, "headword", "non_ascii"), (2, "gloss", "non_ascii"),
    }


def test_clusters_of_a_long_chain(spark, monkeypatch):
    """Each word is like its neighbours alone: kept and joined take turns, in one call or in rounds."""
    links = spark.createDataFrame([(i, i + 1) for i in range(90)] + [(200, 300)], "a long, b long")
    want = {i: i % 2 == 0 for i in range(91)} | {200: True, 300: False}
    assert {r.node: r.kept for r in records.settle(links).collect()} == want
    short = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    monkeypatch.setattr(records, "COMPONENT_LINKS", 1)
    assert {r.node: r.kept for r in records.settle(short).collect()} == {i: i % 2 == 0 for i in range(13)}


def test_where_and_mirrors(spark):
    inside = spark.createDataFrame([(1, "s/Duplicates", "a", "s/Duplicates/a", 1, "h1", "ok"), (2, "s/Duplicates", "b", "s/Duplicates/b", 2, None, "unreadable"), (3, "s/Duplicates", "c", "s/Duplicates/c", 3, "h3", "orphan")], "id long, dup_dir string, name string, rel string, size long, hash string, klass string")
    outside = spark.createDataFrame([(9, "s/x", "h1")], "id long, rel string, hash string")
    manifest = spark.createDataFrame([("s/Duplicates", "a", "x"), ("s/Duplicates", "b", "y/../../z"), ("s/Duplicates", "c", "gone")], "dup_dir string, stored_as string, keeper string")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("nothing",)], "name string")
    got = {r.file: (r.severity, r.verdict, r.total, r.keeper_status) for r in reconcile.where(inside, outside, manifest, outside, names, per_folder=True).collect()}
    assert got == {"s/Duplicates/a": (5, "ok", 1, "present"), "s/Duplicates/b": (2, "unreadable", 0, "unsafe-path"), "s/Duplicates/c": (0, "orphan", 0, "missing"), "nothing": (10, "not-found", None, None)}
    found = spark.createDataFrame([("p1", True, 1, "m1"), ("p2", False, 1, "m2"), ("p3", False, 1, "m3"), ("p4", False, 1, "m4")], "plan_id string, in_tree boolean, mtime long, path string")
    rows = spark.createDataFrame([("m2", 1, ""), ("m2", 2, "/root/a"), ("m2", 3, "/else/b"), ("m3", 1, "/rootless/a"), ("m1", 1, "/else")], "path string, line long, src string")
    assert {r.path for r in S.manifests_below(found, rows, "/root/").collect()} == {"m1", "m2"}
