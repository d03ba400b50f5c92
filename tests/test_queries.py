"""Every registered query of the library against its DuckDB SQL, and the operators' golden cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import classify, findings, identity, reconcile, records, rules, spelling, tree, versions
from siltstone.plans import actions, queries
from siltstone.sources import tables as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    rows = df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)
    return list(df.columns), sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert canonical(queries.QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(queries.ORACLE_SQL[name]).df())


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_poisoned(spark):
    df = frame(spark, [("AA", 100), ("AA", 200), ("BB", 50), ("BB", 50), (None, 1), (None, 2), ("CC", None), ("CC", 1)], "hash string, size long")
    assert {r.hash for r in identity.poisoned_hashes(df).collect()} == {"AA", "CC"}


def test_keeper_and_drain(spark):
    rows = [(1, "a/x (2).pdf", "a", "x (2).pdf"), (2, "a/x.pdf", "a", "x.pdf"), (3, "a/x copy.pdf", "a", "x copy.pdf"), (4, "b/c/y.pdf", "b/c", "y.pdf")]
    df = frame(spark, [(*r, 5, "H") for r in rows] + [(5, "z", "", "z", 1, "Z")], "id long, rel string, dir_rel string, name string, size long, hash string")
    assert {r.id: r.keeper for r in identity.duplicate_plan(df).collect()} == {1: "a/x.pdf", 3: "a/x.pdf", 4: "a/x.pdf"}
    assert {r.id for r in identity.duplicate_plan(df, per_folder=True).collect()} == {1, 3}
    left, passes, settled = identity.drain(df)
    assert {r.id for r in left.collect()} == {2, 5} and passes == 2 and settled


def test_quarantine_is_inconclusive_not_orphan(spark):
    out = frame(spark, [("AA", 5), ("AA", 200)], "hash string, size long")
    q = frame(spark, [(1, "XX", 5), (2, "YY", 6), (3, None, 5), (4, "AA", 5)], "id long, hash string, size long")
    assert {r.id: r.klass for r in reconcile.quarantine_classes(q, out).collect()} == {1: "inconclusive", 2: "orphan", 3: "unreadable", 4: "poisoned"}


def test_journal_and_manifest_round_trip(spark, tmp_path):
    names = ["-test.jpg", "+971.jpg", "=calc.png", "@2x.png", "'q", "plain, \"x\"", "é"]
    rows = frame(spark, [(n, n, n, "h", 1, "local", "single", "t") for n in names], S.MANIFEST)
    S.write_manifest(rows, f"file://{tmp_path}/m")
    assert sorted(r.stored_as for r in S.read_manifest(spark, f"file://{tmp_path}/m").collect()) == sorted(names)
    assert S.recorded_scope(rows).first().scope == "single"


def test_text_functions(spark):
    cases = [("a.tar.gz", ".gz", ".tar.gz", "a.tar.gz", 0), (".env", "", "", ".env", 0), ("x (12).PDF", ".pdf", ".pdf", "x.PDF", 12), ("x copy.txt", ".txt", ".txt", "x.txt", 1), ("x copy 3.tar.gz", ".gz", ".tar.gz", "x.tar.gz", 3), ("plain", "", "", "plain", 0)]
    got = frame(spark, [(c[0],) for c in cases], "n string").select("n", X.extension(F.col("n")), X.extension_multi(F.col("n")), X.strip_copy(F.col("n")), X.copy_number(F.col("n"))).collect()
    assert [tuple(r) for r in got] == cases
    one = frame(spark, [("é É", " ", None, "ok")], "a string, b string, c string, d string").select(X.nfc(F.col("a")), X.fold(F.col("a")), X.first_text(F.col("b"), F.col("c"), F.col("d")), X.human_bytes(F.lit(1536)), X.neutral(F.lit("a\nb")))
    assert tuple(one.first()) == ("é É", "e E", "ok", "1.5 KB", "a?b")


def test_tree(spark):
    files = frame(spark, [("r/a/x", 1), ("r/a/b/y", 2), ("r/z", 4), ("top", 9)], "path string, size long")
    assert {r.dir: (r.files, r.bytes) for r in tree.rollup(files).collect()} == {"r": (3, 7), "r/a": (2, 3), "r/a/b": (1, 2)}
    dirs = frame(spark, [("p",), ("p/src",), ("p/src/g",), ("q",)], "dir string")
    kind = F.when(F.col("dir") == "p", "project").when(F.col("dir").endswith("/g"), "git")
    assert {r.dir: (r.zone_root, r.zone) for r in tree.zones(dirs, kind).collect()} == {"p": ("p", "project"), "p/src": ("p", "project"), "p/src/g": ("p", "project"), "q": (None, None)}
    assert {r.path: r.found for r in tree.longest_existing(frame(spark, [("p/src/none/x",), ("w/x",)], "path string"), dirs).collect()} == {"p/src/none/x": "p/src", "w/x": None}


JUNK = {
    ".DS_Store": "A:J1", "movie.mkv.part": "A:J2", "archive.part1.rar": None, "~$report.docx": "A:J3", "app.crash": "A:J5", "Setup-Thing-2.3.1.dmg": "B:J6", "report (1).pdf": "B:J8", "report.pdf": None,
    "lonely (2).png": "C:J8", "empty.dat": "A:J9", ".gitkeep": None, "build.log": "B:J13", "core": "C:J5", "x.ips": "C:J5", "a.torrent": "B:J2", "x.pyc": "A:J13", "._gone": "C:J1", "._app.crash": "A:J1",
}


def test_junk(spark):
    rows = [("d", n, 0 if n in ("empty.dat", ".gitkeep") else 7, 1546300800, None) for n in JUNK]
    got = classify.classify_junk(frame(spark, rows, "dir string, name string, size long, mtime long, hash string"), F.lit(1_700_000_000)).collect()
    assert {r.name: f"{r.tier}:{r.family}" if r.tier else None for r in got} == JUNK
    fresh = classify.classify_junk(frame(spark, [("d", "x.zip.crdownload", 5, 1_699_999_000, None), ("d", "Old-1.0.exe", 5, 946684800, None)], "dir string, name string, size long, mtime long, hash string"), F.lit(1_700_000_000)).collect()
    assert {r.name: r.tier for r in fresh} == {"x.zip.crdownload": None, "Old-1.0.exe": "C"}


def test_versions(spark):
    cases = [("1.10.0", "1.9.9", True), ("V1.2.3", "1.2.3", False), ("1.2", "1.2.0", False), ("1.2.3", "1.2.3-rc.1", True), ("1.2.3-rc.2", "1.2.3-rc.1", False), ("latest", "1.0", False), ("1.2.4-rc.1", "1.2.3", True), ("1.2.3", "1.2.3-rc_1", True), ("1.2.3", "1.2.3-beta+5", True), (" v1.3.0 ", "1.2.3", True), ("1.2.3-", "1.0", False)]
    got = frame(spark, [c[:2] for c in cases], "a string, b string").select(versions.is_newer(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]
    asset = frame(spark, [(["a-universal.dmg", "a-arm64.dmg"],), (["a-x64.dmg", "a-universal.dmg"],), (["a.zip"],)], "n array<string>").select(versions.match_asset(F.col("n"), "arm64", ".dmg")).collect()
    assert [r[0] for r in asset] == ["a-arm64.dmg", "a-universal.dmg", None]


def test_rules(spark):
    made = rules.deny_rules(spark, "main", "work")
    commands = ["git push origin main", "git push origin main --dry-run", "git push origin HEAD:main", "git push origin fix-main", "git push", "git -C /x push origin main", "git push origin main-cleanup"]
    got = {r.command: r.rules > 0 for r in rules.match(frame(spark, [(c,) for c in commands], "command string"), made).collect()}
    assert got == dict(zip(commands, [True, True, True, False, False, True, False], strict=True))
    tail = rules.match(frame(spark, [("gh pr merge",), ("gh pr merge 12",), ("gh pr merges",)], "command string"), frame(spark, [("gh pr merge *",)], "rule string")).collect()
    assert {r.command: r.rules for r in tail} == {"gh pr merge": 1, "gh pr merge 12": 1, "gh pr merges": 0}


def test_findings(spark):
    one = lambda keys: frame(spark, [(k,) for k in keys], "key string")
    accepted = frame(spark, [("a", None), ("b", "2020-01-01")], "key string, expires string").withColumn("expires", F.col("expires").cast("date"))
    got = findings.compare_runs(one("abcd"), one("ce"), accepted, F.lit("2024-01-01").cast("date")).collect()
    assert {r.key: r.state for r in got} == {"a": "ACCEPTED", "b": "REGRESSION", "c": "STILL-OPEN", "d": "NEW", "e": "FIXED"}


def test_finding_ids_of_one_hash(spark, tmp_path):
    """Two findings of one hash, one repeated, and parts that are null: the query is its SQL; the operator tells the two apart."""
    rows = [(1, 38, "view", '{"k": 31}'), (2, 156, "view", '{"k": 19}'), (3, 156, "view", '{"k": 19}'), (4, 38, "error", '{"k": 31}'), (5, None, "view", "x"), (6, 7, "error", None), (7, 7, None, "x")]
    frame(spark, rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = queries.QUERIES["finding_ids"](spark, str(tmp_path)).toPandas()
    assert canonical(got) == canonical(con.sql(queries.ORACLE_SQL["finding_ids"]).df())
    assert got.set_index("id").hash8[[1, 2, 3]].tolist() == ["1b469367"] * 3
    found = frame(spark, [("QUA", f"src/{u}.py", f'  call( {{"k": {k}}} )') for u, k in ((38, 31), (156, 19), (156, 19))], "cat string, path string, line string")
    of = {(r.path, r.hash8) for r in findings.finding_ids(found).collect()}
    assert len(of) == 2 and ("src/156.py", "1b469367") in of and len({h for _, h in of}) == 2


def test_plans(spark):
    got = frame(spark, [("IMG_20190601_1.jpg", 0), ("2018-02-03 10.11.12.jpg", 0), ("x.jpg", 1546300800), ("y", 0), ("IMG_20191301_1", 0)], "n string, t long").select(actions.capture_month(F.col("n"), F.col("t"), 2025)).collect()
    assert [tuple(r[0]) for r in got] == [(2019, 6, "filename"), (2018, 2, "filename"), (2019, 1, "mtime"), (0, 0, "unknown"), (0, 0, "unknown")]
    reasons = frame(spark, [("move", "a", "b"), ("copy", "a", "b"), ("move", "../a", "b"), ("move", "a", "/b"), ("move", "a", "a")], "o string, s string, d string").select(actions.reject_reason(F.col("o"), F.col("s"), F.col("d"))).collect()
    assert [r[0] for r in reasons] == [None, "not a move", "source path", "target path", "same path"]


def test_clusters_follow_rank_order(spark):
    """The walk itself: in rank order an item joins the first earlier kept item that is the same word."""
    import random

    rng = random.Random(3)
    words, glosses = queries.WORDS + ["a" * 3], [*queries.GLOSSES, None, "shrine day"]
    rows = [(i, f"h{rng.randrange(4)}", rng.randrange(60), rng.choice(words), rng.choice(glosses)) for i in range(300)] + [(900, None, 1, "दिन", "day"), (901, "h1", None, "दिन", "the day"), (902, "h1", 3, None, "day")]
    items = frame(spark, rows, "id long, head string, rank int, word string, gloss string")
    pairs = items.alias("a").crossJoin(items.alias("b")).filter("a.head = b.head")
    same = {(r[0], r[1]) for r in pairs.filter(spelling.same_word(F.col("a.word"), F.col("a.gloss"), F.col("b.word"), F.col("b.gloss"))).select("a.id", "b.id").collect()}
    expected, kept = {}, []
    for i, *_ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        leader = next((k for k in kept if (k, i) in same), None)
        expected[i] = i if leader is None else leader
        kept += [i] if leader is None else []
    got = {r.id: r.leader for r in records.leader_clusters(items).collect()}
    assert got == expected and len(set(got.values())) < len(rows) - 100


def test_streams(spark, tmp_path):
    from siltstone.streaming import incremental

    events = S.table(spark, SF, "events")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = incremental.first_sightings(stream, "user_id", "ts", "60 days").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == events.select("user_id").distinct().count()
