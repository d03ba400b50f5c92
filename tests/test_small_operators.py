"""Golden cases of operators that no registered query calls, or only in part."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import classify, findings, identity, reconcile, records, report, rules, versions, zones
from siltstone.plans import actions
from siltstone.sources import tables as S


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_sources(spark):
    files = rows(spark, [("a", 1, 10), ("b", 2, 20)], "path string, size long, mtime_ns long")
    memo = rows(spark, [("a", 1, 10, "h"), ("b", 2, 21, "old")], "path string, size long, mtime_ns long, hash string")
    known, unread = S.memo_hash(files, memo)
    assert [r.hash for r in known.collect()] == ["h"] and [r.path for r in unread.collect()] == ["b"]
    state = rows(spark, [(0x40000000, 8, 5), (0, 0, 5), (0, 8, 5), (0, 0, 0)], "f long, b long, s long")
    assert values(state, S.local_state(F.col("f"), F.col("b"), F.col("s"))) == ["placeholder", "placeholder", "local", "local"]
    found = rows(spark, [("p", False, 9, "m"), ("p", True, 1, "t"), ("q", False, 1, "x"), ("q", False, 2, "y")], "plan_id string, in_tree boolean, mtime long, path string")
    assert {r.path for r in S.newest_manifest(found).collect()} == {"t", "y"}
    tier = "batch string, v int"
    assert {(r.batch, r.v) for r in S.overlay(rows(spark, [("b1", 1)], tier), rows(spark, [("b1", 9), ("b2", 2)], tier), key="batch").collect()} == {("b1", 1), ("b2", 2)}
    text = "id int, text string"
    links = rows(spark, [(1, 10, 0), (1, 11, 1), (2, 12, 0)], "id_a int, id_b int, pos int")
    got = S.parallel_sentences(rows(spark, [(1, "eins"), (2, "zwei"), (3, "drei")], text), links, rows(spark, [(10, ""), (11, "one"), (12, "two")], text))
    assert {(r.id, r.other) for r in got.collect()} == {(1, "one"), (2, "two")}


def test_records(spark):
    df = rows(spark, [("7",), (" 8 ",), ("x",), (None,)], "r string")
    assert values(df, records.rank_of(F.col("r"))) == [7, 8, None, None]
    assert values(rows(spark, [("a", " ")], "x string, y string"), records.missing_fields(x=F.col("x"), y=F.col("y"))) == [["y"]]
    assert values(rows(spark, [(1,), (184,), (185,)], "n int"), records.batch_of(F.col("n"))) == [0, 0, 1]
    heads = records.homographs(rows(spark, [("a", "x"), ("a", "y"), ("b", None)], "head string, hint string")).collect()
    assert [(r.head, r["items"], r.hints) for r in heads] == [("a", 2, 2)]
    assert [r["rank"] for r in records.kept_items(rows(spark, [(True, "3"), (False, "1"), (True, None), (None, "2")], "keep boolean, rank string")).collect()] == [3]
    live = rows(spark, [(1, "12 of 90", "h_w_r34.mp3", "t"), (2, "x of y", "none", "t"), (3, "5", None, "t")], "note_id int, rank_text string, audio string, term string")
    assert [(r.n, r["rank"]) for r in records.live_manifest(live).orderBy("note_id").collect()] == [(12, 34), (None, None), (5, None)]
    pair = "key string, id string"
    drift = records.identity_drift(rows(spark, [("deck", "1"), ("model", "2"), ("x", None), ("y", "4")], pair), rows(spark, [("deck", "1"), ("model", "3")], pair))
    assert {r.key: r.state for r in drift.collect()} == {"deck": "ok", "model": "changed", "x": "ok", "y": "vanished"}
    both = rows(spark, [('[{"n": 1, "rank": 5}]',), ('{"deck": 1, "notes": [{"n": 2}]}',)], "t string")
    assert [[n.n for n in v] for v in values(both, records.manifest_notes(F.col("t")))] == [[1], [2]]
    assert values(rows(spark, [(["a", "b"], ["b"])], "w array<string>, h array<string>"), records.missing_columns(F.col("w"), F.col("h"))) == [["a"]]
    calls = rows(spark, [(True, None, None), (False, "boom", None), (False, None, "false"), (False, None, "1")], "t boolean, e string, r string")
    assert values(calls, records.call_outcome(F.col("t"), F.col("e"), F.col("r"))) == ["transport", "error", "refused", "ok"]
    assert records.next_batch(rows(spark, [("batch_02.json",), ("batch_10.json",), ("x",)], "name string"), r"batch_(\d+)").first()[0] == 11


def test_deck_lint(spark):
    schema = "id int, keep boolean, headword string, term string, gloss string, sent_display string, sent_native string, sent_en string"
    data = [
        (1, True, "mandir", "मंदिर", "temple", "yeh mandir hai", "यह मंदिर है", "this is a temple"),
        (2, True, "nahi", "नहीं", "no", "Mandir hai", "मंदिर", ""),
        (3, False, "paanii", "पानी", "water", "", "", ""),
        (4, True, "x मंदिर", "मुझे चाहिए", "want", "mujhe ek chaay chaahie", "मुझे एक चाय चाहिए", "I want tea"),
        (5, None, None, None, None, None, None, None),
    ]
    got = {}
    for r in records.deck_lint(rows(spark, data, schema)).collect():
        got.setdefault(r.id, set()).add(r.rule)
    assert got == {2: {"spelling_form", "stray_capital", "unaligned_sentence", "missing_sent_en", "word_not_in_sentence"}, 3: {"final_vowel"}, 4: {"native_leak"}}
    text = rows(spark, [("Kya nahi koii paanii",), ("yah davaaii।",)], "t string")
    assert values(text, records.fixed_text(F.col("t"))) == ["kyaa nahin koii paani", "yeh davaaii."]
    assert values(rows(spark, [("Thiik laRkaa",)], "t string"), records.mark_retroflex(F.col("t"))) == ['<span class=rx>Th</span>iik la<span class=rx>R</span>kaa']


def test_rules_and_versions(spark):
    one = lambda xs: rows(spark, [(x,) for x in xs], "rule string")
    assert {r.rule: r.action for r in rules.reconcile(one(["a", "b", "d", "f"]), one(["a", "b", "c"]), one(["b", "d"])).collect()} == {"a": "adopt", "b": "keep", "c": "add", "d": "remove", "f": "foreign"}
    line = "A" * 64
    assert values(rows(spark, [(line + "  x.zip",), ("short x",), (None,)], "l string"), versions.digest_of(F.col("l"))) == ["a" * 64, None, None]
    assert values(rows(spark, [("v0.1.5\n10.1.5\n0.1.55\nx=0.1.5;",)], "t string"), versions.version_lines(F.col("t"), "0.1.5")) == [["v0.1.5", "x=0.1.5;"]]
    switch = rows(spark, [(False, True, None, None, False), (None, True, True, None, False), (None, None, True, None, False), (None, None, None, None, True), (None, None, None, None, False)], "m boolean, u boolean, p boolean, l boolean, b boolean")
    assert values(switch, rules.switch_state(*[F.col(c) for c in "mupl"], F.col("b"))) == ["off: policy", "on: user", "off: named in a project", "off: a file does not parse", "on: default"]
    hooks = rows(spark, [([("run old",), (None,), ("other",)],)], "h array<struct<command: string>>")
    assert [[h.command for h in v] for v in values(hooks, rules.kept_hooks(F.col("h"), "old"))] == [[None, "other"]]
    legacy = rows(spark, [(["old"], 10), (["old"], 9_999), (["new"], 1), (None, 1)], "c array<string>, a long")
    state = rules.legacy_state(F.col("c"), "old", F.col("a"))
    assert values(legacy, state) == ["live", "installed", "none", "none"]
    assert values(legacy, rules.may_uninstall(state, F.lit(False))) == [False, True, True, True]
    checks = rows(spark, [("fresh", "v2.0", "1.0", "a"), ("cached", "v2.0", "1.0", None), ("fresh", "v1.0", "1.0", "a"), ("limited", None, "1.0", None), ("none", None, "1", None)], "k string, r string, c string, a string")
    got = values(checks, versions.update_status(F.col("k"), F.col("r"), F.col("c"), F.col("a")))
    assert [(g.status, g.reason) for g in got] == [("available", None), ("available", "no-asset-for-arch"), ("up-to-date", None), ("rate-limited", None), ("no-releases", None)]
    urls = ["https://github.com/a/b", "http://github.com/a", "https://x.githubusercontent.com/a", "https://evilgithub.com/", "http://127.0.0.1:9000/a", "not a url"]
    assert values(rows(spark, [(u,) for u in urls], "u string"), versions.allowed_download(F.col("u"), "127.0.0.1:9000")) == [True, False, True, False, True, False]
    left = rows(spark, [("up-a.part", 5), ("up-b", 90_000), ("up-c", 5), ("other.part", 90_000), ("up-live", 90_000)], "n string, a long")
    assert values(left, versions.stale_leftover(F.col("n"), F.col("a"), "up", F.lit("up-live/x"))) == [True, True, False, False, False]


def test_findings_and_reports(spark):
    path = "path string"
    got = findings.coverage(rows(spark, [("a",), ("b",), ("c",)], path), rows(spark, [("a",)], path), rows(spark, [("a",), ("b",)], path)).first()
    assert (got.known, got.read, got.skipped, got.unaccounted) == (3, 1, 1, 1)
    assert values(rows(spark, [(["security", "network"],), (["other"],)], "s array<string>"), findings.category(F.col("s"))) == ["NET", None]
    gate = rows(spark, [("High", "no"), ("Critical", "unsettled"), ("Low", "no"), ("High", None), ("High", "yes")], "s string, a string")
    assert values(gate, findings.gate(F.col("s"), F.col("a"))) == ["drop", "investigate", "report", "check", "report"]
    assert tuple(report.preflight(rows(spark, [("PASS",), ("WARN",), ("INFO",), ("PASS",)], "state string")).first()) == (2, 3, True)
    assert values(rows(spark, [(7, 8, 9, 6, 7)], "a int, b int, c int, d int, e int"), report.mean_score(*[F.col(c) for c in "abcde"])) == [7.4]
    pivot = report.severity_counts(rows(spark, [(1, "High", "NEW"), (1, "High", "FIXED"), (1, "Low", "ACCEPTED")], "run int, severity string, state string")).first()
    assert (pivot.high, pivot.low, pivot.accepted, pivot.fixed) == (1, 0, 1, 1)
    issues = report.histogram(rows(spark, [("final_vowel",), ("final_vowel",), ("length_mismatch",)], "rule string"), records.ADVISORY)
    assert {(r.rule, r.issues, r.hard) for r in issues.collect()} == {("final_vowel", 2, True), ("length_mismatch", 1, False)}
    assert {(r.field, r.records) for r in report.fields_touched(rows(spark, [("a",), ("a",), ("b",)], "field string")).collect()} == {("a", 2), ("b", 1)}
    assert [r.path for r in report.resorted(rows(spark, [("a", 1), ("b", 2), ("c", 2)], "path string, size int"), "size", True).collect()] == ["b", "c", "a"]


def test_quarantine_follow_up(spark):
    classified = rows(spark, [("ok",), ("orphan",), ("inconclusive",)], "klass string")
    got = reconcile.verdict(classified, rows(spark, [("h", False), ("p", True)], "hash string, poisoned boolean")).first()
    assert (got.checked, got.orphan, got.residual, got.passed, got.needs_reverify) == (3, 1, 1, False, True)
    manifest = rows(spark, [("d", "'=a"), ("d", "'-x"), ("d", "plain"), ("d", "gone")], "dup_dir string, stored_as string")
    stored = rows(spark, [("d", "=a"), ("d", "'-x"), ("d", "plain")], "dup_dir string, name string")
    assert {r.stored_as: r.found for r in reconcile.stored_names(manifest, stored).collect()} == {"'=a": "=a", "'-x": "'-x", "plain": "plain", "gone": None}
    folders = reconcile.managed_folders(rows(spark, [("a/Duplicates",), ("b/duplicates",), ("c",)], "dir string"), rows(spark, [("a/Duplicates",)], "dir string"))
    assert {r.dir: r.managed for r in folders.collect()} == {"a/Duplicates": True, "b/duplicates": False}
    accounted = rows(spark, [("m", "restored"), ("m", "skipped"), ("n", "unaccounted")], "manifest string, outcome string")
    assert {r.manifest: r.retire for r in reconcile.retire(accounted, "manifest").collect()} == {"m": True, "n": False}


def test_free_names_pass_over_given_numbers(spark):
    moves = rows(spark, [("d", "a.txt", "x/1"), ("d", "a.txt", "x/2"), ("d", "A.txt", "x/3"), ("d", "a [dup2].txt", "x/4"), ("d", "a [dup2].txt", "x/5")], "dup_dir string, name string, rel string")
    got = {r.rel: r.stored_as for r in identity.free_names(moves, rows(spark, [("d", "a [dup4].txt")], "dup_dir string, name string")).collect()}
    assert got == {"x/1": "a.txt", "x/2": "a [dup3].txt", "x/3": "A [dup5].txt", "x/4": "a [dup2].txt", "x/5": "a [dup2] [dup2].txt"}


def test_plans(spark):
    ops = rows(spark, [("p", "move", "a", "b", 1), ("p", "move", "c", "d", 2), ("q", "move", "a", "b", 1)], "plan_id string, op string, src string, dst string, size long")
    sums = {r.plan_id: r.checksum for r in actions.operations_checksum(ops).collect()}
    assert sums == {r.plan_id: r.checksum for r in actions.operations_checksum(ops.orderBy(F.desc("src")).repartition(3)).collect()} and sums["p"] != sums["q"]
    changed = actions.operations_checksum(ops.withColumn("dst", F.when(F.col("dst") == "d", "e").otherwise(F.col("dst")))).collect()
    assert {r.plan_id: r.checksum == sums[r.plan_id] for r in changed} == {"p": False, "q": True}
    linked = actions.linked_sources(ops, rows(spark, [("l", "a"), ("m", "a"), ("n", "z")], "path string, target string")).collect()
    assert {(r.plan_id, r.links) for r in linked} == {("p", 2), ("q", 2)}


def test_links_and_keys(spark):
    files = rows(spark, [("d/e", "l1", 3, 0, None, "../x.txt"), ("d/e", "l2", 3, 0, None, "../gone"), ("d/e", "l3", 3, 0, None, "/Volumes/u/a"), ("d", "x.txt", 3, 0, None, None), ("d/e", "l4.log", 3, 0, None, "../e")], "dir string, name string, size long, mtime long, hash string, link string")
    got = {r.name: (r.tier, r.family) for r in classify.classify_junk(files, F.lit(0), paths=rows(spark, [("elsewhere",)], "path string")).collect()}
    assert got == {"l1": (None, None), "l2": ("B", "J10"), "l3": ("C", "J10"), "x.txt": (None, None), "l4.log": (None, None)}
    content = rows(spark, [("a/x.md", "-----BEGIN RSA PRIVATE KEY-----"), ("a/x.py", "-----BEGIN RSA PRIVATE KEY-----"), ("secrets/a.swift", ""), ("x/.docker/config.json", "{}")], "p string, c string")
    assert values(content, classify.secret_path_reason(F.col("p"), F.col("c"))) == ["private key inside", None, None, "container credentials"]


def test_zones(spark):
    dirs = rows(spark, [("p",), ("p/node_modules",), ("p/node_modules/x",), ("p/.git",), ("q",), ("q/node_modules",), ("q/.cache",), ("q/.cache/deep",), ("q/my.photoslibrary",), ("q/my.photoslibrary/a.app",)], "dir string")
    files = rows(spark, [("p", "package.json"), ("p/node_modules/x", "a.js"), ("q/.cache/deep", "f")], "dir string, name string")
    got = {r.dir: (r.zone, r.prot) for r in zones.folder_zones(dirs, files).collect()}
    assert got == {
        "p": ("git", "p"), "p/node_modules": ("rebuildable", "p"), "p/node_modules/x": (None, "p"), "p/.git": (None, "p"), "q": (None, None), "q/node_modules": (None, None),
        "q/.cache": ("cache", "q/.cache"), "q/.cache/deep": (None, None), "q/my.photoslibrary": ("library", "q/my.photoslibrary"), "q/my.photoslibrary/a.app": (None, "q/my.photoslibrary"),
    }
    none = zones.folder_zones(dirs.limit(0), files.limit(0))
    assert none.count() == 0


@pytest.mark.parametrize("rank", [[1, 2, 5], [], [None, 3]])
def test_missing_ranks(spark, rank):
    got = report.missing_ranks(rows(spark, [(r,) for r in rank], "rank int"), width=2)
    have = [r for r in rank if r]
    assert sorted(r["rank"] for r in got.collect()) == [r for r in range(1, max(have, default=0) + 1) if r not in have]


def test_extended_list(spark):
    listed = lambda words: rows(spark, [(w, n) for n, w in enumerate(words, 1)], "word string, position int")
    saved = listed(["a", "b", "c"])
    same, moved = listed(["a", "b", "c", "d", "e", "f", "g"]), listed(["a", "x", "b", "c", None, "d", "e"])
    assert tuple(records.list_drift(saved, same).first()) == (3, 0)
    assert tuple(records.list_drift(saved, moved).first()) == (3, 2)
    assert tuple(records.list_drift(saved.limit(0), moved).first()) == (0, 0)
    got = lambda *a, **k: [tuple(r) for r in records.extended_list(*a, **k).orderBy("rank").collect()]
    assert got(saved, same, 3, first_batch=7, size=2) == [("d", 4, 7), ("e", 5, 7), ("f", 6, 8)]
    assert got(saved, moved, 3) == [("d", 4, 0)]
    assert got(saved, listed(["a", "b", "c"]), 5) == []
    assert got(saved.limit(0), same, 2) == [("a", 1, 0), ("b", 2, 0)]
