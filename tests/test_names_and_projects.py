"""Golden cases of free names of other kinds, plan refusals, version hits, project types, finding keys."""

from pyspark.sql import functions as F

from siltstone.operators import findings, reconcile, versions
from siltstone.plans import actions
from siltstone.sources import tables as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_final_targets(spark):
    ops = frame(spark, [("s/1", "d/a.txt"), ("s/2", "d/a.txt"), ("s/3", "d/b.txt"), ("s/4", "e/a.txt"), ("s/5", "top")], "src string, dst string")
    there = frame(spark, [("d/a.txt",), ("d/a [t2].txt",), ("top",)], "path string")
    got = {r.src: r.final for r in actions.final_targets(ops, there).collect()}
    assert got == {"s/1": "d/a [t1].txt", "s/2": "d/a [t3].txt", "s/3": "d/b.txt", "s/4": "e/a.txt", "s/5": "top [t1]"}


def test_restored_names(spark):
    rows = [(1, "q", "a [dup2].txt", "h1", "orphan"), (2, "q", "a [dup3].txt", "h2", "orphan"), (3, "q", "c.txt", "h3", "orphan"), (4, "q", "c [dup2].txt", "h3", "orphan")]
    healed = reconcile.heal_plan(frame(spark, rows, "id int, dir_rel string, name string, hash string, klass string").withColumn("rel", F.concat_ws("/", "dir_rel", "name")))
    there = frame(spark, [("q", "a.txt"), ("q", "a [recovered2].txt"), ("z", "c.txt")], "dir_rel string, name string")
    assert {r.id: r.final for r in reconcile.restored_names(healed, there).collect()} == {1: "a [recovered3].txt", 2: "a [recovered4].txt", 3: "c.txt"}


def test_plan_refusal(spark):
    schema = "plan_id string, op string, src string, dst string, size long"
    ops = frame(spark, [("p1", "move", "/r/a", "/r/b", 1), ("p2", "move", "/r/a", "/x/b", 1), ("p3", "move", "/r/../a", "/r/b", 1), ("p4", "copy", "/r/a", "/r/b", 1)], schema)
    sums = actions.operations_checksum(ops)
    reasons = {}
    for plan in ("p1", "p2", "p3", "p4"):
        reasons |= {(plan): r.reason for r in actions.plan_refusal(sums.withColumn("root", F.lit("/r")), ops, "/r", plan).collect() if r.plan_id == plan}
    assert reasons == {"p1": None, "p2": "outside the folder", "p3": "source path", "p4": "not a move"}
    one = sums.filter("plan_id = 'p1'")
    ask = lambda df, token: actions.plan_refusal(df, ops, "/r", token).first().reason
    assert ask(one.withColumn("root", F.lit("/r")), "p9") == "approval token"
    assert ask(one.withColumn("root", F.lit("/s")), "p1") == "another folder"
    assert ask(one.withColumns({"root": F.lit("/r"), "checksum": F.lit("0")}), "p1") == "changed since"


def test_links_out_of_the_folder(spark, monkeypatch):
    monkeypatch.setattr(actions, "LINK_ROUNDS", 4)
    links = frame(spark, [("/r/out", "/x"), ("/r/in", "/r/d"), ("/r/d/on", "/rest"), ("/r/c1", "/r/c2"), ("/r/c2", "/r/c1"), (None, "/x"), ("/r/n", None)], "path string, target string")
    cases = {"/r": False, "/r/out": True, "/r/out/a/b": True, "/r/outer": False, "/r/in": False, "/r/in/on/z": True, "/r/d": False, "/r/c1/q": True, "/r/n": False}
    folders = frame(spark, [(f,) for f in cases] + [(None,), ("/r/out",)], "folder string")
    assert sorted(r.folder for r in actions.leaking_folders(folders, links, "/r").collect()) == sorted(f for f, leaks in cases.items() if leaks)
    assert actions.leaking_folders(folders, links.limit(0), "/r").count() == 0
    ops = frame(spark, [("p1", "move", "/r/out", "/r/q/out", 1), ("p2", "move", "/r/a", "/r/in/on/a", 1), ("p3", "move", "/r/in/a", "/r/a", 1)], "plan_id string, op string, src string, dst string, size long")
    sums = actions.operations_checksum(ops).withColumn("root", F.lit("/r"))
    assert {p: r.reason for p in ("p1", "p2", "p3") for r in actions.plan_refusal(sums, ops, "/r", p, links).collect() if r.plan_id == p} == {"p1": None, "p2": "through a link", "p3": None}


def test_version_hits(spark):
    files = frame(spark, [("a.json", 'x\n"version": "0.1.5",\n# old 0.1.5\n10.1.5'), ("docs/CHANGELOG.md", "0.1.5"), ("app/package-lock.json", "0.1.5"), ("b", None)], "path string, text string")
    assert [(r.path, r.line) for r in versions.version_hits(files, "0.1.5").collect()] == [("a.json", '"version": "0.1.5",')]


def test_project_types(spark):
    pkg = '{"name": "x", "version": "1"}'
    files = [
        ("e", "package.json", '{"name": "x", "version": "1", "build": {}, "dependencies": {"electron": "1"}}'), ("e", "yarn.lock", ""),
        ("n", "package.json", pkg), ("n", "Dockerfile", ""), ("p", "package.json", '{"name": "x", "version": "1", "private": true}'),
        ("s", "project.yml", ""), ("s", "A.xcodeproj/project.pbxproj", ""), ("x", "A.xcodeproj/project.pbxproj", ""), ("c", "src/A.csproj", ""), ("m", "CMakeLists.txt", ""), ("q", "a.pro", ""),
        ("py", "pyproject.toml", "[project]\nname='x'"), ("pa", "requirements.txt", ""), ("pa", "app.py", ""), ("pa", "pyproject.toml", "[tool.x]"), ("r", "Cargo.toml", "[package]\n"), ("w", "Cargo.toml", "[workspace]\n"), ("g", "go.mod", ""),
        ("d", "Dockerfile", ""), ("d", "docker-compose.yml", ""), ("b", "manifest.json", '{"manifest_version": 3}'), ("sub", "ui/package.json", pkg), ("mono", "a/package.json", pkg), ("mono", "b/Cargo.toml", ""), ("none", "a.sh", None),
    ]
    got = {r.repo: (r.type, r.flavour) for r in versions.project_types(frame(spark, files, "repo string, path string, text string")).collect()}
    plain = {"p": "source-only", "s": "swift app", "x": "xcode app", "c": ".net app", "m": "c++ cmake", "q": "c++ qt", "py": "python library", "pa": "python app", "r": "rust", "w": "source-only", "g": "go", "d": "docker server", "b": "browser extension", "sub": "subdir app", "mono": "monorepo", "none": "source-only"}
    assert got == {k: (v, "npm" if k == "p" else None) for k, v in plain.items()} | {"e": ("electron app", "yarn"), "n": ("npm library", "npm")}


def test_keys_and_states(spark):
    df = frame(spark, [("CMD", "Shell: runs user input!", "0a1b2c3d"), ("FS", "", "ffffffff")], "c string, t string, h string")
    assert [r[0] for r in df.select(findings.finding_key(F.col("c"), F.col("t"), F.col("h"))).collect()] == ["CMD-shell-runs-user-0a1b2c3d", "FS-ffffffff"]
    state = frame(spark, [(0x20, 0, 5), (0x40000020, 0, 5), (None, 0, 5), (None, 1, 5)], "f long, b long, s long")
    assert [r[0] for r in state.select(S.local_state(F.col("f"), F.col("b"), F.col("s"))).collect()] == ["local", "placeholder", "placeholder", "local"]
