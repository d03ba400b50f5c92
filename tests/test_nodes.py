"""Golden cases of trees by id and of the sync store's records."""

from pyspark.sql import functions as F

from siltstone.operators import nodes


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TREE = [(1, None, ""), (2, 1, "a"), (3, 2, "b"), (4, 3, "c"), (5, 1, "x"), (6, 7, "loop"), (7, 6, "loop"), (8, 99, "stray"), (9, 6, "below")]


def test_paths_members_resolve(spark):
    paths = nodes.folder_paths(frame(spark, TREE, "id long, parent long, name string"))
    assert {r.id: (r.path, r.depth) for r in paths.collect()} == {1: ("", 0), 2: ("a", 1), 3: ("a/b", 2), 4: ("a/b/c", 3), 5: ("x", 1), 8: ("stray", 0)}
    tree = frame(spark, TREE, "id long, parent long, name string")
    got = {(r.ancestor, r.id, r.depth) for r in nodes.members(tree).collect()}
    assert got == {(i, i, 0) for i in (1, 2, 3, 4, 5, 8)} | {(2, 3, 1), (2, 4, 2), (3, 4, 1)} | {(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 1)}
    found = nodes.resolve(frame(spark, [("a/b",), ("no",), ("/a//b/c",), ("",), (None,), ("loop",)], "path string"), tree)
    assert {r.path: r.id for r in found.collect()} == {"a/b": 3, "no": None, "/a//b/c": 4, "": None, None: None, "loop": None}
    deep = [(i, i - 1 if i else None, f"d{i}") for i in range(100)]
    long = nodes.folder_paths(frame(spark, [(i, i - 1 if i else None, "d") for i in range(600)], "id long, parent long, name string"))
    assert long.count() == 600 and long.agg(F.max("depth")).first()[0] == 599
    last = nodes.folder_paths(frame(spark, deep, "id long, parent long, name string")).filter("id = 99").first()
    assert last.path == "/".join(f"d{i}" for i in range(100)) and last.depth == 99


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def record(size, digest, mtime):
    return field(4, field(2, size) + field(6, field(1, digest))) + field(13, mtime)


def test_sync_records(spark):
    d = bytes(range(32))
    data = [
        (record(300, d, 1_700_000_000), (True, 300, d.hex(), 1_700_000_000)),
        (field(3, 5), (False, 0, None, 5)),
        (field(4, b""), (True, 0, None, None)),
        (record(300, d[:31], 7), (True, 300, None, 7)),
        (record(300, d, 7)[:20], (False, 0, None, None)),
        (field(3, 5) + b"\x2d\x01\x02\x03\x04" + b"\x31" + b"8" * 8 + field(13, 6), (False, 0, None, 6)),
        (b"\x80", (False, 0, None, None)), (b"\x0f\x01", (False, 0, None, None)), (b"", (False, 0, None, None)), (None, (False, 0, None, None)),
    ]
    df = frame(spark, [(i, bytearray(b) if b is not None else None) for i, (b, _) in enumerate(data)], "i int, b binary")
    got = [tuple(r.r) for r in df.coalesce(1).select(nodes.sync_record("b").alias("r")).collect()]
    assert got == [want for _, want in data]


def test_store(spark):
    d, e = bytes(32), bytes(range(32))
    rows = [(1, None, "", None, True), (2, 1, "a", b"", True), (3, 2, "f1", record(5, d, 9), True), (4, 2, "f2", record(6, d, 9), True), (5, 2, "f3", record(7, e, 9), True), (6, 2, "old", record(7, e, 9), False), (7, 2, "sub", b"", True), (8, 7, "f4", record(8, e[::-1], 3), True), (9, 1, None, b"", True), (10, 1, "f5", record(1, e[1:] + e[:1], 3), True)]
    entries = nodes.sync_entries(frame(spark, [(i, p, n, None if m is None else bytearray(m), latest) for i, p, n, m, latest in rows], "id long, parent long, name string, metadata binary, latest boolean"))
    assert {r.id: r.poisoned for r in entries.collect()} == {1: False, 2: False, 3: True, 4: True, 5: False, 7: False, 8: False, 10: False}
    paths = nodes.folder_paths(entries.filter("not is_file"))
    states = frame(spark, [("a", "dataless"), ("x", "done")], "path string, state string")
    got = {r.path: (r.is_file, r["size"], r.hash, r.state) for r in nodes.backfill(states, entries, paths).collect()}
    assert got == {"a/f1": (True, 5, None, None), "a/f2": (True, 6, None, None), "a/f3": (True, 7, e.hex(), None), "a/sub": (False, None, None, "backfilled"), "a/sub/f4": (True, 8, e[::-1].hex(), None)}
    files = frame(spark, [("a/f1", True, None), ("a/f3", True, None), ("a/sub/f4", False, None), ("a/f9", True, None), ("a/f2", True, "h")], "path string, dataless boolean, hash string")
    assert {r.path: (r.hash, r.poisoned) for r in nodes.filled_hashes(files, entries, paths).collect()} == {"a/f1": (None, True), "a/f3": (e.hex(), False), "a/sub/f4": (None, False), "a/f9": (None, False), "a/f2": ("h", False)}


def test_walk(spark):
    schema = "path string, device long, flags long, depth int, errno int"
    data = [("r", 1, 0, 0, None), ("r/a", 1, 0, 1, None), ("r/a/b", 1, 0, 2, 13), ("r/a/b/c", 1, 0, 3, None), ("r/m", 2, 0, 1, None), ("r/m/x", 2, 0, 2, None), ("r/l", 1, nodes.FIRMLINK, 1, None), ("r/e", 1, None, 1, None), ("r/d", 1, 0, 1, nodes.WOULD_DOWNLOAD), ("r/t", 1, 0, 1, None), ("r/t/u", 1, 0, 2, None), ("r/t/u/v", 1, 0, 3, None), ("r/t/u/v/w", 1, 0, 4, None)]
    listing = frame(spark, data, schema)
    got = {r.path: r.state for r in nodes.walk_states(listing, 1, ["r/e"], cap=3).collect()}
    assert got == {"r": "done", "r/a": "done", "r/a/b": "error", "r/m": "foreign", "r/l": "foreign", "r/e": "excluded", "r/d": "dataless", "r/t": "done", "r/t/u": "done", "r/t/u/v": "too-deep"}
    left = nodes.resumed(frame(spark, [("r", "done"), ("r/a", "pending")], "path string, state string"), listing.filter("depth < 2"))
    assert {r.path for r in left.collect()} == {"r/a", "r/m", "r/l", "r/e", "r/d", "r/t"}
