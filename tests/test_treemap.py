"""The pruned tree map against a plain recursive walk."""

import random

from siltstone.operators import tree


def brute(files, root, budget):
    """(dir, kind, path, size, files, categories) by recursion over nested folders."""
    below = {}
    for path, size, cat in files:
        at = path
        while "/" in at:
            at = at.rsplit("/", 1)[0]
            below.setdefault(at, []).append((path, size, cat))
    floor = max(tree.MAP_FLOOR, sum(s for _, s, _ in below.get(root, [])) // 1_000_000)
    out = set()

    def walk(d, budget, depth):
        own = sorted((-s, "file", p, c) for p, s, c in below[d] if p.rsplit("/", 1)[0] == d)[:50]
        dirs = [(-sum(s for _, s, _ in below[k]), "dir", k, None) for k in below if k.rsplit("/", 1)[0] == d and k != d and "/" in k]
        entries = sorted(own + dirs, key=lambda e: e[:3])
        keep = min(len(entries), max(8, budget // 4), 50)
        total = sum(s for _, s, _ in below[d])
        kept_bytes = max(-sum(e[0] for e in entries[:keep]), 1)
        left, inner = list(below[d]), []
        for i, (size, kind, path, _) in enumerate(entries):
            size = -size
            if (i < keep or size >= 0.005 * max(total, 1)) and size >= floor and depth < 12:
                gone = [f for f in left if f[0] == path or kind == "dir" and f[0].startswith(path + "/")]
                out.add((d, kind, path, size, len(gone), None))
                left = [f for f in left if f not in gone]
                if kind == "dir":
                    inner.append((path, int(max(budget - keep, 0) * (size / kept_bytes))))
        if left:
            cats = {}
            for _, s, c in left:
                cats[c] = cats.get(c, 0) + s
            out.add((d, "rest", None, sum(cats.values()), len(left), tuple(sorted((c, s) for c, s in cats.items() if s > 0))))
        for path, b in inner:
            walk(path, b, depth + 1)

    if root in below:
        walk(root, budget, 0)
    return out


def test_treemap(spark):
    rng = random.Random(7)
    files = {}
    for n in range(900):
        depth = rng.choice([1, 2, 2, 3, 4])
        path = "/".join(["r", *[f"d{rng.randrange(4)}" for _ in range(depth)], f"f{n}"])
        files[path] = (path, int(rng.paretovariate(0.7) * 3000) % 5_000_000, rng.choice(["image", "code", "other"]))
    files |= {f"r/flat/f{n}": (f"r/flat/f{n}", 5000, "code") for n in range(300)}
    deep = "r/" + "/".join(f"x{i}" for i in range(15))
    files[deep + "/end"] = (deep + "/end", 9_000_000, "image")
    files = list(files.values())
    df = spark.createDataFrame(files, "path string, size long, category string").repartition(8)
    for budget in (150,):
        got = {(r.dir, r.kind, r.path, r["size"], r.files, None if r.categories is None else tuple(sorted(r.categories.items()))) for r in tree.treemap(df, "r", budget).collect()}
        assert got == brute(files, "r", budget)
    assert tree.treemap(df, "nowhere", 100).count() == 0
