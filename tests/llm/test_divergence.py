"""The divergence audit against a plain count in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from siltstone.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, key string, g long, p string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    counts, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    for lang in {x for x, _ in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(c):
            size = sum(c[t] for t in kept) + len(kept)
            return [1 + 10**9 * (c[t] + 1) // size for t in kept]

        of = {s: shares(c) for s, c in groups.items()}
        whole = shares(sum(groups.values(), Counter()))
        for s, own in of.items():
            pairs = [(o, sum((p - q) ** 2 // q for p, q in zip(own, other))) for o, other in of.items() if o != s]
            terms = [(t, (p - q) ** 2 // q) for t, p, q in zip(kept, own, whole) if groups[s][t] and p > q]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, "t", "k", 1, "p") for i, r in enumerate(rows)], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def test_odd_rows(spark):
    texts = [None, "", " 1 2 3", "One TWO three", "one two", "ONE é É İ Σ", "İ İ é one", "日本語 日本語 one", "x" * 500_000 + " one", "a_b-c one two", "one one one"]
    rng = random.Random(4)
    rows = [(rng.choice(texts), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "S1"])) for _ in range(300)]
    rows += [("alone here", "single", "only")] * 4 + [("rare", "none", f"n{i}") for i in range(2)] + [("half", "tie", f"t{i % 2}") for i in range(6)]
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, rows, top=1) == brute(rows, top=1)
    assert audited(spark, []) == []


def test_many_sources_fall_into_blocks(spark):
    """More sources than a block holds, a third of all rows in one of them, heavy and light terms."""
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(" ".join(rng.choices(words[: 5 + 115 * (i % 7 == 0)], k=rng.randint(1, 12))), "en", f"s{i % 300}" if i % 3 else "s0") for i in range(1_500)]
    assert audited(spark, rows) == brute(rows)


@pytest.mark.parametrize("n,total", [(0, 1), (5, 6), (10**14, 3 * 10**14), (9 * 10**15 - 2, 9 * 10**15 - 1), (0, 9 * 10**15)])
def test_shares_are_exact(spark, n, total):
    got = spark.range(1).selectExpr(f"{divergence.share(f'{n}L', f'{total}L')} AS p").first().p
    assert got == 1 + 10**9 * (n + 1) // total


def test_query_equals_a_plain_count(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_divergence(spark, "/root/testdata/sf0.001").collect()) == brute(rows)
