"""Conversation repair against an exhaustive search over edits."""

import hashlib
import random
import re
import zlib

import pytest

from siltstone.llm import dialogue, queries

SCHEMA = "conv_id long, turn long, role string, text string, part int, conv string, nth string"
PATTERN = re.compile(r"(s?(ua)+)?")


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """rows (turn, role, text) of one conversation; every sequence of edits with up to two inserts in a row."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, found = fault_of(rows), []

    def go(i, cost, audit, lines, inserts):
        if inserts < 2:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*lines, f"{role}:"], inserts + 1)
        if i == len(rows):
            if PATTERN.fullmatch("".join(x[0] for x in lines)):
                found.append((cost, audit, "\n".join(lines)))
            return
        _, role, text = rows[i]
        go(i + 1, cost + 3, audit + "D", lines, 0)
        if faults[i] in ("blank", "duplicate"):
            return
        more = int(faults[i] == "truncated")
        if role:
            go(i + 1, cost + more, audit + "K", [*lines, f"{role}:{text}"], 0)
        for new in ("user", "assistant"):
            go(i + 1, cost + 2 + more, audit + "R", [*lines, f"{new}:{text}"], 0)

    go(0, 0, "", [], 0)
    cost, audit, text = min(found)
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()


def test_repair_equals_every_edit_tried(spark):
    rng, rows = random.Random(7), []
    for conv in range(60):
        for _ in range(rng.randint(0, 4)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 5]), rng.choice(["system", "user", "assistant", "tool", "User", None, "", "ux"]), rng.choice(["Well.", "cut", "", " \n", "Why?", None, "Well."]), 1, "c", "n"))
    rows += [(None, 1, "user", "No name.", 1, "c", "n"), (None, 2, "assistant", "None either.", 1, "c", "n")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair(df).collect()}
    for conv in {r[0] for r in rows}:
        assert got.pop(conv) == brute([r[1:4] for r in rows if r[0] == conv]), conv
    assert not got


def test_one_conversation_over_many_tasks_equals_one_fold(spark):
    """A third of all rows in one conversation: its stretches lie in several tasks."""
    rng = random.Random(8)
    long = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "b", "", f"Turn {t}."]), 0, "c", "n") for t in range(3_000)]
    rest = [(c, t, ["user", "assistant"][t % 2], "Fine.", 0, "c", "n") for c in range(100, 1_100) for t in range(5)]
    rows = {r.conv_id: r for r in dialogue.repair(spark.createDataFrame(long + rest, SCHEMA).repartition(6)).collect()}
    assert len(rows) == 1_001
    own = [r[1:4] for r in long]
    faults = fault_of(own)
    kinds = [dialogue.kind_of(role, text, fault == "duplicate")[0] for (_, role, text), fault in zip(own, faults, strict=True)]
    line = [(0, "")] + [None] * 3  # a plain scan, one state vector after the other
    for kind in kinds:
        m = dialogue.turn_matrix(kind)
        line = [min(((x[0] + m[i][j][0], x[1] + m[i][j][1]) for i, x in enumerate(line) if x and m[i][j]), default=None) for j in range(4)]
    end = dialogue.multiply((tuple(line),) * 4, dialogue.CLOSURE)[0]
    cost, audit = min(x for x in (end[0], end[3]) if x)
    text = "\n".join(list(dialogue.replay(((k, r, x) for k, (_, r, x) in zip(kinds, own, strict=True)), audit))[:-1])
    assert (rows[7].cost, rows[7].audit, rows[7].repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
    assert rows[7].blank == faults.count("blank") and rows[7].duplicate == faults.count("duplicate") and rows[7].gaps == 0
    assert PATTERN.fullmatch("".join(x[0] for x in text.split("\n") if x))


def test_products_are_associative():
    rng = random.Random(9)
    for _ in range(200):
        kinds = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(3, 12)))
        cut = rng.randint(1, len(kinds) - 1)
        straight = dialogue.turn_matrix(kinds[0])
        for k in kinds[1:]:
            straight = dialogue.multiply(straight, dialogue.turn_matrix(k))
        assert dialogue.fold(kinds) == straight == dialogue.multiply(dialogue.fold(kinds[:cut]), dialogue.fold(kinds[cut:]))


def test_no_rows_and_long_texts(spark):
    assert dialogue.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 2**63 - 1, "user", "x" * 1_000_000, 0, "c", "n"), (1, -(2**63), "assistant", "End.", 0, "c", "n")]
    (r,) = dialogue.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r.gaps == 2**63 - 1 and (r.cost, r.truncated, r.illegal) == (5, 1, 0)


@pytest.mark.parametrize("odd", [[(None, None, None, None)], [(3, 0, "user", "Hi.")] * 3])
def test_query_keeps_every_conversation(spark, tmp_path, odd):
    rows = [(c, t, ["user", "assistant"][t % 2], "Said.") for c in range(40) for t in range(2)] + odd
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op12_dialogue(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    dropped = [c for c in range(40) if c != 3 and all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in range(2))]
    for c in dropped:
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
