"""Sensitive and photo rules: names that must and must not fire, folder facts, nulls, repeated rows."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import classify, photos, sensitive
from siltstone.plans import actions

FILE = "dir string, name string, size long"
NOW = 1_735_689_600


def _sensitive(spark, rows, **more):
    out = sensitive.classify_sensitive(spark.createDataFrame(rows, FILE), **more)
    return {(r.dir, r.name): r.sensitive for r in out.collect()}


def _photos(spark, rows, **more):
    return {(r.dir, r.name): r.photo for r in photos.classify_photos(spark.createDataFrame(rows, FILE), F.lit(NOW), **more).collect()}


def test_sensitive_names(spark):
    cases = {
        ("d", "id_rsa", 5): "sn:S1:cred",
        ("d", "deploy_rsa", 5): "sn:S2:cred",
        ("d", "deploy_rsa", 900): "sn:S1:cred",
        ("d", "deploy_ed25519", None): "sn:S1:cred",
        ("d", ".env", 9): "sn:S1:cred",
        ("d", ".env.example", 9): None,
        ("d", "key.asc", 9): "sn:S2:cred",
        ("d", "talk.key", 300_000): None,
        ("d", "proj-0123456789ab.json", 9): "sn:S1:cred",
        ("d", "proj-202401011200.json", 9): None,
        ("d", "book.vcf", 9 << 20): "sn:S1:med",
        ("d", "contacts.vcf", 9 << 20): "sn:S2:bak",
        ("d", "return.tax2019", 9): "sn:S1:fin",
        ("d", "last will and testament.pdf", 9): "sn:S1:leg",
        ("d", "HSBC account.pdf", 9): "sn:S1:fin",
        ("d", "Паспорт.pdf", 9): "sn:S1:id",
        ("d", "إقامة.pdf", 9): "sn:S1:id",
        ("d", "पासपोर्ट.pdf", 9): "sn:S1:id",
        ("d", "passport.js", 9): None,
        ("d", "passport.pdf", 9): "sn:S2:id",
        ("a/nudes", "x.bin", 9): "sn:S1:int",
        ("a/private", "x.jpg", 9): "sn:S2:int",
        ("a/private", "x.bin", 9): None,
        ("", "", None): None,
    }
    got = _sensitive(spark, list(cases))
    # the same name with two sizes cannot share a key: those are asked for one by one
    for (d, n, s), want in cases.items():
        if n == "deploy_rsa":
            assert _sensitive(spark, [(d, n, s)])[d, n] == want
        else:
            assert got[d, n] == want, n


def test_code_trees_keep_credentials_only(spark):
    got = _sensitive(spark, [("r", "passport copy.pdf", 9), ("r", "id_rsa", 900)], in_code=F.lit(True))
    assert got == {("r", "passport copy.pdf"): None, ("r", "id_rsa"): "sn:S1:cred"}


def test_siblings_decide(spark):
    rows = [("s", "employment contract.pdf", 9), ("s", "Token.sol", 9), ("t", "employment contract.pdf", 9), ("p", "eid.jpg", 9), ("q", "eid.jpg", 9)]
    rows += [("p", f"{i}.jpg", 9) for i in range(20)] + [("q", f"{i}.jpg", 9) for i in range(19)]
    got = _sensitive(spark, rows)
    assert got["s", "employment contract.pdf"] is None and got["t", "employment contract.pdf"] == "sn:S1:leg"
    assert got["p", "eid.jpg"] is None and got["q", "eid.jpg"] == "sn:S2:id"


def test_photo_names(spark):
    cases = {
        ("x", "IMG_1234.jpg", 50_000): "ph:likely",
        ("x", "img_1234.jpg", 5_000): "ph:asset",
        ("a/DCIM", "IMG_1234.jpg", 5_000): "ph:cert",
        ("a/100CANON", "mine.jpg", 50_000): "ph:poss",
        ("x", "20190601_120000.jpg", 50_000): "ph:likely",
        ("x", "19700601_120000.jpg", 50_000): None,
        ("x", "a.heic", 50_000): "ph:likely",
        ("x", "Scan 3.png", 50_000): "ph:poss",
        ("x", "123456789.png", 50_000): "ph:asset",
        ("x", "photo.webp", 50_000): "ph:asset",
        ("x", "small.png", 5_000): "ph:asset",
        ("x", "none.png", None): None,
        ("x/My.app", "b.dng", 9): "ph:asset",
        ("x", "pair.xmp", 9): "ph:side",
        ("x", "PAIR.raf", 9): "ph:cert",
        ("y", "pair.xmp", 9): "jB:SC",
        ("x", "text.txt", 9): None,
    }
    got = _photos(spark, list(cases))
    assert {k: got[k[:2]] for k in cases} == cases


def test_photo_root_and_missing_bytes(spark):
    rows = [("/assets/Camera Uploads/2020", "mine.jpg", 50_000), ("/z", "mine.jpg", 50_000)]
    assert _photos(spark, rows, root="/assets/Camera Uploads")["/assets/Camera Uploads/2020", "mine.jpg"] == "ph:poss"
    assert _photos(spark, rows)["/assets/Camera Uploads/2020", "mine.jpg"] == "ph:asset"
    assert _photos(spark, rows, dataless=F.lit(True))["/z", "mine.jpg"] == "ph:unk"


@pytest.mark.parametrize("classify", [sensitive.classify_sensitive, lambda f: photos.classify_photos(f, F.lit(NOW))])
def test_nulls_empty_and_repeated(spark, classify):
    assert classify(spark.createDataFrame([], FILE)).count() == 0
    assert classify(spark.createDataFrame([(None, None, None)] * 3 + [("d", "id_rsa", None)] * 2, FILE)).count() == 5


def test_shown_category(spark):
    rows = [("a.pdf", "jA:J1", None), ("a.png", "ph:screen", "git"), ("a.pdf", "sn:S1:id", None), ("a.pdf", None, "cache"), ("a.jpg", None, "project"), ("a.dng", None, "vm"), (None, None, None)]
    out = spark.createDataFrame(rows, "name string, code string, zone string").select(classify.shown_category(F.col("name"), F.col("code"), F.col("zone")).alias("c"))
    assert [r.c for r in out.collect()] == ["junk", "screenshots", "documents", "cache", "code", "photos", "other"]


MOVED = "id long, dir string, name string, size long, mtime long, photo string"


def test_photos_travel_once_and_with_their_pair(spark):
    day = 1_559_390_400
    rows = [
        (1, "a", "IMG_1.jpg", 5, day, "ph:likely"),
        (2, "a", "img_1.mov", 6, None, "ph:likely"),
        (3, "a", "IMG_1.AAE", None, day, "ph:side"),
        (4, "a", "IMG_1.pdf", 7, day, None),
        (5, "Photos/2019/06", "IMG_2.jpg", 5, day, "ph:cert"),
        (6, "x/old", "IMG_3.jpg", 5, 0, "ph:cert"),
        (7, None, "IMG_4.jpg", 5, None, "ph:cert"),
        (8, "b", "IMG_1.AAE", 5, day, "jB:SC"),
        (9, "s", "shot.png", 5, None, "ph:screen"),
    ]
    files = spark.createDataFrame(rows, MOVED)
    assert {r.id: r.dst for r in actions.photo_plan(files, 2025).collect()} == {1: "Photos/2019/06/IMG_1.jpg", 2: "Photos/2019/06/img_1.mov", 3: "Photos/2019/06/IMG_1.AAE", 6: "Photos/_Unknown-Date/old/IMG_3.jpg", 7: "Photos/_Unknown-Date/root/IMG_4.jpg"}
    assert [(r.src, r.dst) for r in actions.screenshot_plan(files, 2025).collect()] == [("s/shot.png", "Screenshots/_Undated/shot.png")]
    assert actions.photo_plan(files.limit(0), 2025).count() == 0


def test_archive_takes_whole_idle_items_without_secrets(spark):
    old, late = 1_300_000_000, NOW - 10
    rows = [("random/a", "x", 5, old, None), ("random", "y", 6, old + 9, None), ("mixed", "a", 1, old, None), ("mixed/b", "c", 1, late, None), ("docs", "p", 1, old, "sn:S1:id"), ("docs", "q", 1, old, None), ("Photos", "p", 1, old, None), ("repo", "p", 1, old, None), (None, "note.txt", 3, old, None), ("", "id_rsa", 3, old, "sn:S1:cred"), ("none", "n", 1, None, None)]
    files = spark.createDataFrame(rows, "dir string, name string, size long, mtime long, sensitive string")
    out = actions.archive_plan(files, NOW, protected=spark.createDataFrame([("repo",)], "top string"))
    assert {(r.src, r.dst, r.size) for r in out.collect()} == {("random", "Archive/2011/random", 11), ("note.txt", "Archive/2011/note.txt", 3)}
