"""Each operator against brute force and on odd tables: nulls, empty and long texts, ties, repeats,
empty tables, extra columns with clashing names."""

import collections
import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from siltstone.llm import ann, iblt, langid, mixing, packing, queries, sharding, simhash, tokens, urls, warc
from siltstone.llm.common import scratch_path
from siltstone.llm.queries import MIX_WEIGHTS, source_domain
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, block string, shard string"
LONG = "Überlange Zeile mit Wörtern. " * 20_000
TEXTS = [
    None, "", " ", "\n\n", "one", "two words", "Three Words Here. Same again.\nThree Words Here. Same again.",
    "a  b\t c\n\n d ", " lead and trail ", "<|endoftext|> inside<|endoftext|> text", "İstanbul ΑΣ Σ é x\x1cy", "don't we'll I'VE", LONG, "Three Words Here. Same again.\nThree Words Here. Same again.",
    "日本語のテキスト。もう一つ", "12345 67 8", "☃☃   x",
]


def rows_of(texts):
    return [(i, t, ["en", None, "de"][i % 3], f"src{i % 4}" if i % 5 else None, 0, 7, "b", "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(TEXTS)
    return spark.createDataFrame([*rows, rows[6], (None, "no id", "en", "src1", 0, 7, "b", "s")], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_jump_matches_the_published_generator(spark):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [str(k) for k in range(300)] + ["", "x" * 1000]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", *[sharding.jump_shard(F.col("k"), n).alias(f"n{n}") for n in (1, 8, 9, 200)])
    for r in df.collect():
        start = int(hashlib.md5(r.k.encode()).hexdigest()[:16], 16)
        for n in (1, 8, 9, 200):
            assert r[f"n{n}"] == jump(start, n)
        assert r.n9 in (r.n8, 8)


def test_shards_and_slots(spark, docs, none):
    out = sharding.assign_shards(docs, "doc_id", 4, order=["text"]).collect()
    assert len(out) == docs.count()
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.assign_shards(none, "doc_id", 4).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_shard(F.col("doc_id"), 0)


def test_shards_keep_clashing_columns_and_are_written(spark, docs, tmp_path):
    odd = docs.select("doc_id", F.lit("b").alias("_block"), F.lit("f").alias("_first"), F.lit("n").alias("_nth"), F.lit("r").alias("_rows"))
    got = sharding.assign_shards(odd, "doc_id", 4)
    assert {(r["_block"], r["_first"], r["_nth"], r["_rows"]) for r in got.collect()} == {("b", "f", "n", "r")}
    sharding.write_shards(docs, str(tmp_path / "shards"), "doc_id", 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((str(r.doc_id), r["shard"]) for r in back.collect()) == sorted((str(r.doc_id), r["shard"]) for r in got.collect())


def test_pieces_and_words_beyond_the_longest_are_not_kept():
    """A text without spaces is one piece: counted by the library, held by no cache."""
    assert tokens.LONGEST < len("日本語" * 100)
    packing.encode_texts(["日本語" * 100 + " word"], public_tokenizers.path("word_bpe_49k.json"), 1)
    kept = [w for key, cache in tokens._WORKER.items() if key[0] in ("ids", "lengths") for w in cache]
    assert kept and max(map(len, kept)) <= tokens.LONGEST


def test_token_counts_equal_the_library(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for size in (0, 1_000):
        for r in tokens.count_tokens(docs, path, tier_size=max(1, size), cache_size=5).join(docs.select("doc_id", "text"), "doc_id").collect():
            assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids), r
            assert r.n_bytes == len((r.text or "").encode())
    assert tokens.count_tokens(none, path).count() == 0


def test_frequent_pieces_are_counted_over_all_texts(spark):
    """Word k occurs k + 1 times in 120,000 rows: only the whole count tells which words are in front."""
    rows = spark.range(120_000).selectExpr("concat('w', floor((sqrt(8 * id + 1) - 1) / 2), ' all\\nrare', id) AS text")
    seen = collections.Counter(p for r in rows.collect() for p in tokens.pieces(r.text))
    assert set(tokens.frequent_pieces(rows, "text", 300)) == {p for p, _ in seen.most_common(300)}
    assert tokens.frequent_pieces(rows, "text", 0) == []


def test_piece_rows_are_the_pieces(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "The", " ", " ", "\n", "\t", ".", "é", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "\r\n", "<|endoftext|>"]) for _ in range(rng.randint(0, 9))) for _ in range(3_000)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert collections.Counter(r.piece for r in tokens.piece_rows(rows, "text").collect()) == collections.Counter(p for t in texts for p in tokens.pieces(t or ""))


def test_pieces_are_exact_on_random_text():
    rng, t = random.Random(3), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(600):
        text = "".join(rng.choice(["a", "The", " ", " ", "\n", "\t", ".", "'s", "é", "7", "\x1c", "　", "<|endoftext|>", "\r\n"]) for _ in range(rng.randint(0, 12)))
        cut = tokens.pieces(text)
        assert "".join(cut) == text
        assert sum(len(t.encode(p, add_special_tokens=False).ids) for p in cut) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


def test_many_pieces_are_one_text_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(11)
    alphabet = ["a", "the", "\n", "\t", "\x1c", "\u00a0", "\u3000", "<|endoftext|>", "'s", "é", "日本", "\u0120", "😀", "\u0301", ".", "7", " "]
    own = list({p for _ in range(3_000) for p in tokens.pieces("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))))} | {f" w{i}" for i in range(12_000)})
    assert tokens.piece_lengths(path, own) == [len(t.encode(p, add_special_tokens=False).ids) for p in own]
    assert tokens.piece_lengths(path, []) == []
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return t.encode_batch_fast(texts, **more)

        def get_vocab(self):
            return t.get_vocab()

    tokens._WORKER[("tokenizer", path)] = Counted()
    try:
        tokens.piece_lengths(path, [f" w{i}" for i in range(5_000)])
    finally:
        del tokens._WORKER[("tokenizer", path)]
    assert len(asked) == 1


def test_word_ids_are_exact_on_random_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng, t = random.Random(4), Tokenizer.from_file(path)
    texts = ["".join(rng.choice(["a", "The", " ", " ", "\n", "\t", ".", "'S", "É", "7", "\x1c", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ", "İ", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    for text, got in zip(texts, packing.encode_texts(texts, path, 1), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_the_cache_of_ids_is_bounded_in_bytes():
    """Words of 100 characters in another script take far more than entries tell."""
    path, limit = public_tokenizers.path("word_bpe_49k.json"), 1 << 20
    rng, t = random.Random(6), Tokenizer.from_file(path)
    texts = [" ".join("".join(rng.choices("日本語の文章", k=100)) for _ in range(4)) for _ in range(2_048)]
    tokens._WORKER.clear()
    most = 0
    for at in range(0, len(texts), 256):
        got = packing.encode_texts(texts[at : at + 256], path, 1, cache_bytes=limit)
        cache = tokens._WORKER[("ids", path)]
        most = max(most, sum(sys.getsizeof(w) + sys.getsizeof(ids) for w, ids in cache.items()))
        assert np.frombuffer(got[0], "<u4").tolist() == [*t.encode(texts[at], add_special_tokens=False).ids, 1]
    one = packing._held([w for x in texts[:256] for w in x.split()]) * 3
    assert 0 < most <= limit + one
    packing.encode_texts(texts, path, 1, cache_bytes=64 * limit)
    assert len(tokens._WORKER[("ids", path)]) == len({w for x in texts for w in x.split()})


class _Asked:
    """A tokenizer that counts the words and the texts that it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words, self.texts = tokenizer, collections.Counter(), 0

    def __getattr__(self, name):
        of = getattr(self.tokenizer, name)
        if not name.startswith("encode"):
            return of

        def asked(texts, **more):
            all_texts = [texts] if isinstance(texts, str) else texts
            self.texts += len(all_texts)
            for x in all_texts:
                self.words.update(x.split())
            return of(texts, **more)

        return asked


def test_frequent_words_are_asked_for_once_though_the_cache_is_full(monkeypatch):
    """What is met in every chunk stays; both generations together keep to the bound, besides a chunk."""
    path, limit = public_tokenizers.path("word_bpe_49k.json"), 1 << 20
    t = Tokenizer.from_file(path)
    asked = _Asked(t)
    tokens._WORKER.clear()
    monkeypatch.setitem(tokens._WORKER, ("tokenizer", path), asked)
    letters = ["".join("abcdefghij"[int(d)] for d in str(10_000 + i)) for i in range(90_000)]
    common, rare = letters[:300] + [w + "!!" for w in letters[:100]], iter(letters[300:])
    most = 0
    for _ in range(25):
        texts = [" ".join(common)] + [f"{next(rare)} {next(rare)}#" for _ in range(1_000)]
        got = packing.encode_texts(texts, path, 1, cache_bytes=limit)
        for k in (0, 1, 500, 1_000):
            assert np.frombuffer(got[k], "<u4").tolist() == [*t.encode(texts[k], add_special_tokens=False).ids, 1]
        held = [x for key, kept in tokens._WORKER.items() if key[0] in ("ids", "older ids") for x in kept.items()]
        most = max(most, packing._held([w for w, _ in held]) + sum(len(ids) for _, ids in held))
    tokens._WORKER.clear()
    assert {asked.words[w] for w in common} == {1}
    assert limit / 2 < most <= limit + packing._held(letters[:3_000])


def test_words_with_marks_are_one_text_to_the_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, rng = Tokenizer.from_file(path), random.Random(12)
    alphabet = ["a", "the", "É", "'s", "'", "!", "###", "7", "42", "²", "<", "|>", "<|", ".", ",", "日本", "Σ", "İ", "\u0301", "\u0958", "\x00", "\x1c", "\u3000", "\t", "_", "😀"]
    words = list({"".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 6))) for _ in range(4_000)} | {"x" * 300, "日本語!" * 200})
    for own in (words, [*words, "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|startoftext|>"]):
        got = packing._encode_words(own, path)
        assert all(np.frombuffer(got[w], "<u4").tolist() == t.encode(w, add_special_tokens=False).ids for w in own) and len(got) == len(own)
    asked = _Asked(t)
    packing._bounds(path)
    monkeypatch.setitem(tokens._WORKER, ("tokenizer", path), asked)
    packing._encode_words([f"w{i}!" for i in range(5_000)], path)
    assert asked.texts == 1
    assert packing._encode_words([], path) == {}


def test_texts_in_small_chunks_have_the_same_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, rng = Tokenizer.from_file(path), random.Random(13)
    alphabet = ["word", "The", " ", " ", "\n", "ÀÉ", ".", ",", "_.", "..", "(a.b)", "3.14", "x,", "'s", "日本", "\x00", "\t", "<|endoftext|>"]
    texts = ["", " ", "."] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(1_500)]
    expected = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    for chunk, chars in ((1, 1), (7, 1 << 20), (1_024, 100), (1_024, 4 << 20)):
        monkeypatch.setattr(packing, "_CHUNK", chunk)
        monkeypatch.setattr(packing, "_CHUNK_CHARS", chars)
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(texts, path, 1)] == expected
    assert packing.encode_texts([], path, 1) == []


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, window=64, with_ids=True).collect()
    expected = sorted(tuple(t.encode(r.text or "", add_special_tokens=False).ids) + (1,) for r in docs.collect())
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.length == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32
        if r.doc_id != 6:
            whole[r.doc_id] = whole.get(r.doc_id, ()) + tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert len(whole) == len({r.doc_id for r in got}) - 1
    assert all(ids in expected for ids in whole.values())
    assert sum(r.length for r in got) == sum(map(len, expected))
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(none, path).count() == 0


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(5)
    lengths = [rng.randint(1, 63) for _ in range(500)]
    number, offset = packing.best_fit_decreasing(lengths, 64)
    rooms, expected = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [w for w, room in enumerate(rooms) if room >= lengths[i]]
        if not fits:
            rooms.append(64)
            fits = [len(rooms) - 1]
        w = min(fits, key=lambda w: rooms[w])
        rooms[w] -= lengths[i]
        expected[i] = rooms[w]
    assert len(rooms) == max(number) + 1
    used = {}
    for n, w, o in sorted(zip(lengths, number, offset, strict=True), key=lambda x: (x[1], x[2])):
        assert used.get(w, 0) == o
        used[w] = o + n
    assert sorted(64 - u for u in used.values()) == sorted(rooms)


def test_sketches_recover_the_difference():
    rng = np.random.default_rng(1)
    left, right = [], []
    for n, shared in ((0, 0), (0, 5), (3, 0), (40, 10), (500, 3), (5_000, 100)):
        both = rng.integers(0, 2**63, shared).astype(np.uint64)
        left.append(np.r_[both, rng.integers(0, 2**63, n).astype(np.uint64)])
        right.append(np.r_[both, rng.integers(0, 2**63, n // 2).astype(np.uint64)])
    for a, b, (only_a, only_b) in zip(left, right, iblt.differing(left, right), strict=True):
        assert set(only_a.tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(only_b.tolist()) == set(b.tolist()) - set(a.tolist())


def test_fingerprints_follow_the_brute_force(docs, none, spark):
    rows = sorted([(r.doc_id if r.doc_id is not None else -(2**63), r.text or "", r.doc_id) for r in docs.collect()], key=lambda r: r[:2])
    got = iblt.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)

    def near(a, b):
        a, b = set(iblt.digests(a).tolist()), set(iblt.digests(b).tolist())
        return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))

    expected = []
    for i, (_, text, doc_id) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        expected.append((str(doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest(), round(near(text, changed), 12), round(near(text, following), 12)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got) == sorted(expected)
    by_text = {}
    for r in got:
        if r.doc_id in (6, 13):
            by_text.setdefault("same", set()).add(r.fingerprint)
    assert len(by_text["same"]) == 1
    assert iblt.fingerprint_documents(none).count() == 0
    one = iblt.fingerprint_documents(spark.createDataFrame([(1, "A. B")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/7?x", "https://a.example.com/en/8", "https://b.net/de/1#f", "https://x.example.net/de/8", "http://notexample.net/de/8", "http://o.org/es/a", "http://com/en/", "ftp://h", "http://x.org?q=://b/c", "http://é.fr/ü"]


def test_url_rules_and_scores(spark):
    rules = [urls.Rule("block", "com", "/en/"), urls.Rule("allow", "example.com", "/en/7"), urls.Rule("allow", "net", "/de/"), urls.Rule("block", "example.net", "/de/8"), urls.Rule("block", "org", "/es/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string, rule string")

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
            path = rest[n:].split("?")[0].split("#")[0]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best.name if best else None, best.verdict if best else None

    got = urls.judge(pages, rules).collect()
    assert len(got) == len(URLS) * 3
    for r in got:
        host, path, rule, verdict = brute((URLS * 3)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    clash = pages.withColumns({"score": F.lit("s"), "verdict": F.lit("v"), "by_rule": F.lit("b"), "key": F.lit("k"), "uses": F.lit("u")})
    assert sorted(map(tuple, urls.judge(clash, rules).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages.filter("url is null"), rules).collect()} == {"allow"}


def test_url_model_tells_apart_what_rules_did_not(spark):
    rng = random.Random(2)
    word = lambda pool: "".join(rng.choice(pool) for _ in range(6))
    known = [(f"http://{word('abcde')}.com/x/{i}", False) for i in range(300)] + [(f"http://{word('vwxyz')}.com/x/{i}", True) for i in range(300)]
    asked = {f"http://{word(pool)}.com/q": pool == "abcde" for pool in ("abcde", "vwxyz") for _ in range(100)}
    scores, threshold = urls.score_urls(spark.createDataFrame(known + [(u, None) for u in asked], "url string, rejected boolean"))
    got = {r.key: r.score for r in scores.collect()}
    right = sum((got[hashlib.md5(u.encode()).hexdigest()] >= threshold) == good for u, good in asked.items())
    assert right >= 0.975 * len(asked)


@pytest.mark.parametrize("tier_size", [1, 20, 100_000])
def test_url_scores_follow_the_brute_force(spark, tier_size):
    """Counts, smoothing, folds and threshold again from plain dictionaries."""
    rng = random.Random(4)
    words = ["news", "shop", "müller", "x", "a" * 30, "日本", "id=12345", "", "page", "index.html"]
    known = [("/".join(rng.choice(words) for _ in range(rng.randint(1, 5))), rng.random() < 0.4) for _ in range(120)]
    known = list(dict(known).items())
    known += known[:15] * 3 + [(None, None), ("", None), ("unseen/☃/zz", None), ("long/" * 3_000, None), ("z", None)]
    found, threshold = urls.score_urls(spark.createDataFrame(known, "url string, rejected boolean"), order=3, tier_size=tier_size)
    got = {r.key: r for r in found.collect()}
    fold = lambda u: xxhash.xxh64_intdigest(u.encode(), 42) % 2
    counts = {}
    for u, rejected in known:
        if rejected is not None:
            b = b"\2\2\2" + u.encode()
            for at in range(3, len(b)):
                for k in range(4):
                    cell = counts.setdefault((rejected, fold(u), b[at - k : at]), {})
                    cell[b[at]] = cell.get(b[at], 0) + 1

    def chance(rejected, folds, context, byte):
        p = 1 / 256
        for k in range(len(context) + 1):
            cells = [counts.get((rejected, f, context[len(context) - k :]), {}) for f in folds]
            p = (sum(c.get(byte, 0) for c in cells) + 2 * p) / (sum(sum(c.values()) for c in cells) + 2)
        return p

    for rejected in (False, True):
        for context in (b"\2\2\2", b"ew\xc3", b"/ne", b"qqq"):
            assert abs(sum(chance(rejected, (0, 1), context, v) for v in range(256)) - 1) < 1e-9

    def score(u, folds):
        b = b"\2\2\2" + u.encode()
        each = [np.log(chance(False, folds, b[at - 3 : at], b[at]) / chance(True, folds, b[at - 3 : at], b[at])) for at in range(3, len(b))]
        return sum(each) / len(each) if each else 0.0

    calibration = []
    for u, rejected in set((u or "", r) for u, r in known):
        r = got[hashlib.md5(u.encode()).hexdigest()]
        assert r.uses == sum((v or "") == u for v, _ in known)
        assert abs(r.score - score(u, (0, 1))) < 1e-6
        assert abs(r.other_score - score(u, (1 - fold(u),))) < 1e-6
        calibration += [(r.other_score, rejected)] * r.uses if rejected is not None else []
    accuracy = lambda t: np.mean([s >= t for s, rej in calibration if not rej]) + np.mean([s < t for s, rej in calibration if rej])
    assert accuracy(threshold) >= max(accuracy(s) for s, _ in calibration) - 0.05


def brute_words(t):
    return (t or "").encode().lower().split()


def test_simhash_and_components(spark, none):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "x"] + [f"w{i}" for i in range(300)]
    texts = [*TEXTS[:12]]
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 400))]
        texts.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
    texts += texts[:20]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    fps = []
    for t in texts:
        w = brute_words(t)
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    assert [got[i].fp % 2**64 for i in range(len(texts))] == fps
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert [got[i].component for i in range(len(texts))] == root
    assert simhash.near_duplicates(none).count() == 0


def test_links_are_joined_by_shuffle(spark, tmp_path):
    """Cells of fingerprints that are read from files, which Spark sizes as one row each, are not broadcast."""
    spark.range(20_000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/nodes")
    plan = simhash.links(spark.read.parquet(f"{tmp_path}/nodes"), 2, 32)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("segments,distance", [(64, 2), (32, 2), (32, 3), (16, 1), (8, 2), (16, 4)])
def test_links_lose_nothing(spark, segments, distance):
    rng = random.Random(segments + distance)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1, 0x5555555555555555]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, distance + 1)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [f - 2**64 if f >= 2**63 else f for f in sorted(fps)]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, segments).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= distance}


def test_long_chains_make_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001)] + [(2000, 2000 + i) for i in range(1, 100)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000} | {2000 + i: 2000 for i in range(100)}


def test_deduplicate_keeps_one_of_each(spark, docs):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # the null, empty and blank texts share fingerprint zero; 6, its repeated row and 13 are copies
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(set(range(17)) - {1, 2, 3, 13})
    assert [r.text for r in rows if r.doc_id is None] == ["no id"]


def sample_languages(n, rng):
    parts = {"en": ["the", "ing", "tion", "and", "wh", "er"], "de": ["sch", "ung", "der", "ü", "ich", "ein"], "fr": ["eau", "é", "que", "ou", "ment", "la"], "es": ["ción", "ñ", "el", "os", "ar", "ía"]}
    for i in range(n):
        lang = rng.choice(sorted(parts))
        yield i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang


def test_language_accuracy_on_held_out_rows(spark):
    rows = list(sample_languages(600, random.Random(1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 400"))
    got = langid.predict(df.filter("doc_id >= 400"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(docs, none):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i in (0, 1, 2, 3, 15):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(got[i].lang_pred in ("en", "de") for i in (4, 5, 12, 14))
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_many_labels_are_learned_and_bounded(spark):
    """All of 90 labels are learned, those outside the table in shared families; a bound keeps the most frequent."""
    letters = "abcdefghijklmnopqrst"
    many = [(n * 10 + i, (letters[n // 10] + letters[10 + n % 10]) * (9 + i), f"z{n:02d}") for n in range(90) for i in range(10)]
    few = spark.createDataFrame(many, "doc_id long, text string, lang string")
    model = langid.fit(few)
    assert {label for duels in model.inner.values() for label in duels.labels} == {r[2] for r in many} and len(model.top.labels) <= 12
    assert sum(r.lang_pred == r.lang for r in langid.predict(few, model).collect()) >= 0.9 * len(many)
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abc") for _ in range(30)), "x1") for i in range(40)] + [(100 + i, "".join(rng.choice("uvw") for _ in range(30)), "x2") for i in range(30)]
    rows += [(1_000 + i, "".join(rng.choice("klm") for _ in range(30)), f"y{i:03d}") for i in range(500)]
    df = spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "doc_id long, text string, lang string, label string, score double")
    model = langid.fit(df, max_labels=3)
    learned = {label for duels in model.inner.values() for label in duels.labels}
    assert learned == {"x1", "x2", "y000"}
    got = langid.predict(df, model, keep=["doc_id", "label"]).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= learned and {r.label for r in got} == {"clash"}
    assert all(r.lang_pred == {0: "x1"}.get(r.doc_id // 100, "x2") for r in got if r.doc_id < 200)


def test_no_local_scratch_on_a_cluster(spark):
    from types import SimpleNamespace

    from siltstone.sources import scratch

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError):
        scratch.root(cluster)


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = x[:, 0] - x[:, 1] > 0.1
    w, b = langid.fit_svm(x, y, epochs=50)
    assert ((x @ w + b > 0) == y).mean() > 0.97


def brute_mix(rows, share, epochs, weights, seed):
    """rows: (id, domain, lang, source, tokens) -> (id -> times, leaf -> budget)"""

    def fill(nodes, budget):  # name -> (weight, supply)
        got, left = {}, budget
        open_nodes = dict(nodes)
        while open_nodes:
            total = sum(w for w, _ in open_nodes.values())
            full = [k for k, (w, s) in open_nodes.items() if left * w / total >= s]
            if not full:
                return got | {k: left * w / total for k, (w, _) in open_nodes.items()}
            k = min(full, key=lambda k: (open_nodes[k][1] / open_nodes[k][0], k))
            got[k] = open_nodes[k][1]
            left -= got[k]
            del open_nodes[k]
        return got

    leaves = {}
    for _, d, la, s, n in rows:
        leaves[d, la, s] = leaves.get((d, la, s), 0) + n
    supply = lambda *p: float(sum(n for k, n in leaves.items() if k[: len(p)] == p) * epochs)
    w = lambda level, k: weights.get(level, {}).get(k, 1.0)
    budgets = {}
    for d, b in fill({d: (w("domain", d), supply(d)) for d in {k[0] for k in leaves}}, min(supply(), sum(leaves.values()) * share // 1)).items():
        for la, c in fill({x: (w("lang", x), supply(d, x)) for x in {k[1] for k in leaves if k[0] == d}}, b).items():
            for s, e in fill({x: (w("source", x), supply(d, la, x)) for x in {k[2] for k in leaves if k[:2] == (d, la)}}, c).items():
                budgets[d, la, s] = int(e + 1e-6)
    times = {}
    for leaf, b in budgets.items():
        full, rest = divmod(b, leaves[leaf])
        own = sorted(((hashlib.md5(f"{seed}:{full}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r) for r in rows if r[1:4] == leaf), key=lambda x: x[0])
        at, start, last = 0, 0, None
        for k, r in own:
            if k != last:
                start, last = at, k
            times[r[0]] = full + (start < rest)
            at += r[4]
    return times, budgets


def test_mixing_follows_the_brute_force(spark, none):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), rng.choice(["src0"] * 6 + ["src1", "src2", "src3", None])) for i in range(700)] + [(None, "x y", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    domain = {"src0": "crawl", "src1": "reference", "src3": "reference"}
    thin = [(i, domain.get(s, "forum"), la or "", s or "", max(1, len(t.split()))) for i, t, la, s in rows]
    for share, epochs in ((0.8, 3), (0.3, 1), (2.5, 3), (9.0, 2)):
        got = mixing.mix(df, source_domain(F.col("source")), MIX_WEIGHTS, 20, budget_share=share, max_epochs=epochs, blocks=16).collect()
        times, budgets = brute_mix(thin, share, epochs, MIX_WEIGHTS, 20)
        counted = {}
        for r in got:
            counted[r.doc_id] = counted.get(r.doc_id, 0) + 1
        assert counted == {k: n for k, n in times.items() if n}
        assert {(r.mix_domain, r.lang or "", r.source or ""): r.mix_budget for r in got}.items() <= budgets.items()
    assert mixing.mix(none, source_domain(F.col("source")), MIX_WEIGHTS, 20).count() == 0
    clash = df.select("*", *[F.lit("mine").alias(c) for c in ("_mix_domain", "_mix_leaf", "_mix_plan", "_mix_rows", "leaf", "rows", "mix_domain", "key", "_hot", "epochs")])
    with pytest.raises(ValueError):
        mixing.mix(clash, source_domain(F.col("source")), MIX_WEIGHTS, 20)
    got = mixing.mix(clash, source_domain(F.col("source")), MIX_WEIGHTS, 20, names=("d", "e", "b"), budget_share=0.3).collect()
    assert got and all(r[c] == "mine" for r in got for c in ("_mix_domain", "_mix_leaf", "mix_domain", "leaf", "_hot"))


def test_language_query_splits_and_votes_by_hand(spark, tmp_path):
    """held_out, the training rows, features and votes against plain loops; held-out labels change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    crc = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 for r in docs.collect()}
    held = [i for i, c in crc.items() if c == 2]
    docs.withColumn("lang", F.when(F.col("doc_id").isin(held), "xx").otherwise(F.col("lang"))).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    first, second = ({r.doc_id: tuple(r) for r in queries.op8_langid(spark, str(tmp_path / x)).collect()} for x in "ab")
    assert first == second and set(first) == set(crc) and {r[2] for r in first.values()} <= {"en", "de", "fr", "es", "und"}
    model = langid.fit(docs.filter(~F.col("doc_id").isin(held)))

    def shares(text):
        data = (" " + text + " ").encode()
        data = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in data)
        counts = [0] * langid.DIMENSIONS
        for size in (1, 2, 3):
            for i in range(len(data) - size + 1):
                gram = int.from_bytes(data[i : i + size], "big")
                counts[((gram + (size << 24)) * 2654435761 % 2**32) >> 18] += 1
        return np.sqrt(np.array(counts) / sum(counts))

    def vote(duels, x):
        got = [0.0] * len(duels.labels)
        for n, (a, b) in enumerate((a, b) for a in range(len(got)) for b in range(a + 1, len(got))):
            p = 1 / (1 + np.exp(-4 * (duels.w[n].astype(float) @ x + duels.bias[n])))
            got[a], got[b] = got[a] + p, got[b] + 1 - p
        return [g / (len(got) - 1) for g in got] if len(got) > 1 else [1.0]

    for r in docs.collect():
        _, out, label, score = first[r.doc_id]
        assert out == (crc[r.doc_id] == 2)
        if not any(c.isalpha() for c in r.text or ""):
            assert (label, score) == ("und", 0.0)
            continue
        x = shares(r.text)
        top = vote(model.top, x)
        inner = model.inner[model.top.labels[top.index(max(top))]]
        own = vote(inner, x)
        assert label == inner.labels[own.index(max(own))] and abs(score - max(top) * max(own)) < 1e-3


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(10, 32))
    v = (centers[rng.integers(0, 10, 3_000)] + rng.normal(size=(3_000, 32))) * rng.uniform(0.5, 2, (3_000, 1))
    v[100:130] = v[100]  # ties
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    odd = [(9_000, None, 1), (9_020, [0.0] * 32, 1), (9_040, [float("nan")] * 32, 1), (9_060, [1.0] * 3, 1), (9_080, [None] * 32, 1), (None, [1.0] * 32, 1), (9_100, [float("inf")] * 32, 1)]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>, rank int")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), list_rows=100, block_rows=64, block_queries=16).collect()
    hits, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3_000, 20))
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        s = v @ v[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(3_000), -s))[:20].tolist())
        hits += len(best & {r.vec_id for r in own})
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    assert hits / (20 * len(by)) >= 0.95
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def _true_neighbours(v, queries, k=20):
    with np.errstate(over="ignore", invalid="ignore"):
        for q in queries:
            s = np.array([float((v[i] * v[q]).sum()) for i in range(len(v))])
            order = [i for i in np.lexsort((np.arange(len(v)), -s, np.isnan(s))) if i != q][:k]
            yield q, order, s


def test_ann_with_one_very_long_vector(spark):
    """A vector 10^5 times as long as all others neither lowers recall nor leaves a query short."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(30, 16))
    v = centers[rng.integers(0, 30, 8_000)] + 0.5 * rng.normal(size=(8_000, 16))
    v[77] *= 1e5
    v[78] *= 1e-5
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in ann.search(df, df.filter("vec_id % 200 = 0"), list_rows=64).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, order, _ in _true_neighbours(v, range(0, 8_000, 200)):
        assert len(found[q]) == 20
        hits += len(found[q] & set(order))
    assert hits / (20 * len(found)) >= 0.95


def test_ann_at_the_ends_of_the_doubles(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(31, 8)) * np.array([1e200, 1.0, 1e-200, 1e-310])[np.arange(31) % 4, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, df.filter("vec_id % 5 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    for q, order, s in _true_neighbours(v, range(0, 31, 5)):
        assert [r.vec_id for r in found[q]] == order
        assert all(r.score == s[r.vec_id] or (np.isnan(r.score) and np.isnan(s[r.vec_id])) for r in found[q])


def test_ann_compares_short_queries_with_every_row(spark):
    """Most rows share three ids, so a query's lists hold too few different ones."""
    rng = np.random.default_rng(10)
    v = rng.normal(size=(4_000, 8))
    ids = [i if i < 21 else 1_000 + i % 3 for i in range(4_000)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id = 20"), list_rows=32, block_rows=500).orderBy("rank").collect()
    best = {}
    for i, s in zip(ids, v @ v[20], strict=True):
        if i != 20:
            best[i] = max(s, best.get(i, -np.inf))
    assert [r.vec_id for r in got] == sorted(best, key=lambda i: (-best[i], i))[:20]


PAGES = "page_id long, url string, html string, type string"


def test_warc_round_trip_and_captures(spark):
    same, split = "s" * 200, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nb\r\n\r\nWARC/1.1\r\nc" + "z" * 100
    rows = [(3, "http://a/x", same), (1, "http://b/y?q=1#f", same), (1, "http://b/y?q=1#f", same), (2, None, same), (4, "bad\r\nurl x", "short"), (5, "", "short"), (6, "http://c", None), (7, "http://é/ü", "ü☃\r\n\r\n" * 40), (8, "u", split), (9, "u", split), (None, "n", "t" * 150), (10, "l", LONG)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES).repartition(3)
    path = scratch_path(spark, "test-archives")
    warc.write_archives(warc.page_records(pages), path)
    records = warc.read_archives(spark, path)
    assert records.count() == 3 * len(rows)
    full = warc.assemble(records).collect()
    assert len(full) == len(rows) and not any(r.surplus for r in full)
    seen = {}
    for r in full:
        assert r.request.type == "request" and r.metadata.type == "metadata"
        key = bytes(r.metadata.payload).decode().strip().partition("source-key:")[2].strip()
        seen.setdefault(key, []).append(r.response)
    payload = lambda k: [bytes(x.payload).decode() for x in seen[k] if x.type == "response"]
    assert payload("1") == [same] and payload("8") == [split] and payload("7") == ["ü☃\r\n\r\n" * 40] and payload("10") == [LONG] and payload("6") == [""] and payload("") == ["t" * 150]
    assert sorted(x.type for x in seen["1"]) == ["response", "revisit"]
    assert {k: [x.type for x in v] for k, v in seen.items() if k in list("23459")} == {"2": ["revisit"], "3": ["revisit"], "4": ["response"], "5": ["response"], "9": ["revisit"]}
    thin = warc.digest_payloads(records)
    met = {warc_key(r.metadata): r for r in warc.resolve_revisits(warc.assemble(thin)).collect()}
    assert met["9"].origin.key == "8" and met["9"].origin.payload_sha256 == hashlib.sha256(split.encode()).hexdigest() and met["9"].origin.payload_bytes == len(split)
    assert met["4"].response.target_uri == "bad%0D%0Aurl%20x"
    warc.write_archives(warc.page_records(pages.limit(0)), path + "-empty")
    assert warc.assemble(warc.read_archives(spark, path + "-empty")).count() == 0


def warc_key(metadata):
    return bytes(metadata.payload).decode().strip().partition("source-key:")[2].strip()


def test_warc_links_of_every_shape(spark):
    schema = "type string, record_id string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, content_type string, payload binary"
    row = lambda kind, rid, to: (kind, rid, None, to, None, None, None, b"")
    rows = [row("response", "r1", ["q1"]), row("request", "q1", []), row("metadata", "m1", ["q1"]), row("metadata", "m2", ["r1"]), row("request", "lost", ["nowhere"]), row("response", "r2", []), row("request", "q9", [])]
    got = {r.capture_id + ("+" if r.surplus else ""): r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"r1", "r1+", "r2", "lost", "q9"}
    assert got["r1"].request.record_id == "q1" and got["r1"].metadata.record_id == "m1" and got["r1+"].metadata.record_id == "m2"
    assert got["r2"].request is None and got["lost"].request.record_id == "lost" and got["lost"].response is None
