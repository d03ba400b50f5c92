"""Record pipeline: lint rules, incremental delivery, stale outputs, sentence index, entity match."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.joins import hot_split_join
from siltstone.functions.text import jaccard
from siltstone.operators import spelling
from siltstone.operators.components import components
from siltstone.sources.scratch import kept

# Sizes of the delivery and of its batches.
DELIVERY_CHUNK, BATCH_SIZE = 100, 184


def rank_of(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("int")


def missing_fields(**columns: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(c.cast("string").rlike(r"\S"), F.lit(False)), F.lit(n)) for n, c in sorted(columns.items())]))


def duplicate_ranks(items: DataFrame, order: str) -> DataFrame:
    """The second and later rows of each rank."""
    nth = F.row_number().over(Window.partitionBy("rank").orderBy(order))
    return items.filter("rank is not null").withColumn("_n", nth).filter("_n > 1").drop("_n")


def lint(items: DataFrame) -> DataFrame:
    """(id, rule) for row rules over (id, rank, text, translation)."""
    text, other = F.col("text"), F.col("translation")
    blank = lambda c: ~F.coalesce(c.rlike(r"\S"), F.lit(False))
    words = lambda c: F.regexp_count(c, F.lit(r"[^ \t\n]+"))
    rules = {
        "missing_rank": F.col("rank").isNull(),
        "empty_field": blank(text),
        "raw_html": F.coalesce(text.rlike(r"<[a-zA-Z/]|&[a-z]+;"), F.lit(False)),
        "non_ascii": F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False)),
        "sentence_pair": blank(text) != blank(other),
        "length_mismatch": ~blank(text) & ~blank(other) & (F.abs(words(text) - words(other)) > F.greatest(F.lit(2.0), F.lit(0.4) * words(other))),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return items.select("id", F.explode(found).alias("rule"))


def shared_sentences(items: DataFrame) -> DataFrame:
    """Rows whose sentence a lower rank keeps: (id, keeper). Sentences travel as digests."""
    rows = items.filter(F.col("text").rlike(r"\S")).select("id", "rank", F.sha2(F.col("text").cast("binary"), 256).alias("_text"))
    keepers = rows.groupBy("_text").agg(F.min(F.struct(F.col("rank").isNull().alias("none"), "rank", "id")).alias("_best"), F.count("*").alias("_rows")).filter("_rows > 1")
    met = hot_split_join(rows, keepers, "_text", "_rows", rows.count())
    return met.filter(F.col("_best").isNotNull() & ~F.col("id").eqNullSafe(F.col("_best.id"))).select("id", F.col("_best.id").alias("keeper"))


def deliver(items: DataFrame, delivered: DataFrame, total: int, allow_unordered: bool = False) -> DataFrame:
    """What is still to be delivered: (rank, position, chunk), in rank order after what is there; nothing
    where order_guard refuses and `allow_unordered` does not overrule it.

    Positions need one total order; only ranks, not records, pass through it, and they are dealt by
    range so that no task numbers them all.
    """
    there = delivered.select("rank").distinct()
    start = there.count()
    todo = items.select("rank").filter("rank is not null").distinct().join(there, "rank", "left_anti")
    guard = order_guard(items, delivered).first()
    if guard is not None and guard["refused"] and not allow_unordered:
        todo = todo.limit(0)
    return number_globally(todo, "rank").filter(F.col("nth") <= max(0, total - start)).select("rank", (F.col("nth") + start).alias("position"), F.floor((F.col("nth") - 1) / DELIVERY_CHUNK).cast("long").alias("chunk"))


def order_guard(items: DataFrame, delivered: DataFrame, *deck: str) -> DataFrame:
    """(deck.., lowest, highest, refused): whether what is still to be delivered to a deck begins below a rank
    that is there already; it would be studied after it for good, so the delivery is refused."""
    there = delivered.select(*deck, "rank").distinct()
    todo = items.select(*deck, "rank").filter("rank is not null").distinct().join(there, [*deck, "rank"], "left_anti")
    low, high = todo.groupBy(*deck).agg(F.min("rank").alias("lowest")), there.groupBy(*deck).agg(F.max("rank").alias("highest"))
    met = low.join(high, list(deck), "left") if deck else low.crossJoin(high)  # one row each
    return met.withColumn("refused", F.coalesce(F.col("lowest") < F.col("highest"), F.lit(False)))


# Fields that a record must have, those shown to a reader, those in the native script, what
# counts as markup, and the characters beyond ASCII that shown fields may have.
REQUIRED_FIELDS = ["rank", "term", "headword", "gloss", "pos"]
SHOWN_FIELDS = ["headword", "sent_display", "gloss", "sent_en"]
NATIVE_FIELDS = ["term", "sent_native"]
MARKUP = r"[<>]|&[a-z]{2,8};|&#\d+;"
STRAY = r"[^\x00-\x7F’–—]"


def field_lint(items: DataFrame, accent: bool = True) -> DataFrame:
    """(id, field, rule) over all fields of items (id and the fields named above, keep): a rank that is no
    whole number is missing, other required fields must not be blank, no field holds markup, and with
    `accent` shown fields hold neither the native script nor stray characters. Null fields are empty."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    row = lambda test, field, rule: F.when(test, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))
    found = [row(rank_of(F.col("rank")).isNull(), "rank", "empty_field")] + [row(F.trim(c(f)) == "", f, "empty_field") for f in REQUIRED_FIELDS[1:]]
    found += [row(c(f).rlike(MARKUP), f, "raw_html") for f in SHOWN_FIELDS + NATIVE_FIELDS]
    if accent:
        found += [row(c(f).rlike(DEVANAGARI), f, "native_leak") for f in SHOWN_FIELDS] + [row(c(f).rlike(STRAY), f, "non_ascii") for f in SHOWN_FIELDS]
    return items.select("id", F.inline(F.array_compact(F.array(*found))))


def number_globally(rows: DataFrame, key: str, blocks: int = 256) -> DataFrame:
    """rows (key unique, integer) with `nth` from 1 in key order, numbered in ranges of about equal
    numbers of rows, cut at approximate quantiles of the key."""
    cuts = rows.agg(F.percentile_approx(key, [n / blocks for n in range(1, blocks)], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>")
    cut = rows.withColumn("_block", F.size(F.filter(edges, lambda e: e < F.col(key))))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # over at most `blocks` rows
    firsts = cut.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    return cut.withColumn("_in", inside).join(F.broadcast(firsts), "_block").withColumn("nth", F.col("_first") + F.col("_in")).drop("_block", "_first", "_in")


def output_stamp(voice: Column, text: Column) -> Column:
    return F.left(F.sha1(F.concat(voice, F.lit("\u0000"), text).cast("binary")), F.lit(16))


def stale_outputs(wanted: DataFrame, stamps: DataFrame) -> DataFrame:
    """wanted (file, stamp) that has no equal recorded stamp."""
    return wanted.join(stamps, ["file", "stamp"], "left_anti")


def sentence_index(sentences: DataFrame, known: DataFrame, low: int = 3, high: int = 14) -> DataFrame:
    """(token, sentence_id, score): each token's best sentence of low to high tokens; unknown tokens
    cost 4, ties go to the smaller id as text."""
    tokens = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda t: t != "")
    cut = sentences.select("id", tokens.alias("tokens")).filter(F.size("tokens").between(low, high))
    each = cut.select("id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    # A row a token tells whether it is known and how often it occurs; frequent tokens meet it by broadcast.
    own = each.groupBy("token").agg(F.count("*").alias("_rows")).join(known.select("token").distinct().withColumn("_known", F.lit(1)), "token", "left")
    flagged = hot_split_join(each, own, "token", "_rows", each.count())
    score = flagged.groupBy("id").agg((F.first("n") + 4 * F.count_if(F.col("_known").isNull())).alias("score"))
    best = each.select("id", "token").distinct().join(score, "id").groupBy("token").agg(F.min(F.struct("score", F.col("id").cast("string").alias("sid"), "id")).alias("b"))
    return best.select("token", F.col("b.id").alias("sentence_id"), F.col("b.score").cast("long").alias("score"))


def batch_of(position: Column, size: int = BATCH_SIZE) -> Column:
    return F.floor((position - 1) / size).cast("long")


def word_links(items: DataFrame) -> DataFrame:
    """(head, a, b): pairs of different (word, gloss) within a head that are one word, a before b.

    items (head, word, gloss, first), a row each, `first` the place of its earliest record. Only
    words with an equal key or an equal skeleton can be one, so pairs are met by these keys. Keys,
    skeletons and glosses' words are made once a row, not once a pair.
    """
    own = F.struct("first", spelling.spelling_key(F.col("word"), True).alias("dotted"), spelling.gloss_words(F.col("gloss")).alias("words"), spelling.lead_word(F.col("gloss")).alias("lead"))
    blocks = F.array_distinct(F.array(F.concat(F.lit("k"), spelling.spelling_key(F.col("word"))), F.concat(F.lit("s"), spelling.skeleton(F.col("word")))))
    keyed = kept(items.select("head", own.alias("own"), blocks.alias("blocks")), "keyed-words").select("head", "own", F.explode("blocks").alias("block"))
    l, r = keyed.alias("l"), keyed.alias("r")
    a, b = (lambda n: F.col(f"l.own.{n}")), (lambda n: F.col(f"r.own.{n}"))
    agree = (jaccard(a("words"), b("words")) >= spelling.LEAST_OVERLAP) | ((a("lead") != "") & (a("lead") == b("lead")))
    met = l.join(r, (F.col("l.head") == F.col("r.head")) & (F.col("l.block") == F.col("r.block")) & (a("first") < b("first")) & F.coalesce((a("dotted") == b("dotted")) | agree, F.lit(False)))
    return met.select(F.col("l.head").alias("head"), a("first").alias("a"), b("first").alias("b")).distinct()


#: A component with no more links is settled in one call; a larger one round by round.
COMPONENT_LINKS = 100_000


def _settle(links: pd.DataFrame) -> pd.DataFrame:
    """(node, kept) of one component's links, whose ends are numbered in order of place: a node is kept
    unless one before it that it is linked to is."""
    before: dict[int, list[int]] = {}
    for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
        before.setdefault(b, []).append(a)
        before.setdefault(a, [])
    state: dict[int, bool] = {}
    for node in sorted(before):
        state[node] = not any(state[x] for x in before[node])
    return pd.DataFrame({"node": list(state), "kept": list(state.values())})


def settle(links: DataFrame) -> DataFrame:
    """(node, kept) over links (a, b), a before b, of nodes whose numbers are in order of place."""
    root = components(links)
    of = kept(links.join(root.withColumnRenamed("node", "a"), "a"), "links-of-components")
    large = of.groupBy("root").count().filter(F.col("count") > COMPONENT_LINKS).select("root")
    small = of.join(large, "root", "left_anti").groupBy("root").applyInPandas(_settle, "node long, kept boolean")
    rest = kept(of.join(large, "root", "left_semi").select("a", "b"), "large-components")
    if rest.isEmpty():
        return small
    # A node is settled once every one before it that it is linked to is; each round settles at least the first open one.
    state = kept(rest.select(F.col("a").alias("node")).unionByName(rest.select(F.col("b").alias("node"))).distinct().withColumn("kept", F.lit(None).cast("boolean")), "settled")
    while not state.filter("kept is null").isEmpty():
        seen = rest.join(state.withColumnsRenamed({"node": "a", "kept": "was"}), "a").groupBy(F.col("b").alias("node")).agg(F.bool_or(F.coalesce("was", F.lit(False))).alias("one_kept"), F.bool_or(F.col("was").isNull()).alias("open"))
        now = F.when(F.col("one_kept"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = kept(state.join(seen, "node", "left").select("node", F.coalesce("kept", now).alias("kept")), "settled")
    return small.unionByName(state)


def leader_clusters(items: DataFrame) -> DataFrame:
    """(id, leader): in rank order within a head, an item joins the first earlier kept item that is the
    same word; else it is kept. Being one word is not transitive, so order decides.

    items (id, head, rank, word, gloss). Records equal in word and gloss always follow the first of
    them, so only different ones are linked. Whether an item is kept follows from earlier items of its
    own component of links: components are settled each in one call, those of more than COMPONENT_LINKS
    links in as many rounds as their longest chain has links. Null words and heads stand alone.
    """
    place = F.struct("rank", "id")
    first = items.filter("head is not null and word is not null").groupBy("head", "word", F.coalesce("gloss", F.lit("")).alias("gloss")).agg(F.min(place).alias("first"))
    once = kept(first, "words")
    links = kept(word_links(once), "word-links")
    # Ends of links by number, in order of head and place: numbered by range, so no task orders them all.
    ends = links.select("head", F.col("a").alias("at")).unionByName(links.select("head", F.col("b").alias("at"))).distinct()
    parts = kept(ends.repartitionByRange("head", "at").sortWithinPartitions("head", "at").select("*", F.monotonically_increasing_id().alias("node")), "ends")
    by = lambda c: parts.select("head", F.col("at").alias(c), F.col("node").alias(f"n_{c}"))
    numbered = kept(links.join(by("a"), ["head", "a"]).join(by("b"), ["head", "b"]), "numbered-links")
    state = settle(numbered.select(F.col("n_a").alias("a"), F.col("n_b").alias("b")))
    one = state.filter("kept").select(F.col("node").alias("n_a"))
    joined = numbered.join(one, "n_a").groupBy("head", F.col("b").alias("first")).agg(F.min("a").alias("leader"))
    leaders = once.join(joined, ["head", "first"], "left").select("head", "word", "gloss", F.coalesce("leader", "first")["id"].alias("leader"))
    rows = items.select("id", "head", "word", F.coalesce("gloss", F.lit("")).alias("gloss"))
    return rows.join(leaders, ["head", "word", "gloss"], "left").select("id", F.coalesce("leader", "id").alias("leader"))


# Letters, spellings and limits of the lint rules for a romanised script.
DEVANAGARI = r"[ऀ-ॣ॰-ॿ]"
RETROFLEX_LETTERS = "टठडढ"
FINAL_ALLOWED = ["koii", "gaii", "naii", "bhaii", "huii", "laii", "aaii", "kaii", "daii", "maii"]
CANONICAL = {
    "yah": "yeh", "vah": "voh", "hei": "hai", "hain'": "hain", "kya": "kyaa", "kyun": "kyon", "kyu": "kyon", "nahi": "nahin", "nahiin": "nahin", "nahee": "nahin", "acchaa": "achchhaa", "achha": "achchhaa", "acha": "achchhaa",
    "hun": "hoon", "hoo": "hoon", "chahiye": "chaahie", "chaahiye": "chaahie", "kuch": "kuchh", "bohot": "bahut", "bahot": "bahut", "tha": "thaa", "hua": "huaa", "kaha": "kahaan", "yaha": "yahaan", "vaha": "vahaan",
}
ADVISORY = ["length_mismatch", "target_not_marked", "unaligned_sentence"]


def roman_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+)"))


def native_words(text: Column) -> Column:
    """Words at spaces and hyphens that hold a letter of the script."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\u2010-\u2015\-]+"), lambda w: F.rlike(w, F.lit(DEVANAGARI)))


def bad_final_vowel(word: Column) -> Column:
    """A doubled i or u at the end, but after a vowel or in a word known to have it."""
    low = F.lower(word)
    return low.rlike("(ii|uu)$") & ~low.isin(*FINAL_ALLOWED) & ~low.rlike("[aeiou](ii|uu)$")


def native_present(native: Column, sentence: Column) -> Column:
    """Whether a sentence holds a word, or all parts of a pattern in their order with gaps."""
    gapped = F.concat(F.lit(r"(?s)\Q"), F.regexp_replace(F.trim(native), r"\s+", r"\\E.*\\Q"), F.lit(r"\E"))
    return F.contains(sentence, native) | (F.regexp_count(F.trim(native), F.lit(r"\s+")) > 0) & F.rlike(sentence, gapped)


def mark_retroflex(html: Column) -> Column:
    """Capitals that stand for retroflex consonants in a span, in text that is escaped already."""
    return F.regexp_replace(html, "([TDR]h?)", '<span class=rx>$1</span>')


def fixed_text(text: Column) -> Column:
    """Canonical spellings, single final vowels and full stops, in this order."""
    out = text
    for wrong, right in CANONICAL.items():
        out = F.regexp_replace(F.regexp_replace(out, rf"\b{wrong}\b", right), rf"\b{wrong.capitalize()}\b", right)
    allowed = "|".join(FINAL_ALLOWED)
    out = F.regexp_replace(out, rf"(?i)\b(?!(?:{allowed})\b)([a-z]*[b-df-hj-np-tv-z])(i|u)\2\b", "$1$2")
    return F.replace(F.regexp_replace(out, r"(?i)(?<![a-z])(i|u)\1\b", "$1"), F.lit("।"), F.lit("."))


def deck_lint(items: DataFrame) -> DataFrame:
    """(id, rule) of rules over (id, keep, headword, term, gloss, sent_display, sent_native, sent_en).

    Null fields count as empty; a rule gives at most one row a record; rules of sentences speak of kept
    records alone.
    """
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    head, native, shown, said = c("headword"), c("term"), c("sent_display"), c("sent_native")
    shown_fields = [c(n) for n in ("headword", "sent_display", "gloss", "sent_en")]
    any_field = lambda test: F.greatest(*[test(f) for f in shown_fields])
    words = F.concat(roman_words(head), roman_words(shown))
    known = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    kept = F.coalesce(F.col("keep"), F.lit(False))
    a, b = F.size(roman_words(shown)), F.size(native_words(said))
    rules = {
        "native_leak": any_field(lambda f: f.rlike(DEVANAGARI)),
        "spelling_form": F.exists(words, lambda w: F.map_contains_key(known, F.lower(w))),
        "final_vowel": F.exists(words, bad_final_vowel),
        "stray_capital": F.exists(roman_words(shown), lambda w: F.rlike(w, F.lit("^[A-Z]")) & ~F.rlike(w, F.lit("^[TDR]"))),
        "unaligned_sentence": (shown != "") & (said != "") & (a != b),
        "missing_sent_en": kept & (shown != "") & (F.trim(c("sent_en")) == ""),
        "word_not_in_sentence": kept & (said != "") & (native != "") & ~native_present(native, said),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return items.select("id", F.explode(found).alias("rule"))


def kept_items(items: DataFrame) -> DataFrame:
    """Kept records (keep, rank) that have a rank, as they are delivered; order them by rank."""
    return items.filter(F.coalesce(F.col("keep"), F.lit(False))).withColumn("rank", rank_of(F.col("rank"))).filter("rank is not null")


def live_manifest(notes: DataFrame) -> DataFrame:
    """(note_id, n, rank, term) of live notes (note_id, rank_text, audio, term): the position from
    "N of M", the rank from the clip's name; null where they cannot be read."""
    n = F.regexp_extract("rank_text", r"^\s*(\d+)\s*( of |$)", 1).try_cast("int")
    rank = F.regexp_extract("audio", r"_w_r(\d+)(?:\.[^_]*)?$", 1).try_cast("int")
    return notes.select("note_id", n.alias("n"), rank.alias("rank"), "term")


def identity_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(key, state) of stores known by name: changed or vanished against the recorded id, else ok."""
    met = recorded.select("key", F.col("id").alias("_was")).join(current.select("key", F.col("id").alias("_now")), "key", "left")
    return met.select("key", F.when(F.col("_was").isNotNull() & F.col("_now").isNull(), "vanished").when(F.col("_was") != F.col("_now"), "changed").otherwise("ok").alias("state"))


def manifest_notes(text: Column) -> Column:
    """The notes of a manifest, whether it is an object with notes or a bare list of them."""
    note = "array<struct<n: int, rank: int, note_id: bigint, term: string>>"
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, note)).otherwise(F.from_json(text, f"struct<notes: {note}>")["notes"])


def missing_columns(wanted: Column, there: Column) -> Column:
    """Fields that a template names and a model lacks, in the template's order."""
    return F.array_except(wanted, there)


def call_outcome(transport_failed: Column, error: Column, result: Column) -> Column:
    """How a call to the store ended: transport, error, refused (a bare false) or ok."""
    return F.when(transport_failed, "transport").when(error.isNotNull(), "error").when(F.lower(result) == "false", "refused").otherwise("ok")


def next_batch(names: DataFrame, pattern: str) -> DataFrame:
    """One row: the number after the largest of the batches' names (name)."""
    n = F.regexp_extract("name", pattern, 1).try_cast("int")
    return names.agg((F.coalesce(F.max(n), F.lit(-1)) + 1).alias("next"))


def list_drift(saved: DataFrame, current: DataFrame) -> DataFrame:
    """One row (words, moved): the words of the recorded list (word, position from 1), and how many of its
    positions hold another word, or none, in the current one. An empty recorded list has not moved."""
    met = saved.select("position", F.col("word").alias("_was")).join(current.select("position", F.col("word").alias("_now")), "position", "left")
    return met.agg(F.count("*").alias("words"), F.count_if(~F.col("_was").eqNullSafe(F.col("_now"))).alias("moved"))


def extended_list(saved: DataFrame, current: DataFrame, count: int, first_batch: int = 0, size: int = BATCH_SIZE) -> DataFrame:
    """(word, rank, batch): what the current list (word, position; positions unique) adds to the recorded one.

    Of the `count` positions behind the recorded list's length, words that are not recorded, in order;
    ranks go on from that length without gaps, so recorded ranks stay as they are even where the list has
    drifted. Batches of `size` are numbered from first_batch (see next_batch). Null words are left out; a
    word that repeats in the current list is taken each time. The recorded list renewed is saved with these.
    """
    start = saved.count()
    behind = current.filter(F.col("word").isNotNull() & F.col("position").between(start + 1, start + count))
    new = number_globally(behind.join(saved.select("word"), "word", "left_anti"), "position")
    return new.select("word", (F.col("nth") + start).alias("rank"), (F.floor((F.col("nth") - 1) / size) + first_batch).cast("long").alias("batch"))


def homographs(items: DataFrame) -> DataFrame:
    """(head, items, hints): heads of several items and how many different hints tell them apart."""
    return items.groupBy("head").agg(F.count("*").alias("items"), F.countDistinct("hint").alias("hints")).filter("items > 1")


def changed_fields(live: DataFrame, desired: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) where the wanted value differs from the live one, nulls included."""
    met = live.alias("l").join(desired.alias("d"), key)
    found = F.array_compact(F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"d.{f}")), F.lit(f)) for f in fields]))
    return met.select(key, F.explode(found).alias("field"))
