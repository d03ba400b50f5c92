"""Whether two spellings are one word: spelling keys, consonant skeletons, agreement of glosses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import jaccard, nfc

# Devanagari signs and letter classes, words without meaning in a gloss, least likeness.
NUKTA, ANUSVARA, CANDRABINDU, VISARGA, VIRAMA = "़", "ं", "ँ", "ः", "्"
VOWEL_SIGNS = "ािीुूृॄॅॆेैॉॊोौ"
NASAL_BEFORE_STOP = r"[ङञणनम]्(?=[क-म])"
GLIDE_AFTER_LETTER = r"(?<=[" + VOWEL_SIGNS + r"अ-औक-ह])ये"
GLOSS_STOP_WORDS = r"\b(to|a|an|the|of|is|be|are|was|were|am|been)\b"
LEAST_OVERLAP = 0.3


def spelling_key(word: Column, keep_dot: bool = False) -> Column:
    """Spellings of one sound share a key; `keep_dot` keeps the nukta, which may tell words apart."""
    s = F.translate(nfc(word), CANDRABINDU + VISARGA, ANUSVARA)
    if not keep_dot:
        s = F.replace(s, F.lit(NUKTA), F.lit(""))
    return F.regexp_replace(F.regexp_replace(s, NASAL_BEFORE_STOP, ANUSVARA), GLIDE_AFTER_LETTER, "ए")


def skeleton(word: Column) -> Column:
    """Consonants and independent vowels only."""
    return F.translate(nfc(word), NUKTA + VOWEL_SIGNS + ANUSVARA + CANDRABINDU + VISARGA + VIRAMA, "")


def gloss_words(gloss: Column) -> Column:
    """Distinct meaningful words in order; brackets, stop words and single letters go."""
    plain = F.regexp_replace(F.lower(F.coalesce(gloss, F.lit(""))), r"\(.*?\)", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, GLOSS_STOP_WORDS, " "), r"[^a-z ]", " ")
    return F.array_distinct(F.filter(F.split(plain, " +"), lambda w: F.length(w) > 1))


def lead_word(gloss: Column) -> Column:
    """The first meaningful word of the first clause, else empty."""
    return F.coalesce(F.try_element_at(gloss_words(F.split(gloss, "[;,]")[0]), F.lit(1)), F.lit(""))


def same_word(word_a: Column, gloss_a: Column, word_b: Column, gloss_b: Column) -> Column:
    """Equal keys with the dot; or equal keys without it, or equal skeletons, and glosses that agree."""
    agree = (jaccard(gloss_words(gloss_a), gloss_words(gloss_b)) >= LEAST_OVERLAP) | ((lead_word(gloss_a) != "") & (lead_word(gloss_a) == lead_word(gloss_b)))
    alike = (spelling_key(word_a) == spelling_key(word_b)) | (skeleton(word_a) == skeleton(word_b))
    return F.coalesce((spelling_key(word_a, True) == spelling_key(word_b, True)) | (alike & agree), F.lit(False))
