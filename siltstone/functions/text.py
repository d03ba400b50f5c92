"""Column functions over names, paths and short texts. All stay in the JVM unless they say otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# First characters that a spreadsheet would run as a formula, and the guard put before them.
FORMULA_STARTS = ["=", "+", "-", "@", "\t", "\r"]
FORMULA_GUARD = "'"
# Double extensions that count as one.
DOUBLE_EXTENSIONS = [".tar.gz", ".tar.bz2", ".tar.xz"]
# A copy's mark, " (n)" or " copy n", before at most two extensions.
COPY_PATTERN = r"^(.*?)(?: \((\d+)\)| copy(?: (\d+))?)((?:\.[^.]+){0,2})$"


def extension(name: Column) -> Column:
    """From the last dot, lower case; none for names whose only dot comes first."""
    return F.when(F.locate(".", name, 2) > 0, F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))).otherwise(F.lit(""))


def extension_multi(name: Column) -> Column:
    out = extension(name)
    for e in DOUBLE_EXTENSIONS:
        out = F.when(F.lower(name).endswith(e) & (F.length(name) > len(e)), F.lit(e)).otherwise(out)
    return out


def strip_copy(name: Column) -> Column:
    """The name without its copy mark."""
    return F.when(name.rlike(COPY_PATTERN), F.concat(F.regexp_extract(name, COPY_PATTERN, 1), F.regexp_extract(name, COPY_PATTERN, 4))).otherwise(name)


def copy_number(name: Column) -> Column:
    """0 for an original, n for " (n)" or " copy n", 1 for " copy"."""
    n = F.coalesce(F.nullif(F.regexp_extract(name, COPY_PATTERN, 2), F.lit("")), F.nullif(F.regexp_extract(name, COPY_PATTERN, 3), F.lit("")), F.lit("1"))
    return F.when(name.rlike(COPY_PATTERN), F.coalesce(n.try_cast("int"), F.lit(2147483647))).otherwise(F.lit(0))


def csv_safe(s: Column) -> Column:
    """A guard before formulas, and before the guard itself so that csv_unsafe undoes it exactly."""
    return F.when(F.substring(s, 1, 1).isin(*FORMULA_STARTS, FORMULA_GUARD), F.concat(F.lit(FORMULA_GUARD), s)).otherwise(s)


def csv_unsafe(s: Column) -> Column:
    return F.when((F.substring(s, 1, 1) == FORMULA_GUARD) & F.substring(s, 2, 1).isin(*FORMULA_STARTS, FORMULA_GUARD), F.substring(s, 2, 2**31 - 1)).otherwise(s)


def neutral(s: Column) -> Column:
    return F.regexp_replace(s, r"[\x00-\x1f\x7f]", "?")


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / F.lit(float(1024**power)))).otherwise(out)
    return out


def html_escape(s: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(plain), F.lit(safe))
    return s


def first_text(*candidates: Column) -> Column:
    """The first candidate with a visible character, untrimmed; a blank one only if none has."""
    out = F.coalesce(*candidates)
    for c in reversed(candidates):
        out = F.when(c.rlike(r"\S"), c).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


# Years that clocks fall back to.
CLOCK_YEARS = [1904, 1970, 1980]


def plausible_year(seconds: Column, now: Column) -> Column:
    """UTC year of an epoch time; null where it is a clock default or over a year ahead of now."""
    y = F.year(F.timestamp_seconds(seconds))
    return F.when((seconds > 0) & (seconds <= now + 365 * 86400) & ~y.isin(*CLOCK_YEARS), y)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def nfc(s: Column) -> Column:
    """NFC; only text beyond ASCII leaves the JVM."""
    return F.when(s.rlike(r"[^\x00-\x7F]"), _nfc(F.when(s.rlike(r"[^\x00-\x7F]"), s))).otherwise(s)


def fold(s: Column) -> Column:
    """Accents off; only text beyond ASCII leaves the JVM."""
    return F.when(s.rlike(r"[^\x00-\x7F]"), _fold(F.when(s.rlike(r"[^\x00-\x7F]"), s))).otherwise(s)
