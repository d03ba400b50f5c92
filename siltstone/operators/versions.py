"""Versions, releases and outcome typing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a version tag, its numbers and its prerelease.
TAG = r"^\s*[vV]?(\d+(?:\.\d+)*)(?:-(.*\S))?\s*$"


def version_numbers(tag: Column) -> Column:
    """The numbers of a tag as bigints; null for what is no version."""
    return F.when(tag.rlike(TAG), F.transform(F.split(F.regexp_extract(tag, TAG, 1), r"\."), lambda x: x.try_cast("long")))


def prerelease(tag: Column) -> Column:
    return F.when(tag.rlike(TAG), F.nullif(F.regexp_extract(tag, TAG, 2), F.lit("")))


def is_newer(remote: Column, current: Column) -> Column:
    """Numbers decide, missing ones being 0; at equal numbers a release is newer than a prerelease,
    and nothing else is; what is no version is never newer."""
    a, b = version_numbers(remote), version_numbers(current)
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(n - F.size(x), F.lit(0))))
    newer = F.when(pad(a) == pad(b), prerelease(remote).isNull() & prerelease(current).isNotNull()).otherwise(pad(a) > pad(b))
    return F.when(a.isNull() | b.isNull(), F.lit(False)).otherwise(newer)


def match_asset(names: Column, arch: str, suffix: str) -> Column:
    """The first asset of the exact architecture, else a universal one, else null."""
    exact = F.filter(names, lambda n: F.contains(n, F.lit(f"-{arch}{suffix}")))
    universal = F.filter(names, lambda n: F.contains(n, F.lit(f"-universal{suffix}")))
    return F.coalesce(F.get(exact, 0), F.get(universal, 0))


def fetch_outcome(status: Column, etag_hit: Column, retry_after: Column, reset_at: Column, now: Column) -> Column:
    """struct(kind, retry_seconds): how a release request ended."""
    wait = F.greatest(F.lit(0).cast("long"), F.coalesce(retry_after.cast("long"), (reset_at - now).cast("long"), F.lit(0).cast("long")))
    kind = F.when(status == 304, F.when(etag_hit, "cached").otherwise("error")).when(status == 200, "fresh").when(status == 404, "none").when(status.isin(403, 429), "limited").otherwise("error")
    return F.struct(kind.alias("kind"), F.when(kind == "limited", wait).alias("retry_seconds"))


# Hosts that an update may come from, and the age of a leftover.
DOWNLOAD_HOSTS = ["api.github.com", "github.com", "objects.githubusercontent.com"]
DOWNLOAD_DOMAIN = ".githubusercontent.com"
STALE_SECONDS = 86_400


def update_status(kind: Column, remote: Column, current: Column, asset: Column) -> Column:
    """struct(status, reason) of an update check from how the request ended (fetch_outcome's kinds):
    offline, no-releases, rate-limited and error as they are, else by versions; an update without a
    build for this machine says so."""
    newer = is_newer(remote, current)
    status = F.when(kind == "none", "no-releases").when(kind == "limited", "rate-limited").when(kind == "offline", "offline").when(kind == "error", "error").when(newer, "available").otherwise("up-to-date")
    return F.struct(status.alias("status"), F.when((status == "available") & asset.isNull(), "no-asset-for-arch").alias("reason"))


def allowed_download(url: Column, override_host: str | None = None) -> Column:
    """Whether a url may be fetched: https from a known host, or the override's very host and port."""
    host, authority = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    known = (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & (host.isin(*DOWNLOAD_HOSTS) | host.endswith(DOWNLOAD_DOMAIN))
    return F.coalesce(known | (F.lit(False) if override_host is None else authority == override_host), F.lit(False))


def stale_leftover(name: Column, age_seconds: Column, prefix: str, live: Column | None = None) -> Column:
    """Whether a temporary file is left over: ours by prefix, not the one in use, and cut short or a day old."""
    in_use = F.lit(False) if live is None else F.coalesce(live.startswith(name), F.lit(False))
    return name.startswith(prefix + "-") & ~in_use & (name.endswith(".part") | (age_seconds > STALE_SECONDS))


def digest_of(line: Column) -> Column:
    """The first word of a checksum line if it is a SHA-256, lower case."""
    first = F.lower(F.split(F.trim(line), r"\s+")[0])
    return F.when(first.rlike("^[0-9a-f]{64}$"), first)


def version_lines(text: Column, version: str) -> Column:
    """Lines that hold the version and not a longer one."""
    bound = r"(^|[^0-9.])" + version.replace(".", r"\.") + r"([^0-9]|$)"
    return F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(bound)))


# Files whose versions are history or made by tools.
HISTORY = r"(?i)(^|/)(changelog|release[_-]?notes)[^/]*$"
LOCKS = r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|yarn\.lock|Cargo\.lock|poetry\.lock|uv\.lock|Pipfile\.lock|Gemfile\.lock|composer\.lock|go\.sum)$"
COMMENTED = r"^\s*(#|//|/\*|\*|<!--|;|--)"


def version_hits(files: DataFrame, version: str) -> DataFrame:
    """(path, line) of files (path, text) that a release of `version` has to change: lines that hold it,
    but for changelogs, lock files and comments."""
    kept = files.filter(~F.col("path").rlike(HISTORY) & ~F.col("path").rlike(LOCKS))
    return kept.select("path", F.explode(version_lines(F.col("text"), version)).alias("line")).filter(~F.col("line").rlike(COMMENTED))


# Types of projects in the order in which they are tried, each with its signals as a
# condition over what a repository's files show (see project_types).
PROJECT_TYPES = [
    ("electron app", "electron and (builder_file or builder_key)"),
    ("npm library", "named and not electron and not private"),
    ("swift app", "xcodegen"),
    ("xcode app", "xcodeproj and not xcodegen"),
    (".net app", "csproj"),
    ("c++ cmake", "cmake"),
    ("c++ qt", "qmake"),
    ("python library", "project_table"),
    ("python app", "requirements and entry_point and not project_table"),
    ("rust", "crate"),
    ("go", "go_module"),
    ("docker server", "dockerfile and compose and not manifest"),
    ("browser extension", "extension"),
    ("monorepo", "below > 1"),
    ("subdir app", "below = 1"),
]
_MANIFESTS = r"(package\.json|pyproject\.toml|Cargo\.toml|go\.mod|CMakeLists\.txt|project\.yml)"


def project_types(files: DataFrame) -> DataFrame:
    """(repo, type, flavour) of files (repo, path, text): the first type whose signals a repository shows,
    else source-only; flavour is the lock file's tool of a JavaScript project.

    Signals are flags that add up on the map side, so a repository of any size is one row early.
    Whether a repository pushes without releases is not in its files and not judged.
    """
    at = lambda pattern: F.col("path").rlike(pattern)
    holds = lambda path, pattern: (F.col("path") == path) & F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    flags = {
        "electron": holds("package.json", r'"electron"\s*:'),
        "builder_file": at(r"^electron-builder\.ya?ml$"),
        "builder_key": holds("package.json", r'"build"\s*:\s*\{'),
        "named": holds("package.json", r'(?s)(?=.*"name"\s*:)(?=.*"version"\s*:)'),
        "private": holds("package.json", r'"private"\s*:\s*true'),
        "xcodegen": at(r"^project\.yml$"),
        "xcodeproj": at(r"^[^/]+\.xcodeproj(/|$)"),
        "csproj": at(r"\.csproj$"),
        "cmake": at(r"^CMakeLists\.txt$"),
        "qmake": at(r"^[^/]+\.pro$"),
        "project_table": holds("pyproject.toml", r"(?m)^\[project\]"),
        "requirements": at(r"^requirements\.txt$"),
        "entry_point": at(r"^(app|main|server|run|manage|wsgi|__main__)\.py$"),
        "crate": holds("Cargo.toml", r"(?m)^\[package\]"),
        "go_module": at(r"^go\.mod$"),
        "dockerfile": at(r"^Dockerfile$"),
        "compose": at(r"^docker-compose\.ya?ml$"),
        "manifest": at(rf"^{_MANIFESTS}$"),
        "extension": holds("manifest.json", r'"manifest_version"\s*:'),
        "pnpm": at(r"^pnpm-lock\.yaml$"),
        "yarn": at(r"^yarn\.lock$"),
    }
    inner = F.when(at(rf"^[^/]+/(.+/)?{_MANIFESTS}$"), F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    facts = files.groupBy("repo").agg(*[F.coalesce(F.bool_or(test), F.lit(False)).alias(name) for name, test in flags.items()], F.count_distinct(inner).alias("below"))
    kind = F.lit("source-only")
    for name, test in reversed(PROJECT_TYPES):
        kind = F.when(F.expr(test), name).otherwise(kind)
    flavour = F.when(F.col("named") | F.col("electron"), F.when(F.col("pnpm"), "pnpm").when(F.col("yarn"), "yarn").otherwise("npm"))
    return facts.select("repo", kind.alias("type"), flavour.alias("flavour"))
