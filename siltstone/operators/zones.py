"""Protected zones of a tree, cache folders, one class a file, idle caches.

Folders are paths. What a folder is follows from the names of its files and child folders, which are
combined per folder on the map side; a zone is inherited from the shallowest folder that is one.

Defined cases: null names and folders are left out of the facts; repeated rows change nothing but the
count of weak markers; an empty table gives no rows; a file whose folder is unknown is unprotected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import extension, extension_multi, plausible_year
from siltstone.operators import classify, photos, sensitive, tree
from siltstone.sources.scratch import kept

# Names of files and folders by which projects, repositories and stores are known.
VCS_DIRS = [".git", ".hg", ".svn", ".bzr", ".jj", "_darcs", ".fossil"]
VCS_FILES = [".git", "_fossil_", ".fslckout"]
STRONG_MANIFESTS = [
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "pyproject.toml", "setup.py", "setup.cfg", "pipfile", "poetry.lock", "uv.lock", "cargo.toml", "go.mod", "cmakelists.txt", "configure.ac",
    "configure.in", "meson.build", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradlew", "mix.exs", "composer.json", "gemfile", "rakefile", "package.swift",
    "pubspec.yaml", "deno.json", "deno.jsonc", "stack.yaml", "project.toml", "rebar.config", "build.sbt", "flake.nix", ".projectile",
]
STRONG_ENDINGS = [".sln", ".csproj", ".fsproj", ".vbproj", ".cabal"]
STRONG_DIR_ENDINGS = [".xcodeproj", ".xcworkspace", ".playground"]
WEAK_MARKERS = ["makefile", "gnumakefile", "requirements.txt", "environment.yml", "dockerfile", "docker-compose.yml", "tsconfig.json", ".editorconfig"]
WEAK_DIRS = [".idea", ".vscode"]
CODE_ENDINGS = [
    ".py", ".js", ".ts", ".tsx", ".jsx", ".c", ".h", ".cpp", ".cc", ".hpp", ".m", ".mm", ".swift", ".java", ".kt", ".go", ".rs", ".rb", ".php", ".cs", ".sh", ".pl", ".lua", ".scala", ".hs",
    ".ex", ".exs", ".clj", ".ml", ".r", ".jl", ".dart", ".vue", ".svelte", ".sql",
]
LIBRARY_ENDINGS = [".photoslibrary", ".migratedphotolibrary", ".aplibrary", ".iphotolibrary", ".musiclibrary", ".tvlibrary", ".imovielibrary", ".theater", ".fcpbundle", ".fcpevent", ".logicx", ".band"]
VM_ENDINGS = [".sparsebundle", ".vmwarevm", ".pvm", ".utm"]
BUNDLE_ENDINGS = [
    ".app", ".framework", ".bundle", ".plugin", ".appex", ".xpc", ".kext", ".systemextension", ".dext", ".qlgenerator", ".mdimporter", ".prefpane", ".saver", ".wdgt", ".component", ".vst", ".vst3", ".aaxplugin",
    ".docset", ".lproj", ".nib", ".storyboardc", ".scptd", ".workflow", ".action", ".caction", ".definition", ".osax", ".pkg", ".mpkg", ".xctest", ".swiftpm", ".appiconset", ".xcassets", ".dst", ".cst",
    ".pages", ".key", ".numbers", ".rtfd", ".graffle", ".sketch", ".scriv", ".bbprojectd", ".oo3", ".ofocus", ".dtbase2", ".journal", ".textbundle", ".abbu", ".mbox", ".help", ".bentodb", ".quiver", ".qvnotebook",
]
DATABASE_FILES = ["pg_version", "ibdata1", "wiredtiger", "wiredtiger.wt", "storage.bson", "metadata.db"]
PHONE_BACKUP_FILES = ["manifest.plist", "manifest.db"]
CARD_FILES = ["collection.anki2", "prefs21.db"]
CATALOG_ENDINGS = [".lrcat", ".cosessiondb", ".cocatalogdb"]
CACHE_DIRS = ["__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".sass-cache", ".cache", ".parcel-cache", ".turbo", "deriveddata", ".thumbnails"]
REBUILDABLE_OF_PROJECT = ["node_modules", "pods"]
REBUILDABLE = ["bower_components", ".next", ".nuxt"]
VENV_DIRS = ["venv", ".venv", "env", "virtualenv"]
CODE_ZONES = ["git", "project"]
DORMANT = 540 * 86_400


def _ends(name: Column, endings: list[str]) -> Column:
    return name.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def own_name(folder: Column) -> Column:
    return F.lower(F.element_at(F.split(folder, "/"), -1))


def folder_facts(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """dirs (dir) with what their files' and child folders' names say, and the number of files."""
    low = F.lower("name")
    fact = (
        F.when(low.isin(*STRONG_MANIFESTS) | _ends(low, STRONG_ENDINGS), "strong")
        .when(low.isin(*WEAK_MARKERS), "weak")
        .when(low.isin(*VCS_FILES), "vcs")
        .when(low.isin(*DATABASE_FILES), "db")
        .when(low.isin(*PHONE_BACKUP_FILES), "phone")
        .when(low.isin(*CARD_FILES), "appdata")
        .when(low == "info.plist", "plist")
        .when(low == "cachedir.tag", "cachedir")
        .when(low == "current", "log_current")
        .when(low.startswith("manifest-"), "log_manifest")
        .when(_ends(low, CATALOG_ENDINGS), "appdata")
        .when(low == "pyvenv.cfg", "venv")
        .when(low.endswith(".vbox"), "vm")
    )
    code = extension_multi(low).isin(*CODE_ENDINGS)
    named = files.filter(F.col("name").isNotNull()).select("dir", fact.alias("fact"), code.alias("code"))
    flags = ["strong", "vcs", "db", "phone", "appdata", "plist", "cachedir", "log_current", "log_manifest", "venv", "vm"]
    own = named.groupBy("dir").agg(F.count("*").alias("files"), F.count_if(F.col("fact") == "weak").alias("weak"), F.coalesce(F.bool_or("code"), F.lit(False)).alias("code"), *[F.coalesce(F.bool_or(F.col("fact") == f), F.lit(False)).alias(f) for f in flags])
    child = own_name(F.col("dir"))
    any_of = lambda test, name: F.bool_or(test).alias(name)
    below = dirs.select(tree.parent(F.col("dir")).alias("up"), child.alias("c")).filter("up is not null").groupBy(F.col("up").alias("dir")).agg(
        any_of(F.col("c").isin(*VCS_DIRS), "vcs_dir"), any_of(_ends(F.col("c"), STRONG_DIR_ENDINGS), "strong_dir"), any_of(F.col("c").isin(*WEAK_DIRS), "weak_dir"), any_of(F.col("c") == "ableton project info", "music_dir"),
        any_of(F.col("c") == "bands", "bands"), any_of(F.col("c") == "steamapps", "steam"), any_of(F.col("c") == "application support", "support"), any_of(F.col("c") == "preferences", "preferences"),
    )
    met = dirs.join(own, "dir", "left").join(below, "dir", "left")
    return met.na.fill(0, ["files", "weak"]).na.fill(False)


def zone_kind(folder: Column) -> Column:
    """A folder's own kind by its name and facts (columns of folder_facts): what it is called first,
    then repositories, projects, and stores known by their shape."""
    low, c = own_name(folder), F.col
    project = c("strong") | (c("weak") >= 2) | ((c("weak") >= 1) & c("code")) | c("strong_dir") | (c("weak_dir") & c("code")) | c("music_dir")
    return (
        F.when(_ends(low, LIBRARY_ENDINGS), "library")
        .when(_ends(low, VM_ENDINGS), "vm")
        .when(_ends(low, BUNDLE_ENDINGS), "bundle")
        .when(c("vcs_dir") | c("vcs") | low.endswith(".git"), "git")
        .when(project, "project")
        .when((c("plist") & c("bands")) | c("vm"), "vm")
        .when(c("db") | (c("log_current") & c("log_manifest")), "db")
        .when(c("phone") & c("plist"), "iosbackup")
        .when(c("appdata"), "appdata")
        .when(c("steam"), "steam")
        .when((low == "library") & c("support") & c("preferences"), "homebackup")
    )


def folder_zones(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, zone, prot): zone is what the folder itself is, a protected kind or a cache that lies in or
    outside one; prot is the folder that protects it, the topmost that is a zone, itself for a cache
    that nothing else protects. Caches protect only the files directly in them."""
    facts = kept(folder_facts(dirs.select("dir").distinct(), files), "facts")
    kinds = kept(facts.select("dir", zone_kind(F.col("dir")).alias("kind")), "kinds")
    found = tree.zones(kinds, F.col("kind"))
    strong = facts.filter("strong").select(F.col("dir").alias("up"), F.lit(True).alias("in_project"))
    low = own_name(F.col("dir"))
    rows = found.join(facts.select("dir", "cachedir", "venv"), "dir").withColumn("up", tree.parent(F.col("dir"))).join(strong, "up", "left")
    cache = (
        F.when(low.isin(*CACHE_DIRS) | F.col("cachedir"), "cache")
        .when(low.isin(*REBUILDABLE), "rebuildable")
        .when(low.isin(*REBUILDABLE_OF_PROJECT), F.when(F.col("in_project"), "rebuildable"))
        .when(low.isin(*VENV_DIRS) & F.col("venv"), "rebuildable")
        .when(low == "__macosx", "cache")
    )
    is_root = F.coalesce(F.col("zone_root") == F.col("dir"), F.lit(False))
    zone = F.when(is_root, F.col("kind")).otherwise(cache)
    return rows.select("dir", zone.alias("zone"), F.coalesce("zone_root", F.when(cache.isNotNull(), F.col("dir"))).alias("prot"))


def empty_folders(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """The folders of dirs (dir, status) whose whole subtree has no file, no zone and was walked to its end."""
    # Written, as are all facts below: the optimizer would carry the long conditions on.
    kinds = kept(folder_facts(dirs.select("dir").distinct(), files).select("dir", zone_kind(F.col("dir")).alias("kind")), "kinds")
    found = tree.zones(kinds, F.col("kind")).filter("zone_root is not null").select("dir")
    full = files.select("dir").unionByName(found).unionByName(dirs.filter("status is null or status <> 'done'").select("dir")).distinct()
    held = full.select(F.explode(F.concat(tree.ancestors(F.col("dir")), F.array("dir"))).alias("dir")).distinct()
    return dirs.select("dir").distinct().join(held, "dir", "left_anti")


def file_classes(files: DataFrame, dirs: DataFrame, now: int, folders: DataFrame | None = None, apps: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """files (id, dir, name, size, mtime, hash[, link, dataless]) with `cls`, `zone` and `prot`.

    A sensitive file is that whatever else it is; a protected one is nothing else; then junk, then
    photos. A duplicate-looking name without a proven twin is no junk where it is a photo.
    """
    zones = kept(folder_zones(dirs, files), "zones")
    kinds = zones.select(F.col("dir").alias("prot"), F.col("zone").alias("kind"))
    of_dir = zones.select("dir", "prot").filter("prot is not null").join(kinds, "prot", "left")
    rows = files.join(of_dir, "dir", "left")
    judged = sensitive.classify_sensitive(rows, F.col("kind").isin(*CODE_ZONES))
    judged = kept(classify.classify_junk(judged, F.lit(now), folders, apps, raw="junk_code"), "judged")
    judged = photos.classify_photos(judged, F.lit(now), root, F.col("dataless") if "dataless" in files.columns else None)
    year = plausible_year(F.col("mtime"), F.lit(now))
    photo = F.when(F.col("photo").startswith("j"), F.concat(F.lit("j"), classify.demote(F.substring("photo", 2, 1), year), F.lit(":"), F.split("photo", ":")[1])).otherwise(F.col("photo"))
    is_photo = F.col("photo").startswith("ph:") & (F.col("photo") != "ph:asset")
    junk = F.when((F.col("junk_code") == "C:J8") & is_photo, None).otherwise(F.concat(F.lit("j"), "tier", F.lit(":"), "family"))
    cls = F.when(F.col("sensitive").isNotNull(), F.col("sensitive")).when(F.col("prot").isNotNull(), None).otherwise(F.coalesce(junk, photo))
    return kept(judged.select(*files.columns, cls.alias("cls"), F.col("kind").alias("zone"), "prot"), "classes")


def newest_outside(caches: DataFrame, zones: DataFrame, files: DataFrame) -> DataFrame:
    """caches (dir, prot) with `newest`: the last change of a file of its project, or directly beside it,
    that does not lie below the cache.

    The newest folder of a project decides for every cache that it is not below; only caches that hold
    it, a chain of ancestors, look at the project's other folders.
    """
    direct = files.groupBy("dir").agg(F.max("mtime").alias("m"))
    of_prot = zones.filter("prot is not null").select("dir", "prot").join(direct, "dir").filter("m is not null")
    first = of_prot.groupBy("prot").agg(F.max(F.struct("m", "dir")).alias("top"))
    under = lambda d, c: (d == c) | d.startswith(F.concat(c, F.lit("/")))
    met = caches.join(first, "prot", "left").withColumn("holds", F.coalesce(under(F.col("top.dir"), F.col("dir")), F.lit(False)))
    plain = met.filter("not holds").select("dir", "prot", F.col("top.m").alias("n1"))
    others = of_prot.withColumnRenamed("dir", "d")
    holding = met.filter("holds").select("dir", "prot")
    rest = holding.join(others, "prot").filter(~under(F.col("d"), F.col("dir"))).groupBy("dir").agg(F.max("m").alias("n1"))
    both = plain.unionByName(holding.join(rest, "dir", "left"))
    beside = direct.select(F.col("dir").alias("up"), F.col("m").alias("n2"))
    return both.withColumn("up", tree.parent(F.col("dir"))).join(beside, "up", "left").select("dir", "prot", F.greatest("n1", "n2").alias("newest"))


def dormant_caches(zones: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """(dir, kind, size, newest) of caches whose project was not touched for DORMANT seconds. size is
    that of the whole subtree, each hard-linked file once (files: dir, size, mtime, hl_first)."""
    caches = zones.filter(F.col("zone").isin("cache", "rebuildable") & F.col("prot").isNotNull() & F.col("dir").contains("/"))
    idle = newest_outside(caches.select("dir", "prot"), zones, files).filter(F.lit(now) - F.col("newest") >= DORMANT)
    sizes = files.filter("hl_first = 1").groupBy("dir").agg(F.sum("size").alias("b"))
    held = sizes.select("b", F.explode(F.concat(tree.ancestors(F.col("dir")), F.array("dir"))).alias("dir")).groupBy("dir").agg(F.sum("b").alias("size"))
    return idle.join(caches.select("dir", F.col("zone").alias("kind")), "dir").join(held, "dir", "left").select("dir", "kind", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "newest")


def zone_sizes(zones: DataFrame, files: DataFrame, kinds: list[str], most: int) -> DataFrame:
    """(path, kind, bytes, files): the largest zones of some kinds with their subtree's bytes and the
    files directly in them."""
    own = zones.filter(F.col("zone").isin(*kinds)).select("dir", F.col("zone").alias("kind"))
    direct = files.groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("b"))
    whole = direct.select("b", F.explode(F.concat(tree.ancestors(F.col("dir")), F.array("dir"))).alias("dir")).groupBy("dir").agg(F.sum("b").alias("bytes"))
    met = own.join(whole, "dir", "left").join(direct.select("dir", "files"), "dir", "left")
    return met.select(F.col("dir").alias("path"), "kind", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("files", F.lit(0)).alias("files")).orderBy(F.desc("bytes"), "path").limit(most)
