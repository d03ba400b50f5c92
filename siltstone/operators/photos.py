"""Personal captures against screenshots, received media and assets, by name, size and folder alone.

One CASE chain for all rows; only sidecars, which are few, are joined with their folder's captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import CLOCK_YEARS, extension

# Extensions of images, videos, raw captures, sidecars and of what is never a capture.
IMAGES = [".jpg", ".jpeg", ".png", ".heic", ".heif", ".gif", ".tif", ".tiff", ".avif", ".jxl"]
VIDEOS = [".mov", ".mp4", ".m4v", ".avi", ".3gp", ".mts", ".m2ts", ".mkv", ".webm", ".wmv", ".mpg", ".mpeg", ".insv", ".360"]
RAWS = [".cr2", ".cr3", ".crw", ".nef", ".nrw", ".arw", ".srf", ".orf", ".rw2", ".raf", ".pef", ".dng", ".srw", ".x3f", ".3fr", ".rwl"]
NEVER = [".ico", ".icns", ".svg", ".xcf", ".psd", ".webp", ".bmp"]
SIDECARS = [".aae", ".xmp", ".thm", ".lrv"]
# Name patterns.
CAMERA_NAMES = [
    r"^IMG_\d{4}$", r"^IMG_E\d{4}$", r"^_MG_\d{4}$", r"^DSC\d{5}$", r"^DSC_\d{4}$", r"^_DSC\d{4}$", r"^DSCN\d{4}$", r"^DSCF\d{4}$",
    r"^CIMG\d{4}$", r"^SANY\d{4}$", r"^IMAG\d{4}$", r"^P\d{7}$", r"^SAM_\d{4}$", r"^KIF_\d{4}$", r"^PICT\d{4}$", r"^MVC-?\d{3,5}$",
    r"^1\d{2}_\d{4}$", r"^PXL_\d{8}_\d{9}.*$", r"^IMG_\d{8}_\d{6}.*$", r"^VID_\d{8}_\d{6}.*$", r"^MVI_\d{4}$", r"^MOV\d{3,5}$",
    r"^MAH\d{5}$", r"^MAK\d{5}$", r"^GOPR\d{4}$", r"^GP\d{6}$", r"^G[HXS]\d{6}$", r"^DJI_\d{4}(_\d{2})?$", r"^DJI_\d{8}_\d{6}_\d+.*$",
]
DATED_CAMERA = r"^(\d{4})(\d{2})(\d{2})_\d{6}$"
UPLOADED = r"^(\d{4})-(\d{2})-(\d{2}) \d{2}\.\d{2}\.\d{2}(-\d+| \d+)?$"
POSSIBLE_NAMES = [r"^Photo \d{4}-\d{2}-\d{2}.*$", r"^Scan ?\d+.*$", r"^scan\d+$", r"^IMG_\d{4} \(\d+\)$"]
SCREENSHOTS = [
    r"^Screen ?Shot \d{4}-\d{2}-\d{2} at \d{1,2}\.\d{2}\.\d{2}( [AP]M)?$",
    r"^Screenshot \d{4}-\d{2}-\d{2} at .*$",
    r"^Screenshot_\d{8}[-_]\d{6}.*$",
    r"^Screenshot_\d{4}-\d{2}-\d{2}.*$",
    r"^Screenshot \(\d+\)$",
    r"^Annotation \d{4}-\d{2}-\d{2} \d{6}.*$",
    r"^Screen Recording \d{4}-\d{2}-\d{2}.*$",
]
RECEIVED = [
    r"^(IMG|VID|AUD|PTT)-\d{8}-WA\d{4}.*$",
    r"^WhatsApp (Image|Video|Audio) \d{4}-\d{2}-\d{2} at .*$",
    r"^FB_IMG_\d{13,}$",
    r"^photo_\d+@\d{2}-\d{2}-\d{4}.*$",
    r"^signal-\d{4}-\d{2}-\d{2}-\d{6}.*$",
    r"^Snapchat-\d+$",
    r"^received_\d+$",
]
FROM_THE_WEB = [
    r"^(download|image|images|unnamed|untitled|photo)( ?\(\d+\))?$",
    r"^[0-9a-f]{32}$",
    r"^[0-9a-f]{40}$",
    r"^[0-9a-f]{64}$",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^\d{9,}$",
    r"^photo-\d{13}-[0-9a-f]{12}$",
    r"^pexels-photo-\d+.*$",
    r"^istockphoto-\d+-\d+x\d+$",
    r"^shutterstock_\d+$",
    r"^gettyimages-\d+.*$",
    r"^adobestock_\d+$",
]
ICONS = r"^favicon|^sprite|^glyph|^logo|^btn_|^bg_|^ic_|^asset|icon_?\d*x?\d*|@[23]x$|~ipad$"
# Folders of assets and of captures, least sizes, first year.
ASSET_DIRS = ["assets", "static", "img", "textures", "sprites", "drawable", "mipmap", "res", "wp-content", "site-packages", "node_modules", "bower_components", "vendor", "templates", ".git", "resources"]
ASSET_STARTS = ["drawable", "mipmap", "sample", "demo"]
ASSET_ENDS = [".app", ".lproj", ".xcassets", ".imageset", ".iconset", ".bundle", ".framework"]
CAPTURE_DIRS = ["camera uploads", "dcim", "camera roll", "pictures", "photos", "photo booth library", "icloud photos", "google photos", "camera", "whatsapp images", "whatsapp video", "takeout"]
CARD_DIR = r"(?i)^1\d\d(APPLE|CANON|NIKON|_PANA|MSDCF|GOPRO)$"
LEAST_BYTES, TINY_BYTES, FIRST_YEAR = 2_048, 10_240, 1995


def below_root(folder: Column, root: str | None) -> Column:
    """The folder without what lies above the root's own name."""
    above = root.rstrip("/").rpartition("/")[0] if root else ""
    if not above:
        return folder
    inside = (folder == root.rstrip("/")) | folder.startswith(root.rstrip("/") + "/")
    return F.when(inside, F.substring(folder, len(above) + 1, 2**31 - 1)).otherwise(folder)


def _one_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def rule(name: Column, size: Column, folder: Column, dataless: Column, last_year: Column) -> Column:
    """The class of anything but a sidecar; null where no rule speaks."""
    ext = extension(name)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    parts = F.filter(F.split(F.lower(folder), "/"), lambda p: p != "")
    starts = lambda p: p.isin(*ASSET_DIRS) | p.rlike("^(" + "|".join(ASSET_STARTS) + ")") | p.rlike("(" + "|".join(e.replace(".", r"\.") for e in ASSET_ENDS) + ")$")
    asset_zone = F.exists(parts, starts)
    capture_zone = F.exists(parts, lambda p: p.isin(*CAPTURE_DIRS) | p.rlike(CARD_DIR))
    year = F.substring(base, 1, 4).try_cast("int")
    valid = F.coalesce(year.between(F.lit(FIRST_YEAR), last_year) & ~year.isin(*CLOCK_YEARS), F.lit(False))
    camera = base.rlike(_one_of(CAMERA_NAMES)) | (base.rlike(DATED_CAMERA) & valid)
    image = ext.isin(*IMAGES)
    tiny = image & F.coalesce(size < TINY_BYTES, F.lit(False))
    return (
        F.when(ext.isin(*NEVER), "ph:asset")
        .when(~ext.isin(*IMAGES, *VIDEOS, *RAWS), None)
        .when(asset_zone, "ph:asset")
        .when(ext.isin(*RAWS), "ph:cert")
        .when(base.rlike(_one_of(SCREENSHOTS)), "ph:screen")
        .when(base.rlike(_one_of(RECEIVED)), "ph:recv")
        .when(base.rlike(_one_of(FROM_THE_WEB)) | base.rlike("(?i)" + ICONS), "ph:asset")
        .when(image & (size < LEAST_BYTES), "ph:asset")
        .when((base.rlike(UPLOADED) & valid) | (camera & capture_zone), "ph:cert")
        .when(ext.isin(".heic", ".heif"), F.when(capture_zone, "ph:cert").otherwise("ph:likely"))
        .when(camera, F.when(tiny, "ph:asset").otherwise("ph:likely"))
        .when(base.rlike(_one_of(POSSIBLE_NAMES)), "ph:poss")
        .when(capture_zone & ~tiny, "ph:poss")
        .when(tiny, "ph:asset")
        .when(dataless, "ph:unk")
    )


def classify_photos(files: DataFrame, now: Column, root: str | None = None, dataless: Column | None = None) -> DataFrame:
    """files (dir, name, size) with `photo` (null: neither image, video nor sidecar, or without a sign).

    A sidecar beside a capture of its stem, whatever the case, is ph:side, a lone one junk, jB:SC.
    `now` is epoch seconds. Null names and folders count as empty, a null size passes the floors.
    """
    name, folder = F.coalesce("name", F.lit("")), F.coalesce("dir", F.lit(""))
    ext = extension(name)
    low_base = F.lower(F.substring(name, F.lit(1), F.length(name) - F.length(ext)))
    gone = F.coalesce(dataless, F.lit(False)) if dataless is not None else F.lit(False)
    side = ext.isin(*SIDECARS)
    captures = files.filter(ext.isin(*IMAGES, *VIDEOS, *RAWS)).select(folder.alias("_d"), low_base.alias("_b")).distinct().withColumn("_met", F.lit(True))
    lone = files.filter(side).withColumns({"_d": folder, "_b": low_base}).join(captures, ["_d", "_b"], "left")
    sidecars = lone.withColumn("photo", F.when(F.col("_met"), "ph:side").otherwise("jB:SC")).drop("_d", "_b", "_met")
    last_year = F.year(F.timestamp_seconds(now)) + 1
    others = files.filter(~side).withColumn("photo", rule(name, F.col("size"), below_root(folder, root), gone, last_year))
    return others.unionByName(sidecars)
