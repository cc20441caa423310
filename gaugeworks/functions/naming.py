"""Names, paths, seeds and small conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by MIME type.
MIME_EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/bmp": ".bmp", "image/tiff": ".tif"}


def url_slug(url: Column) -> Column:
    """The last path part of a url as a safe file stem; a plus sign is no space, empty becomes ``image``."""
    path = F.regexp_replace(F.regexp_extract(url, r"(?s)^([^?]*)", 1), r"\+", "%2B")
    plain = F.coalesce(F.try_url_decode(path), path)
    name = F.regexp_extract(F.regexp_replace(plain, "/+$", ""), r"(?s)([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.coalesce(F.nullif(safe, F.lit("")), F.lit("image")), 1, 80)


def mime_extension(mime: Column) -> Column:
    """Extension of a content type; parameters and case don't matter, null if unknown."""
    table = F.create_map(*(F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv))
    return F.try_element_at(table, F.lower(F.trim(F.substring_index(mime, ";", 1))))


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def path_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?<=.)(\.[^.]*)$", 1))


def path_parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def path_order(path: Column) -> Column:
    """Sort key that orders paths by their parts."""
    return F.split(path, "/")


def labels_dir(images_dir: Column) -> Column:
    """The last ``images`` part replaced by ``labels``; an error where there is none."""
    made = F.regexp_replace(images_dir, r"^(.*/|)images(/.*|)$", "$1labels$2")
    return F.when(images_dir.rlike(r"(^|.*/)images(/|$)"), made).otherwise(F.raise_error(F.concat(F.lit("no images part in "), images_dir)))


def collision_safe(slug: Column, extension: Column, sha: Column, taken: Column) -> Column:
    """File name, with the first 8 digits of the digest where the plain one is taken."""
    return F.concat(F.when(taken, F.concat(slug, F.lit("_"), F.substring(sha, 1, 8))).otherwise(slug), extension)


def image_seed(master: int, class_id: Column, index: Column) -> Column:
    return F.lit(master).cast("bigint") * 1_000_003 + class_id.cast("bigint") * 100_000 + index.cast("bigint")


def ints_to_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def text_to_ints(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int"))


def class_name(class_id: Column, names: list[str]) -> Column:
    """Name of a class id; the number itself where it is out of range."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), class_id.cast("int")), class_id.cast("string"))


def model_version(run: Column, weights: Column) -> Column:
    """run:stem of a weights file in run/weights, else its stem."""
    return F.when(F.coalesce(run, F.lit("")) != "", F.concat(run, F.lit(":"), path_stem(weights))).otherwise(path_stem(weights))


def class_id(name: Column, names: list[str]) -> Column:
    """Id of a class name; null if unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), name), F.lit(0).cast("long")).cast("int") - 1


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals (1 to 6), as the double itself rounds: halves that it holds exactly go to even; blank for null, nan and inf as such.

    Whole numbers split off without loss. What the product of the rest with a power of ten
    loses is known exactly (the rest cut into two halves of its bits, each of which
    multiplies without loss), and matters only where the rounded product ends in a half.
    """
    if not 1 <= digits <= 6:
        raise ValueError(f"digits out of 1 to 6: {digits}")
    scale = 10**digits
    d = x.cast("double")
    size = F.abs(d)
    whole = F.floor(size)
    rest = size - whole
    product = rest * float(scale)
    spread = rest * 134217729.0  # 2^27 + 1
    high = spread - (spread - rest)
    lost = (high * float(scale) - product) + (rest - high) * float(scale)
    near = F.rint(product)
    half = F.abs(product - F.floor(product) - 0.5) == 0
    n = F.when(half & (lost > 0), F.ceil(product)).when(half & (lost < 0), F.floor(product)).otherwise(near).cast("long")
    digits_of = lambda v: F.lpad(v.cast("string"), digits, "0")
    body = F.concat(F.when(n == scale, whole + 1).otherwise(whole).cast("string"), F.lit("."), digits_of(F.when(n == scale, F.lit(0)).otherwise(n)))
    sign = F.when(d.cast("string").startswith("-"), "-").otherwise("")
    odd = F.isnan(d) | (size == float("inf"))
    return F.when(x.isNull(), "").when(F.isnan(d), "nan").when(odd, F.concat(sign, F.lit("inf"))).when(size >= 2.0**53, F.format_string(f"%.{digits}f", d)).otherwise(F.concat(sign, body))


# The classes that need an open or a close scene, and the share of aisle views among all others.
OPEN_SCENE, CLOSE_SCENE, AISLE_SHARE = [5], [2, 3, 6], 0.36


def scene_mode(class_ids: Column, draw: Column) -> Column:
    """The kind of scene that an image's classes ask for; draw (0 to 1) decides where they ask for none."""
    asks = lambda wanted: F.arrays_overlap(class_ids.cast("array<int>"), F.array(*map(F.lit, wanted)))
    return F.when(asks(OPEN_SCENE), "open").when(asks(CLOSE_SCENE), "close").when(draw < AISLE_SHARE, "aisle").otherwise("single")
