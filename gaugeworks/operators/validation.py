"""Data set validation, pairing and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import label_problems
from ..schemas import CLASS_NAMES, SPLITS
from .dedup import NEAR_BITS, cross_split_leaks, duplicate_groups

BROKEN = ["corrupt", "unreadable", "too_small", "extreme_aspect"]


def class_dimension(spark, names: list[str] = CLASS_NAMES) -> DataFrame:
    return spark.createDataFrame([(i, n, "assembly" if i > 4 else "surface") for i, n in enumerate(names)], "class_id int, class_name string, family string")


def class_counts(labels: DataFrame, names: list[str] = CLASS_NAMES) -> DataFrame:
    """Annotations of every class, zero where there are none; ids out of range count nowhere."""
    counts = labels.groupBy(F.col("class_id").cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return class_dimension(labels.sparkSession, names).join(counts, "class_id", "left").select("class_id", "class_name", F.coalesce("n", F.lit(0)).alias("n_annotations"))


def class_warnings(labels: DataFrame, names: list[str] = CLASS_NAMES) -> DataFrame:
    """Classes without annotations."""
    return class_counts(labels, names).where("n_annotations = 0").select("class_id", "class_name")


def unpaired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left with a partner, once each."""
    return left.join(right.select(*keys), keys, "left_semi")


def label_violations(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys and rule, a row for each geometry rule that a label breaks."""
    problems = label_problems(*(F.col(c) for c in ("class_id", "cx", "cy", "w", "h")))
    return labels.select(*keys, F.explode(problems).alias("rule"))


def validate(images: DataFrame, label_files: DataFrame, labels: DataFrame, near_bits: int = NEAR_BITS) -> DataFrame:
    """All violations as (ordinal, rule, split, key, message).

    images: split, stem, filename, sha256, dhash, status. label_files: split, stem, valid (false: it can't be parsed).
    labels: split, stem, line_no, class_id, cx, cy, w, h. Images without a parsable label file are not hashed.
    """
    keys = ["split", "stem"]

    def rule(df: DataFrame, n: int, name: str, message) -> DataFrame:
        return df.select(F.lit(n).alias("ordinal"), F.lit(name).alias("rule"), "split", F.col("stem").alias("key"), message.alias("message"))

    orphan = rule(unpaired(label_files, images, keys), 1, "label_without_image", F.concat("stem", F.lit(".txt has no image")))
    bare = rule(unpaired(images, label_files, keys), 2, "image_without_label", F.concat("filename", F.lit(" has no label file")))
    spoilt = rule(paired(label_files.where("not valid"), images, keys), 3, "label_unparsable", F.lit("label file cannot be parsed"))
    sound = paired(images, label_files.where("valid"), keys)
    shape = label_violations(paired(labels, sound, keys), [*keys, "line_no"])
    shape = rule(shape, 4, "label_geometry", F.concat(F.lit("box "), F.col("line_no").cast("string"), F.lit(": "), F.col("rule")))
    broken = rule(sound.where(F.col("status").isin(BROKEN)), 5, "image_quality", F.col("status"))
    named = sound.withColumn("name", F.concat("split", F.lit("/"), "filename"))
    copies = duplicate_groups(named).select(
        F.lit(6).alias("ordinal"), F.lit("duplicate_sha256").alias("rule"), F.lit("").alias("split"), F.substring("sha256", 1, 12).alias("key"), F.array_join("members", ", ").alias("message")
    )
    many = F.when(F.col("n_a") + F.col("n_b") > 2, F.concat(F.lit(" ("), F.col("n_a").cast("string"), F.lit(" and "), F.col("n_b").cast("string"), F.lit(" files)"))).otherwise(F.lit(""))
    leaks = cross_split_leaks(named.where("status = 'ok'"), near_bits, "name").select(
        F.lit(7).alias("ordinal"),
        F.lit("near_duplicate_leakage").alias("rule"),
        F.lit("").alias("split"),
        F.col("a").alias("key"),
        F.concat(F.lit("and "), F.col("b"), F.lit(" differ by "), F.col("distance").cast("string"), F.lit(" bits"), many).alias("message"),
    )
    return reduce(DataFrame.unionByName, [orphan, bare, spoilt, shape, broken, copies, leaks])


def manifest_difference(plan: DataFrame, manifest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, kind (missing, extra, changed) and the changed fields; nulls are equal to each other."""
    p, m = plan.select(key, *fields).withColumn("_in", F.lit(1)).alias("p"), manifest.select(key, *fields).withColumn("_in", F.lit(1)).alias("m")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"p.{f}").eqNullSafe(F.col(f"m.{f}")), F.lit(f)) for f in fields)))
    kind = F.when(F.col("m._in").isNull(), F.lit("missing")).when(F.col("p._in").isNull(), F.lit("extra")).otherwise(F.lit("changed"))
    both = F.col("p._in").isNotNull() & F.col("m._in").isNotNull()
    out = p.join(m, F.col(f"p.{key}") == F.col(f"m.{key}"), "full").select(
        F.coalesce(f"p.{key}", f"m.{key}").alias(key), kind.alias("kind"), F.when(both, F.array_join(changed, ",")).otherwise(F.lit("")).alias("fields")
    )
    return out.where("kind <> 'changed' or fields <> ''")


def seed_overlap(rows: DataFrame, seed: str = "seed", split: str = "split") -> DataFrame:
    """Seeds that are in more than one split, with how many."""
    return rows.groupBy(seed).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def split_counts(rows: DataFrame, splits: list[str] = SPLITS) -> DataFrame:
    """Rows of each split, 0 for those that are absent."""
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return names.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def class_minimum(images: DataFrame, ids: str = "class_ids", names: list[str] = CLASS_NAMES) -> DataFrame:
    """Images of each class of a multi-label table, and whether it is the least of all."""
    counts = class_counts(images.select(F.explode(ids).alias("class_id")), names)
    least = counts.agg(F.min("n_annotations").alias("least"))
    return counts.crossJoin(F.broadcast(least)).select("class_id", "class_name", "n_annotations", (F.col("n_annotations") == F.col("least")).alias("is_least"))  # one row


def report(violations: DataFrame, images: DataFrame, labels: DataFrame, near_bits: int = NEAR_BITS) -> DataFrame:
    """The validation report, one row: images of each split, annotations of each class, errors in order, warnings, near_duplicate_bits.

    The errors are a list in one cell as the report asks for it; validate() is the table to work with.
    """
    split, key, message = F.col("split"), F.col("key"), F.col("message")
    text = (
        F.when(F.col("rule") == "label_without_image", F.concat(split, F.lit(": label "), message))
        .when(F.col("rule").isin("image_without_label", "label_unparsable"), F.concat(split, F.lit(": image "), message))
        .when(F.col("rule") == "duplicate_sha256", F.concat(F.lit("duplicate sha256 "), key, F.lit(" across "), message))
        .when(F.col("rule") == "near_duplicate_leakage", F.concat(F.lit("near-duplicate leakage: "), key, F.lit(" "), message))
        .otherwise(F.concat(split, F.lit("/"), key, F.lit(": "), message))
    )
    errors = violations.agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "split", "key", text.alias("text")))), lambda x: x["text"]).alias("errors"))
    per_split = split_counts(images).agg(*(F.max(F.when(F.col("split") == s, F.col("n"))).alias(f"{s}_count") for s in SPLITS))
    counts = class_counts(labels)
    per_class = counts.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_name", "n_annotations")))).alias("annotations_per_class"),
        F.sort_array(F.collect_list(F.when(F.col("n_annotations") == 0, F.concat(F.lit("no annotations for class "), "class_name")))).alias("warnings"),
    )
    return per_split.crossJoin(per_class).crossJoin(errors).withColumn("near_duplicate_bits", F.lit(near_bits))  # one row each


RENDER_SIZE, LEAST_ROWS, LEAST_OF_A_CLASS = (960, 640), 700, 100


def render_files(manifest: DataFrame, label_files: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of a manifest with what is missing of them: split, stem, has_label, has_image."""
    there = lambda df, name: df.select("split", "stem").distinct().withColumn(name, F.lit(True))
    joined = manifest.select("split", "stem").join(there(label_files, "l"), ["split", "stem"], "left").join(there(images, "i"), ["split", "stem"], "left")
    return joined.select("split", "stem", F.col("l").isNotNull().alias("has_label"), F.col("i").isNotNull().alias("has_image"))


def render_set_violations(
    manifest: DataFrame, labels: DataFrame, files: DataFrame | None = None, version: str | None = None, size: tuple[int, int] = RENDER_SIZE, min_rows: int = LEAST_ROWS, min_per_class: int = LEAST_OF_A_CLASS
) -> DataFrame:
    """Invariants of a generated set, one row (rule, n) for each that is broken.

    manifest: seed, split, class_ids, synthetic, width, height, generator_version; labels:
    seed, class_id, cx, cy, w, h; files: seed, has_label, has_image, digest (null: no file),
    width, height of the picture. Rules whose table or value isn't given are left out.
    """
    spark = manifest.sparkSession
    classes = manifest.select("seed", F.explode("class_ids").alias("class_id"))
    told = classes.groupBy("seed").agg(F.sort_array(F.collect_list(F.col("class_id").cast("int"))).alias("a"))
    found = labels.groupBy("seed").agg(F.sort_array(F.collect_list(F.col("class_id").cast("int"))).alias("b"))
    each = manifest.select("seed").distinct().join(told, "seed", "left").join(found, "seed", "full")
    n_boxes, own = F.size(F.coalesce("b", F.array().cast("array<int>"))), F.coalesce("b", F.array().cast("array<int>"))
    per_class = class_counts(labels).where(F.col("n_annotations") < min_per_class)
    # 70/15/15 of the rows in whole numbers
    n = F.sum("n").over(Window.partitionBy())
    wanted = F.when(F.col("split") == "train", F.floor(n * 70 / 100)).when(F.col("split") == "val", F.floor(n * 15 / 100)).otherwise(n - F.floor(n * 70 / 100) - F.floor(n * 15 / 100))
    cuts = split_counts(manifest).withColumn("wanted", wanted).where("n <> wanted")  # a row a split
    checks = {
        "seed_not_unique": manifest.groupBy("seed").count().where("count > 1"),
        "seed_in_several_splits": seed_overlap(manifest),
        "not_flagged_synthetic": manifest.where(F.coalesce("synthetic", F.lit("")) != "true"),
        "size_differs": manifest.where((F.col("width") != size[0]) | (F.col("height") != size[1])),
        "class_out_of_range": labels.where("class_id not between 0 and 6"),
        "box_out_of_shape": label_violations(labels, ["seed"]).where("rule <> 'class_id'").select("seed").distinct(),
        "number_of_classes": each.where(~n_boxes.between(1, 3)),
        "class_repeated": each.where(F.size(F.array_distinct(own)) < n_boxes),
        "labels_differ": each.where(~F.coalesce("a", F.array().cast("array<int>")).eqNullSafe(own)),
        "too_few_of_a_class": per_class,
        "split_counts_differ": cuts,
    }
    if version is not None:
        checks["version_differs"] = manifest.where(~F.col("generator_version").eqNullSafe(F.lit(version)))
    if files is not None:
        checks["file_missing"] = files.where("not has_label or not has_image")
        checks["bytes_not_unique"] = files.where("digest is not null").groupBy("digest").count().where("count > 1")
        checks["picture_size_differs"] = files.where((F.col("width") != size[0]) | (F.col("height") != size[1]))
    out = reduce(DataFrame.union, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n") for name, df in checks.items()])
    few = manifest.agg(F.greatest(F.lit(0), F.lit(min_rows) - F.count(F.lit(1))).alias("n")).select(F.lit("too_few_rows").alias("rule"), "n")
    return out.union(few).where("n > 0")


REQUIRED = ("source_page", "creator", "license", "license_url", "modifications")


def attribution_violations(rows: DataFrame, names: DataFrame, name: str = "annotated_file", required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Attributions against the files that need one: name and fault (missing, extra, repeated, or blank and the field)."""
    own, need = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")), names.select(name).distinct()
    fault = lambda df, text: df.select(name, text.alias("fault"))
    blank = F.explode(F.array_compact(F.array(*(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(c)) for c in required)))).alias("field")
    return reduce(
        DataFrame.union,
        [
            fault(need.join(own, name, "left_anti"), F.lit("missing")),
            fault(own.join(need, name, "left_anti"), F.lit("extra")),
            fault(own.where("n > 1"), F.lit("repeated")),
            fault(rows.select(name, blank), F.concat(F.lit("blank "), F.col("field"))),
        ],
    )


def digests_match(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and, for each digest field, whether both tables agree on it; a row that one side lacks agrees on nothing."""
    x, y = a.select(key, *fields).alias("x"), b.select(key, *fields).alias("y")
    same = [F.coalesce(F.col(f"x.{f}") == F.col(f"y.{f}"), F.lit(False)).alias(f"{f}_match") for f in fields]
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full").select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), *same)
