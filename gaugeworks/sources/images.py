"""Image files, label files and tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..functions.naming import path_order, path_parent, path_stem, path_suffix
from ..operators.ordered import ranked
from ..schemas import DOWNLOADS, PREDICTIONS, SOURCES, SPLIT_MANIFEST, SPLITS

# Suffixes of images for collecting and validating, and the fewer ones for splitting.
SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff"]
SPLIT_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp"]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as listings give it, with its store's scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def scan(spark: SparkSession, root: str, suffixes: list[str] = SUFFIXES, recursive: bool = False, content: bool = True) -> DataFrame:
    """path, filename, stem, suffix, parent, length and content of the images under a folder; a missing folder is empty.

    Files without bytes are rows, too (with empty content). Without content only the listing is read.
    """
    wanted = ["path", "length", *(["content"] if content else [])]
    kinds = {"path": "string", "length": "bigint", "content": "binary"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in wanted)
    if not exists(spark, root):
        files = spark.createDataFrame([], schema)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select(*wanted)
        if empty := empty_files(spark, root, recursive):
            files = files.union(spark.createDataFrame([(p, 0, b"")[: len(wanted)] for p in empty], schema))
    path = F.col("path")
    named = files.withColumns({"filename": F.substring_index(path, "/", -1), "stem": path_stem(path), "suffix": path_suffix(path), "parent": path_parent(path)})
    return named.where(F.col("suffix").isin(suffixes))


def with_digests(images: DataFrame) -> DataFrame:
    return images.withColumn("sha256", sha256(F.col("content")))


def folder_counts(spark: SparkSession, root: str, suffixes: list[str] = SPLIT_SUFFIXES) -> DataFrame:
    """Images per folder, from the listing alone."""
    return scan(spark, root, suffixes, recursive=True, content=False).groupBy("parent").agg(F.count(F.lit(1)).alias("n_images"))


def list_count(spark: SparkSession, path: str) -> int:
    """Entries of a list file: its lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def split_count(spark: SparkSession, path: str) -> int:
    """Images of a split that is a folder or a list file."""
    if path.endswith(".txt"):
        return list_count(spark, path) if exists(spark, path) else 0
    return scan(spark, path, SPLIT_SUFFIXES, content=False).count()


def empty_files(spark: SparkSession, root: str, recursive: bool = False) -> list[str]:
    """Paths of files without bytes, from the listing; Spark's own scan leaves these out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(at, recursive)
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0:
            found.append(f.getPath().toString())
    return sorted(found)


def targets(spark: SparkSession, explicit: list[str], folder: str | None = None, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(place, path) of what is to be inspected: the explicit paths as given, then a folder's images in order of their paths."""
    first = spark.createDataFrame([(i, p) for i, p in enumerate(explicit)], "place long, path string")
    if folder is None:
        return first
    listed = ranked(scan(spark, folder, suffixes, content=False).select("path"), [path_order(F.col("path"))], "place")
    return first.union(listed.select((F.col("place") + len(explicit) - 1).alias("place"), "path"))


def label_files(spark: SparkSession, root: str, split: str = "") -> DataFrame:
    """split, stem and whole text of each label file, empty ones included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(root).select("path", F.decode("content", "UTF-8").alias("text"))
    empty = spark.createDataFrame([(p, "") for p in empty_files(spark, root) if p.endswith(".txt")], "path string, text string")
    return files.union(empty).select(F.lit(split).alias("split"), path_stem(F.col("path")).alias("stem"), "text")


def label_lines(files: DataFrame) -> DataFrame:
    """Every line with content: keys, line_no, fields parsed, and whether the line is sound (five numbers, the first whole)."""
    lines = files.select("split", "stem", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
    parts = lines.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "").withColumn("p", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "))
    at = lambda i: F.get("p", F.lit(i))
    numbers = {"class_id": F.when(at(0).rlike(r"^[+-]?\d+$"), at(0).try_cast("int")), **{n: at(i + 1).try_cast("double") for i, n in enumerate(("cx", "cy", "w", "h"))}}
    sound = F.size("p") == 5
    for c in numbers:
        sound = sound & F.col(c).isNotNull()
    return parts.withColumns(numbers).withColumn("sound", sound).drop("p")


def labels(files: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(label rows, files with valid). strict: a file with any bad line gives no rows; lines: only bad lines are left out."""
    lines = label_lines(files)
    bad = lines.where(~F.col("sound")).select("split", "stem").distinct()
    rows = lines.where("sound")
    rows = rows.join(bad, ["split", "stem"], "left_anti") if mode == "strict" else rows
    marked = files.select("split", "stem").join(bad.withColumn("_bad", F.lit(True)), ["split", "stem"], "left")
    return rows.select("split", "stem", "line_no", "class_id", "cx", "cy", "w", "h"), marked.select("split", "stem", F.col("_bad").isNull().alias("valid"))


def dataset(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, label rows and label files of root/{train,val,test}/{images,labels}."""
    from functools import reduce

    images, files = [], []
    for s in SPLITS:
        images.append(scan(spark, f"{root}/{s}/images").withColumn("split", F.lit(s)))
        if exists(spark, f"{root}/{s}/labels"):
            files.append(label_files(spark, f"{root}/{s}/labels", s))
    none = spark.createDataFrame([], "split string, stem string, text string")
    rows, marked = labels(reduce(DataFrame.union, files, none))
    return with_digests(reduce(DataFrame.unionByName, images)), rows, marked


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document with one array of nested predictions."""
    return spark.read.schema(PREDICTIONS).option("multiLine", "true").json(path)


def csv_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV file with a header; values in the types of the schema."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows(spark, path, SOURCES)


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows(spark, path, SPLIT_MANIFEST)


def known_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digests of downloads that went well."""
    if not exists(spark, path):
        return spark.createDataFrame([], "sha256 string")
    return csv_rows(spark, path, DOWNLOADS).where("status = 'ok' and coalesce(sha256, '') <> ''").select("sha256").distinct()


def jdbc(spark: SparkSession, url: str, dbtable: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()
