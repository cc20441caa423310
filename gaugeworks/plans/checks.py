"""More registered queries: small conversions, files and labels, reconciliation and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry, hashing, naming
from ..operators import dedup, matching, policy, rollup, validation
from ..schemas import CLASS_NAMES, SPLITS
from ..session import table
from ..sources import images as sources
from ..sources import sinks
from . import lenses
from .queries import _BOX_KEYS, _BOXES, _DASHBOARD_PLAIN, _DECIDE, _FILES, _KEYS, _NAMES, _RULES, _VALIDATION, _VALIDATION_PARTS, _name, query, validation_tables

_SPLIT = "['train', 'val', 'test'][1 + {} % 3]"


def _split(column: str):
    return F.element_at(F.array(*map(F.lit, SPLITS)), (F.pmod(column, F.lit(3)) + 1).cast("int"))


# ---- small conversions ----


@query(f"WITH {_BOXES} SELECT {_KEYS}, w * h AS area FROM boxes")
def box_area(spark, sf_dir):
    return lenses.label_boxes(spark, sf_dir).select(*_BOX_KEYS, geometry.area(F.col("w"), F.col("h")).alias("area"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 9 < 7 THEN (p_partkey % 9)::INT END AS class_id FROM part")
def class_ids_of_names(spark, sf_dir):
    """Names back to ids; two of nine are unknown."""
    name = F.coalesce(F.get(F.array(*map(F.lit, CLASS_NAMES)), F.pmod("p_partkey", F.lit(9)).cast("int")), F.lit("rust"))
    return table(spark, sf_dir, "part").select("p_partkey", naming.class_id(name, CLASS_NAMES).alias("class_id"))


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_bytes(spark, sf_dir):
    """Digests of equal files."""
    d = table(spark, sf_dir, "documents").select(hashing.md5(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"SELECT * REPLACE (printf('%.4f', failure_rate) AS failure_rate, printf('%.3f', average_inference_ms) AS average_inference_ms, coalesce(printf('%.4f', average_confidence), '') AS average_confidence) FROM ({_DASHBOARD_PLAIN})")
def dashboard_file_cells(spark, sf_dir):
    """The monthly dashboard with the decimals of its file."""
    months = {"year": F.year("timestamp"), "month": F.month("timestamp")}
    return sinks.dashboard_cells(rollup.dashboard(lenses.inspections(spark, sf_dir), lenses.detections(spark, sf_dir), months, rounded=False))


@query(f"""WITH v AS (SELECT s_nationkey, list((s_suppkey % 10) / 10 ORDER BY s_suppkey) AS p, list((s_suppkey % 7) / 7 ORDER BY s_suppkey) AS r FROM supplier GROUP BY 1)
SELECT s_nationkey, {_NAMES}[i + 1] AS class, CASE WHEN len(p) = 7 THEN p[i + 1] END AS precision, CASE WHEN len(p) = 7 THEN r[i + 1] END AS recall, CASE WHEN len(p) = 7 THEN p[i + 1] END AS ap50, CASE WHEN len(p) = 7 THEN r[i + 1] END AS ap50_95 FROM v, range(7) t(i)""")
def metrics_by_class(spark, sf_dir):
    """Metric vectors of nations with seven suppliers, class by class; blank elsewhere."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.struct("s_suppkey", (F.col("s_suppkey") % 10 / 10).alias("p"), (F.col("s_suppkey") % 7 / 7).alias("r")).alias("x"))
    v = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return matching.metrics_by_class(v.select("s_nationkey", F.col("x.p").alias("precision"), F.col("x.r").alias("recall"), F.col("x.p").alias("ap50"), F.col("x.r").alias("ap50_95")))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS p FROM pages), n AS (SELECT page_id, p, regexp_extract(p, '[^/]*$') AS f FROM u)
SELECT page_id, CASE WHEN regexp_matches(f, '^.+[.][^.]*$') THEN regexp_extract(f, '^(.+)[.][^.]*$', 1) ELSE f END AS stem, CASE WHEN regexp_matches(f, '^.+[.][^.]*$') THEN lower(regexp_extract(f, '([.][^.]*)$', 1)) ELSE '' END AS suffix, regexp_extract(p, '([^/]*)/[^/]*$', 1) AS parent,
  CASE WHEN page_id % 2 = 0 THEN 'photo_' || left(sha256(f), 8) ELSE 'photo' END || '.png' AS safe, 'data/labels/' || page_id AS labels FROM n""")
def path_parts(spark, sf_dir):
    """Stem, suffix, parent, collision-safe name and label folder of paths."""
    p = F.regexp_extract("url", "^[^?#]*", 0)
    rows = table(spark, sf_dir, "pages").select("page_id", p.alias("p"), F.substring_index(p, "/", -1).alias("f"))
    safe = naming.collision_safe(F.lit("photo"), F.lit(".png"), hashing.sha256(F.col("f").cast("binary")), F.col("page_id") % 2 == 0)
    labels = naming.labels_dir(F.concat(F.lit("data/images/"), F.col("page_id").cast("string")))
    return rows.select("page_id", naming.path_stem(F.col("p")).alias("stem"), naming.path_suffix(F.col("p")).alias("suffix"), naming.path_parent(F.col("p")).alias("parent"), safe.alias("safe"), labels.alias("labels"))


@query("""WITH c AS (SELECT l_orderkey, list(DISTINCT l_partkey % 7) AS ids, min(l_suppkey) % 100 / 100 AS draw FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN list_contains(ids, 5) THEN 'open' WHEN list_has_any(ids, [2, 3, 6]) THEN 'close' WHEN draw < 0.36 THEN 'aisle' ELSE 'single' END AS mode FROM c""")
def scene_modes(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.pmod("l_partkey", F.lit(7)).cast("int")).alias("ids"), (F.min("l_suppkey") % 100 / 100).alias("draw"))
    return c.select("l_orderkey", naming.scene_mode(F.col("ids"), F.col("draw")).alias("mode"))


@query(f"""WITH {_BOXES}, turned AS (SELECT l_orderkey, class_id, 1 - cx AS cx, cy, w, h, greatest(0, 1 - cx - w / 2) AS x1, greatest(0, cy - h / 2) AS y1, least(1, 1 - cx + w / 2) AS x2, least(1, cy + h / 2) AS y2 FROM boxes)
SELECT l_orderkey, count(*) FILTER (x2 - x1 > 1e-6 AND y2 - y1 > 1e-6 AND (x2 - x1) * (y2 - y1) >= 0.2 * (w * h)) AS n, round(coalesce(sum((x2 - x1) * (y2 - y1)) FILTER (x2 - x1 > 1e-6 AND y2 - y1 > 1e-6 AND (x2 - x1) * (y2 - y1) >= 0.2 * (w * h)), 0), 9) AS area FROM turned GROUP BY 1""")
def visible_boxes(spark, sf_dir):
    """Boxes of each image turned, cut and kept where a fifth of them stays visible."""
    b = lenses.label_boxes(spark, sf_dir)
    per = b.groupBy("l_orderkey").agg(F.collect_list(F.struct("class_id", geometry.flipped(F.col("cx")).alias("cx"), "cy", "w", "h")).alias("boxes"))
    cut = per.select("l_orderkey", geometry.clipped_boxes(F.col("boxes")).alias("boxes"))
    return cut.select("l_orderkey", F.size("boxes").cast("bigint").alias("n"), F.round(F.aggregate("boxes", F.lit(0.0), lambda a, x: a + geometry.area(x["w"], x["h"])), 9).alias("area"))


# ---- labels and predictions ----

#: The second line of a label file by part size: sound, too short, a class that isn't whole, blank, no number.
_LINES = ["3 0.1 0.1 0.1 0.1", "3 0.1 0.1 0.1", "1.0 0.5 0.5 0.5 0.5", "  ", "x 0 0 0 0"]


@query("""SELECT p_partkey, p_size % 5 IN (0, 3) AS valid, CASE p_size % 5 WHEN 0 THEN 2 WHEN 3 THEN 1 ELSE 0 END::BIGINT AS n_strict, CASE p_size % 5 WHEN 0 THEN 2 ELSE 1 END::BIGINT AS n_lines FROM part""")
def label_parsing(spark, sf_dir):
    """Label files with odd lines, parsed strictly and line by line."""
    second = F.element_at(F.array(*map(F.lit, _LINES)), (F.pmod("p_size", F.lit(5)) + 1).cast("int"))
    text = F.concat(F.pmod("p_partkey", F.lit(7)).cast("string"), F.lit(" 0.5 0.5 0.2 0.2\n"), second, F.lit("\n"))
    files = table(spark, sf_dir, "part").select(F.lit("train").alias("split"), F.col("p_partkey").cast("string").alias("stem"), text.alias("text"))
    strict, marked = sources.labels(files)
    loose, _ = sources.labels(files, "lines")
    count = lambda df, name: df.groupBy("stem").agg(F.count(F.lit(1)).alias(name))
    joined = marked.join(count(strict, "a"), "stem", "left").join(count(loose, "b"), "stem", "left")
    return joined.select(F.col("stem").cast("bigint").alias("p_partkey"), "valid", F.coalesce("a", F.lit(0)).alias("n_strict"), F.coalesce("b", F.lit(0)).alias("n_lines"))


@query(f"""WITH {_BOXES} SELECT o_orderkey, coalesce(string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h) || chr(10), '' ORDER BY class_id, l_linenumber, printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h)), '') AS text
FROM orders LEFT JOIN boxes ON l_orderkey = o_orderkey GROUP BY 1""")
def label_files(spark, sf_dir):
    """The text of every order's label file, empty where it has no boxes."""
    b = lenses.label_boxes(spark, sf_dir).withColumns({"split": F.lit("train"), "stem": F.col("l_orderkey"), "line_no": F.col("l_linenumber")})
    files = table(spark, sf_dir, "orders").select(F.lit("train").alias("split"), F.col("o_orderkey").alias("stem"))
    return sinks.label_text(b, files).select(F.col("stem").alias("o_orderkey"), "text")


@query(f"""{_DECIDE} SELECT inspection_id, CASE WHEN len(failing) > 0 THEN 'FAIL' ELSE 'PASS' END AS result, round(coalesce(top, 0), 6) AS max_confidence, coalesce(array_to_string(failing, ','), '') AS failing_classes FROM per""")
def nested_decisions(spark, sf_dir):
    """The decision of images that carry their detections as an array."""
    d = lenses.detections(spark, sf_dir)
    none = F.array().cast("array<double>")
    per = d.groupBy("inspection_id").agg(F.collect_list(F.struct(F.col("class_name").alias("class"), "confidence", none.alias("bbox"))).alias("pred"))
    return per.select("inspection_id", policy.decide_nested(F.col("pred")).alias("x")).select("inspection_id", "x.result", "x.max_confidence", F.array_join("x.failing_classes", ",").alias("failing_classes"))


@query(f"""WITH {_BOXES} SELECT o_orderkey AS image, {_SPLIT.format('o_orderkey')} AS split, count(l_orderkey) AS n_gt, round(coalesce(sum((cx - w / 2) * 1280), 0), 6) AS left_edges FROM orders LEFT JOIN boxes ON l_orderkey = o_orderkey GROUP BY ALL""")
def evaluation_records(spark, sf_dir):
    """Nested records for an evaluation: truths in pixels, none for confirmed good images."""
    from .inspect import evaluation_records as export

    images = table(spark, sf_dir, "orders").select(_split("o_orderkey").alias("split"), F.col("o_orderkey").alias("stem"), F.lit(1280.0).alias("width"), F.lit(960.0).alias("height"))
    b = lenses.label_boxes(spark, sf_dir)
    labels = b.select(_split("l_orderkey").alias("split"), F.col("l_orderkey").alias("stem"), F.col("l_linenumber").alias("line_no"), "class_id", "cx", "cy", "w", "h")
    scores = images.select("split", "stem", F.array().cast("array<struct<class:string,confidence:double,bbox:array<double>>>").alias("pred"))
    out = export(images, labels, scores)
    return out.select("image", "split", F.size("gt").cast("bigint").alias("n_gt"), F.round(F.aggregate("gt", F.lit(0.0), lambda a, g: a + g["bbox"][0]), 6).alias("left_edges"))


# ---- duplicates across runs, splits ----


@query(f"""WITH RECURSIVE {_FILES}, old AS (SELECT DISTINCT sha256, dhash FROM files WHERE split = 'test'), new AS (SELECT id, sha256, dhash FROM files WHERE split <> 'test'),
  fits AS MATERIALIZED (SELECT id, bool_or(new.sha256 = old.sha256) AS same, bool_or(bit_count(xor(new.dhash, old.dhash)::BIT) <= 6) AS near FROM new CROSS JOIN old GROUP BY 1),
  edges AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, CASE WHEN a.sha256 = b.sha256 THEN 0 ELSE 1 END AS kind FROM new a JOIN new b ON a.id < b.id AND (a.sha256 = b.sha256 OR bit_count(xor(a.dhash, b.dhash)::BIT) <= 6)),
  befores AS MATERIALIZED (SELECT dst, list(src) AS srcs FROM edges GROUP BY 1),
  numbered AS MATERIALIZED (SELECT new.id, coalesce(srcs, []) AS srcs, same OR near AS gone, row_number() OVER (ORDER BY new.id) AS k FROM new JOIN fits USING (id) LEFT JOIN befores ON dst = new.id),
  scan AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL
    SELECT n.k, CASE WHEN n.gone OR len(n.srcs) > 0 AND list_has_any(s.kept, n.srcs) THEN s.kept ELSE list_append(s.kept, n.id) END FROM scan s JOIN numbered n ON n.k = s.k + 1),
  winners AS (SELECT unnest(arg_max(kept, k)) AS id FROM scan),
  matched AS (SELECT dst, min(kind) AS kind FROM edges WHERE src IN (SELECT id FROM winners) GROUP BY 1)
SELECT n.id, CASE WHEN w.id IS NOT NULL THEN 'ok' WHEN same OR m.kind = 0 THEN 'duplicate_sha256' ELSE 'near_duplicate' END AS verdict
FROM new n JOIN fits USING (id) LEFT JOIN winners w ON w.id = n.id LEFT JOIN matched m ON m.dst = n.id""")
def dedup_across_runs(spark, sf_dir):
    """The greedy rule for the files of train and val after those of test, which an earlier run kept."""
    f = lenses.files(spark, sf_dir)
    return dedup.greedy(f.where("split <> 'test'"), kept=f.where("split = 'test'")).select("id", "verdict")


@query(f"SELECT s AS split, (SELECT count(*) FROM documents WHERE ['train', 'val'][1 + doc_id % 2] = s) AS n FROM (SELECT unnest(['train', 'val', 'test']) AS s)")
def split_counts(spark, sf_dir):
    """Rows of each split, with 0 for the one that is absent."""
    names = F.element_at(F.array(F.lit("train"), F.lit("val")), (F.pmod("doc_id", F.lit(2)) + 1).cast("int"))
    return validation.split_counts(table(spark, sf_dir, "documents").select(names.alias("split")))


@query(f"""WITH c AS (SELECT DISTINCT l_orderkey, l_partkey % 7 AS c FROM lineitem), n AS (SELECT i::INT AS class_id, {_name('i')} AS class_name, (SELECT count(*) FROM c WHERE c.c = i) AS n_annotations FROM range(7) r(i))
SELECT *, n_annotations = min(n_annotations) OVER () AS is_least FROM n""")
def class_minimum(spark, sf_dir):
    """Images of each class in a multi-label table, and the least of them."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.pmod("l_partkey", F.lit(7)).cast("int")).alias("class_ids"))
    return validation.class_minimum(c)


@query(f"SELECT {_name('p_partkey % 7')} AS class_name, min(p_partkey) AS seed, arg_min(p_name, p_partkey) AS filename FROM part GROUP BY 1")
def first_examples(spark, sf_dir):
    """The first part of each class."""
    p = table(spark, sf_dir, "part").select(naming.class_name(F.pmod("p_partkey", F.lit(7)), CLASS_NAMES).alias("class_name"), F.col("p_partkey").alias("seed"), F.col("p_name").alias("filename"))
    return rollup.first_per_class(p)


@query(f"""WITH c AS (SELECT l_orderkey, unnest(list(DISTINCT l_partkey % 7)) AS c FROM lineitem GROUP BY 1)
SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS images, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS unique_seeds, (SELECT count(DISTINCT l_orderkey % 1000) FROM lineitem) AS unique_digests, (SELECT min(l_orderkey) FROM lineitem) AS first_seed, (SELECT max(l_orderkey) FROM lineitem) AS last_seed,
  (SELECT string_agg({_name('i')} || '=' || (SELECT count(*) FROM c WHERE c.c = i), ',' ORDER BY i) FROM range(7) r(i)) AS per_class""")
def render_summary(spark, sf_dir):
    """What a generated set says of itself."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seed")).agg(F.collect_set(F.pmod("l_partkey", F.lit(7))).alias("class_ids")).withColumn("digest", F.col("seed") % 1000)
    out = rollup.render_summary(m, CLASS_NAMES)
    text = F.array_join(F.transform(F.array(*map(F.lit, CLASS_NAMES)), lambda n: F.concat(n, F.lit("="), F.element_at("per_class", n).cast("string"))), ",")
    return out.withColumn("per_class", text)


# ---- reconciliation ----


@query("""WITH files AS (SELECT s_name AS annotated_file, 'page' AS source_page, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE 'c' END AS creator, CASE WHEN s_suppkey % 11 <> 0 THEN 'l' END AS license FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_name, 'page', 'c', 'l' FROM supplier WHERE s_suppkey % 13 = 1),
  names AS (SELECT s_name FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT s_name AS annotated_file, 'missing' AS fault FROM names WHERE s_name NOT IN (SELECT annotated_file FROM files) UNION ALL SELECT DISTINCT annotated_file, 'extra' FROM files WHERE annotated_file NOT IN (SELECT s_name FROM names)
UNION ALL SELECT annotated_file, 'repeated' FROM files GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT annotated_file, 'blank creator' FROM files WHERE trim(creator) = '' UNION ALL SELECT annotated_file, 'blank license' FROM files WHERE license IS NULL""")
def attributions(spark, sf_dir):
    """Attribution rows against the files that need them."""
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "annotated_file")
    cells = ["annotated_file", F.lit("page").alias("source_page")]
    rows = s.where("s_suppkey % 5 <> 0").select(*cells, F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise("c").alias("creator"), F.when(F.col("s_suppkey") % 11 != 0, "l").alias("license"))
    rows = rows.union(s.where("s_suppkey % 13 = 1").select(*cells, F.lit("c"), F.lit("l")))
    return validation.attribution_violations(rows, s.where("s_suppkey % 3 <> 0"), required=("source_page", "creator", "license"))


@query("""SELECT c_custkey, coalesce(c_custkey % 10 <> 3 AND c_custkey % 10 <> 4, false) AS image_match, c_custkey % 10 <> 4 AS label_match FROM customer""")
def rebuilt_bytes(spark, sf_dir):
    """Digests of a set and of its rebuilding: some pictures differ, some rows are gone."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.col("c_name")).alias("image"), F.md5(F.col("c_mktsegment")).alias("label"))
    again = c.where("c_custkey % 10 <> 4").withColumn("image", F.when(F.col("c_custkey") % 10 == 3, F.md5("image")).otherwise(F.col("image")))
    return validation.digests_match(c, again, "c_custkey", ["image", "label"])


@query(f"SELECT {_SPLIT.format('o_orderkey')} AS split, o_orderkey AS stem, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 5) AS has_label, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20) AS has_image FROM orders")
def render_files(spark, sf_dir):
    """A manifest joined with its label and picture files."""
    li = table(spark, sf_dir, "lineitem").select(_split("l_orderkey").alias("split"), F.col("l_orderkey").alias("stem"), "l_quantity")
    manifest = table(spark, sf_dir, "orders").select(_split("o_orderkey").alias("split"), F.col("o_orderkey").alias("stem"))
    return validation.render_files(manifest, li.where("l_quantity > 5"), li.where("l_quantity > 20"))


@query(f"""WITH {_BOXES}, m AS (SELECT o_orderkey AS seed, {_SPLIT.format('o_orderkey')} AS split, coalesce((SELECT list_sort(list(c)) FROM (SELECT class_id AS c FROM boxes WHERE l_orderkey = o_orderkey AND l_linenumber > 1)), []) AS told, coalesce((SELECT list_sort(list(class_id)) FROM boxes WHERE l_orderkey = o_orderkey), []) AS ids FROM orders),
  r AS (SELECT 'not_flagged_synthetic' AS rule, count(*) AS n FROM m WHERE seed % 50 = 0 UNION ALL SELECT 'size_differs', count(*) FROM m WHERE seed % 40 = 1 UNION ALL SELECT 'version_differs', count(*) FROM m WHERE seed % 30 = 2
  UNION ALL SELECT 'class_out_of_range', count(*) FROM boxes WHERE class_id NOT BETWEEN 0 AND 6
  UNION ALL SELECT 'box_out_of_shape', count(DISTINCT l_orderkey) FROM boxes WHERE {' OR '.join(f'({c})' for k, c in _RULES.items() if k != 'class_id')}
  UNION ALL SELECT 'number_of_classes', count(*) FROM m WHERE len(ids) NOT BETWEEN 1 AND 3 UNION ALL SELECT 'class_repeated', count(*) FROM m WHERE len(list_distinct(ids)) < len(ids) UNION ALL SELECT 'labels_differ', count(*) FROM m WHERE told <> ids
  UNION ALL SELECT 'too_few_of_a_class', count(*) FROM range(7) t(i) WHERE (SELECT count(*) FROM boxes WHERE class_id = i) < 700
  UNION ALL SELECT 'split_counts_differ', count(*) FROM (SELECT s, (SELECT count(*) FROM m WHERE split = s) AS k, (SELECT count(*) FROM m) AS n FROM (SELECT unnest(['train', 'val', 'test']) AS s)) WHERE k <> CASE s WHEN 'train' THEN n * 70 // 100 WHEN 'val' THEN n * 15 // 100 ELSE n - n * 70 // 100 - n * 15 // 100 END
  UNION ALL SELECT 'file_missing', count(*) FROM m WHERE seed % 20 = 3 OR seed % 25 = 4 UNION ALL SELECT 'bytes_not_unique', count(*) FROM (SELECT seed % 500 FROM m WHERE seed % 25 <> 4 GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'picture_size_differs', count(*) FROM m WHERE seed % 60 = 5
  UNION ALL SELECT 'too_few_rows', greatest(0, 20000 - count(*)) FROM m)
SELECT * FROM r WHERE n > 0""")
def render_set_rules(spark, sf_dir):
    """Orders as a generated set, line items as its labels, with every kind of fault."""
    key = F.col("o_orderkey")
    told = lenses.label_boxes(spark, sf_dir).where("l_linenumber > 1").groupBy("l_orderkey").agg(F.collect_list("class_id").alias("class_ids"))
    orders = table(spark, sf_dir, "orders").join(told, F.col("l_orderkey") == key, "left")
    manifest = orders.select(
        key.alias("seed"),
        _split("o_orderkey").alias("split"),
        F.coalesce("class_ids", F.array().cast("array<int>")).alias("class_ids"),
        F.when(key % 50 == 0, "false").otherwise("true").alias("synthetic"),
        F.when(key % 40 == 1, 640).otherwise(960).alias("width"),
        F.lit(640).alias("height"),
        F.when(key % 30 == 2, "v1").otherwise("v2").alias("generator_version"),
    )
    labels = lenses.label_boxes(spark, sf_dir).withColumn("seed", F.col("l_orderkey"))
    files = table(spark, sf_dir, "orders").select(
        key.alias("seed"), (key % 20 != 3).alias("has_label"), (key % 25 != 4).alias("has_image"), F.when(key % 25 != 4, key % 500).alias("digest"), F.when(key % 60 == 5, 100).otherwise(960).alias("width"), F.lit(640).alias("height")
    )
    return validation.render_set_violations(manifest, labels, files, "v2", min_rows=20_000, min_per_class=700)


@query(f"""{_VALIDATION_PARTS}, v AS ({_VALIDATION.removeprefix(_VALIDATION_PARTS)}), n AS (SELECT {_name('i')} AS name, (SELECT count(*) FROM boxes WHERE class_id = i) AS n FROM range(7) r(i))
SELECT (SELECT count(*) FROM images WHERE split = 'train') AS train_count, (SELECT count(*) FROM images WHERE split = 'val') AS val_count, (SELECT count(*) FROM images WHERE split = 'test') AS test_count, (SELECT count(*) FROM v) AS n_errors,
  (SELECT count(*) FROM v WHERE rule = 'image_quality') AS n_quality, (SELECT coalesce(string_agg('no annotations for class ' || name, ';' ORDER BY name), '') FROM n WHERE n = 0) AS warnings, (SELECT string_agg(name || '=' || n, ',' ORDER BY name) FROM n) AS annotations, 6 AS near_duplicate_bits""")
def validation_report(spark, sf_dir):
    """The whole report in one row: counts, errors, warnings."""
    images, files, labels = validation_tables(spark, sf_dir)
    out = validation.report(validation.validate(images, files, labels), images, lenses.label_boxes(spark, sf_dir))
    cells = F.array_join(F.transform(F.array_sort(F.map_keys("annotations_per_class")), lambda k: F.concat(k, F.lit("="), F.element_at("annotations_per_class", k).cast("string"))), ",")
    quality = F.size(F.filter("errors", lambda e: e.rlike(": (corrupt|too_small)$"))).cast("bigint")
    return out.select("train_count", "val_count", "test_count", F.size("errors").cast("bigint").alias("n_errors"), quality.alias("n_quality"), F.array_join("warnings", ";").alias("warnings"), cells.alias("annotations"), "near_duplicate_bits")


# ---- streams ----


@query("""WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * i AS start, event_type FROM events, range(6) t(i))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS reject_rate FROM w GROUP BY 1""")
def streaming_reject_rate(spark, sf_dir):
    """The share of failures over six hours, every hour, as a stream over everything there is."""
    from ..storage import checkpoint_dir
    from ..streaming import hourly

    at = f"{checkpoint_dir(spark)}/rejects-{uuid.uuid4().hex}"
    events = hourly.read(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    rates = hourly.reject_rate(events.select(F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("overall_result")))
    writer = rates.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out"))
    writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(rates.schema).parquet(f"{at}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("reject_rate", 9).alias("reject_rate"))
