"""Registry of the queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, hashing, naming
from ..operators import dedup, graph, matching, policy, quality, rollup, splits, validation
from ..schemas import CLASS_NAMES, SPLITS
from ..session import table
from . import lenses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL fragments for the lenses ----

_NAMES = "[" + ", ".join(f"'{n}'" for n in CLASS_NAMES) + "]"


def _name(expr: str, names: str = _NAMES) -> str:
    return f"{names}[1 + {expr}]"


_INSPECTIONS = "inspections AS (SELECT o_orderkey AS inspection_id, o_orderdate AS timestamp, CASE WHEN o_orderstatus = 'F' THEN 'FAIL' ELSE 'PASS' END AS overall_result, o_totalprice / 1000 AS inference_ms FROM orders)"
_DETECTIONS = f"detections AS (SELECT l_orderkey AS inspection_id, {_name('l_partkey % 7')} AS class_name, l_discount * 10 AS confidence FROM lineitem)"
_EVENT_INSPECTIONS = "inspections AS (SELECT event_id AS inspection_id, ts AS timestamp, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS overall_result, value AS inference_ms FROM events)"
_EVENT_DETECTIONS = f"detections AS (SELECT event_id AS inspection_id, {_name('user_id % 7')} AS class_name, value / 500 AS confidence FROM events)"
_LIMIT = "CASE class_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in policy.THRESHOLDS.items()) + f" ELSE {policy.DEFAULT_THRESHOLD} END"
_BOXES = "boxes AS (SELECT *, (l_partkey % 9 - 1)::INT AS class_id, (l_suppkey % 80) / 64 AS cx, (l_partkey % 80) / 64 AS cy, (l_quantity::INT % 16) / 32 AS w, (l_linenumber % 8) / 16 AS h FROM lineitem)"
_WORDS = "words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS w FROM documents)"
_FILES = f"""{_WORDS}, cells AS (
  SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 72 AS b, count(*) AS n FROM words GROUP BY ALL
), spread AS (
  SELECT d.doc_id, i AS b, coalesce(c.n, 0) AS n FROM documents d CROSS JOIN range(72) t(i) LEFT JOIN cells c ON c.doc_id = d.doc_id AND c.b = i
), hashed AS (
  SELECT l.doc_id, sum(CASE WHEN r.n > l.n THEN 1::HUGEINT << (63 - (l.b // 9 * 8 + l.b % 9))::INT ELSE 0 END)::UBIGINT AS dhash
  FROM spread l JOIN spread r ON r.doc_id = l.doc_id AND r.b = l.b + 1 WHERE l.b % 9 < 8 GROUP BY 1
), files AS (
  SELECT d.doc_id AS id, sha256(d.text) AS sha256, dhash, ['train', 'val', 'test'][1 + d.doc_id % 3] AS split FROM documents d JOIN hashed USING (doc_id)
)"""


def _dashboard_sql(inspections: str, detections: str, buckets: str, names: str) -> str:
    return f"""WITH {inspections}, {detections}, stamped AS (SELECT *, {buckets} FROM inspections),
totals AS (SELECT {names}, count(*) AS total_inspections, count(*) - count(*) FILTER (overall_result = 'FAIL') AS passes, count(*) FILTER (overall_result = 'FAIL') AS fails,
  round(count(*) FILTER (overall_result = 'FAIL') / count(*), 4) AS failure_rate, ((2 * (sum(inference_ms::DECIMAL(24, 8)) * 100000000)::HUGEINT + 100 * count(inference_ms)) // (200 * count(inference_ms)))::DOUBLE / 1000000 AS average_inference_ms FROM stamped GROUP BY ALL),
found AS (SELECT {names}, class_name, count(*) AS defect_count, ((2 * (sum(confidence::DECIMAL(24, 8)) * 100000000)::HUGEINT + 100 * count(confidence)) // (200 * count(confidence)))::DOUBLE / 1000000 AS average_confidence FROM detections JOIN stamped USING (inspection_id) GROUP BY ALL)
SELECT totals.*, coalesce(class_name, '') AS defect_class, coalesce(defect_count, 0) AS defect_count, average_confidence FROM totals LEFT JOIN found USING ({names})"""


# ---- dashboards, decisions, recent ----


@query(_dashboard_sql(_EVENT_INSPECTIONS, _EVENT_DETECTIONS, "strftime(timestamp, '%Y-%m-%d') AS date, hour(timestamp)::INT AS hour", "date, hour"))
def dashboard_hourly(spark, sf_dir):
    """Hourly dashboard over events."""
    out = rollup.dashboard(lenses.event_inspections(spark, sf_dir), lenses.event_detections(spark, sf_dir), rollup.hourly())
    return out.withColumn("date", F.col("date").cast("string"))


_DASHBOARD_MONTHLY = _dashboard_sql(_INSPECTIONS, _DETECTIONS, "year(timestamp)::INT AS year, month(timestamp)::INT AS month", "year, month")


_DASHBOARD_PLAIN = re.sub(r"\(\(2 \* \(sum\((\w+)::.*? / 1000000|round\((count.*?/ count\(\*\)), 4\)", lambda m: m[2] or f"sum({m[1]}::DECIMAL(24, 8))::DOUBLE / count({m[1]})", _DASHBOARD_MONTHLY)


@query(_DASHBOARD_MONTHLY)
def dashboard_monthly(spark, sf_dir):
    """Monthly dashboard over orders and line items."""
    return rollup.dashboard(lenses.inspections(spark, sf_dir), lenses.detections(spark, sf_dir), {"year": F.year("timestamp"), "month": F.month("timestamp")})


@query(f"WITH {_INSPECTIONS}, {_DETECTIONS} SELECT inspection_id, timestamp, overall_result, inference_ms, count(class_name) AS n_detections FROM (SELECT * FROM inspections ORDER BY inspection_id DESC LIMIT 20) LEFT JOIN detections USING (inspection_id) GROUP BY ALL")
def recent_inspections(spark, sf_dir):
    return rollup.recent(lenses.inspections(spark, sf_dir), lenses.detections(spark, sf_dir))


_DECIDE = f"""WITH {_INSPECTIONS}, {_DETECTIONS}, per AS (
  SELECT inspection_id, max(confidence) AS top, list_sort(list(DISTINCT class_name) FILTER (confidence > {_LIMIT})) AS failing, count(*) AS n FROM detections GROUP BY ALL)"""


@query(f"{_DECIDE} SELECT inspection_id, CASE WHEN len(failing) > 0 THEN 'FAIL' ELSE 'PASS' END AS result, round(coalesce(top, 0), 6) AS max_confidence, array_to_string(coalesce(failing, []), ',') AS failing_classes, coalesce(n, 0) AS n_detections FROM inspections LEFT JOIN per USING (inspection_id)")
def pass_fail_decision(spark, sf_dir):
    out = policy.decide(lenses.inspections(spark, sf_dir), lenses.detections(spark, sf_dir))
    return out.withColumn("failing_classes", F.array_join("failing_classes", ","))


@query(f"{_DECIDE} SELECT unnest(failing) AS class_name, count(*) AS n_inspections FROM per GROUP BY 1")
def failing_classes(spark, sf_dir):
    out = policy.decide(lenses.inspections(spark, sf_dir), lenses.detections(spark, sf_dir))
    return out.select(F.explode("failing_classes").alias("class_name")).groupBy("class_name").agg(F.count(F.lit(1)).alias("n_inspections"))


@query(f"WITH {_DETECTIONS} SELECT count(*) AS boxes, (SELECT count(*) FROM (SELECT inspection_id FROM detections GROUP BY 1 HAVING max(confidence) >= 0.25)) AS images_025, (SELECT count(*) FROM (SELECT inspection_id FROM detections GROUP BY 1 HAVING max(confidence) >= 0.5)) AS images_050, (SELECT arg_min(class_name, struct_pack(c := -confidence, n := class_name)) FROM detections) AS best_class FROM detections")
def box_statistics(spark, sf_dir):
    return rollup.box_statistics(lenses.detections(spark, sf_dir), "inspection_id")


# ---- geometry and labels ----

_BOX_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
_KEYS = ", ".join(_BOX_KEYS)


@query(f"WITH {_BOXES} SELECT {_KEYS}, (cx - w / 2) * 1280 AS x1, (cy - h / 2) * 960 AS y1, (cx + w / 2) * 1280 AS x2, (cy + h / 2) * 960 AS y2 FROM boxes")
def yolo_to_xyxy(spark, sf_dir):
    b = lenses.label_boxes(spark, sf_dir)
    return b.select(*_BOX_KEYS, geometry.corners(*map(F.col, ("cx", "cy", "w", "h")), 1280, 960).alias("b")).select(*_BOX_KEYS, "b.*")


_CLIP = """cut AS (SELECT *, greatest(0, cx - w / 2) AS x1, greatest(0, cy - h / 2) AS y1, least(1, cx + w / 2) AS x2, least(1, cy + h / 2) AS y2 FROM {src})
SELECT {keys}, round((x1 + x2) / 2, 9) AS cx, round((y1 + y2) / 2, 9) AS cy, round(x2 - x1, 9) AS w, round(y2 - y1, 9) AS h FROM cut WHERE x2 - x1 > 1e-6 AND y2 - y1 > 1e-6"""


def _clipped(b: DataFrame) -> DataFrame:
    got = b.select(*_BOX_KEYS, geometry.clipped(*map(F.col, ("cx", "cy", "w", "h"))).alias("b")).where("b is not null")
    return got.select(*_BOX_KEYS, *(F.round(f"b.{c}", 9).alias(c) for c in ("cx", "cy", "w", "h")))


@query(f"WITH {_BOXES}, " + _CLIP.format(src="boxes", keys=_KEYS))
def box_clip(spark, sf_dir):
    return _clipped(lenses.label_boxes(spark, sf_dir))


@query(f"WITH {_BOXES}, flippable AS (SELECT l_orderkey FROM boxes GROUP BY 1 HAVING NOT bool_or(class_id IN (5, 6))), turned AS (SELECT * REPLACE (1 - cx AS cx) FROM boxes SEMI JOIN flippable USING (l_orderkey)), " + _CLIP.format(src="turned", keys=_KEYS))
def flip_boxes(spark, sf_dir):
    """Boxes of images that may be flipped, turned and cut to the image."""
    b = lenses.label_boxes(spark, sf_dir)
    may = b.groupBy("l_orderkey").agg(F.collect_set("class_id").alias("ids")).where(geometry.flip_allowed(F.col("ids"))).select("l_orderkey")
    return _clipped(b.join(may, "l_orderkey", "left_semi").withColumn("cx", geometry.flipped(F.col("cx"))))


_RULES = {
    "class_id": "class_id < 0 OR class_id > 6",
    "zero_area": "w <= 0 OR h <= 0",
    "outside_unit": "NOT (w <= 0 OR h <= 0) AND NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1)",
    "above_or_left": "NOT (w <= 0 OR h <= 0) AND (cx - w / 2 < -1e-6 OR cy - h / 2 < -1e-6)",
    "below_or_right": "NOT (w <= 0 OR h <= 0) AND (cx + w / 2 > 1 + 1e-6 OR cy + h / 2 > 1 + 1e-6)",
}


@query(f"WITH {_BOXES} " + " UNION ALL ".join(f"SELECT {_KEYS}, '{n}' AS rule FROM boxes WHERE {c}" for n, c in _RULES.items()))
def label_violations(spark, sf_dir):
    return validation.label_violations(lenses.label_boxes(spark, sf_dir), _BOX_KEYS)


_IMAGES = f"""li AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::INT AS q, round(l_discount * 100)::INT AS d FROM lineitem),
  boxes AS (SELECT *, {_name('l_partkey % 3')} AS class, (l_partkey % 4) * 20 AS x, (l_suppkey % 4) * 20 AS y, (l_partkey % 5) * 4 AS dx, (l_linenumber % 3) * 4 AS dy FROM li),
  truths AS (SELECT l_orderkey AS image, class, x AS x1, y AS y1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, q, d) AS g FROM boxes WHERE l_partkey % 2 = 1 AND l_orderkey % 10 <> 0),
  preds AS (SELECT l_orderkey AS image, class, d / 10 AS confidence, x + dx AS x1, y + dy AS y1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, q, d) AS p FROM boxes),
  pairs AS (SELECT t.image, t.class, g, p, confidence, greatest(0, 40 - abs(t.x1 - r.x1)) * greatest(0, 40 - abs(t.y1 - r.y1)) AS inter FROM truths t JOIN preds r ON t.image = r.image AND t.class = r.class)"""


@query(f"WITH {_IMAGES} SELECT image, class, round(inter / (3200 - inter), 9) AS iou, count(*) AS n FROM pairs WHERE inter / (3200 - inter) >= 0.5 GROUP BY ALL")
def iou_pairs(spark, sf_dir):
    """Truth and prediction pairs that overlap enough, counted by their overlap."""
    im = lenses.matching_images(spark, sf_dir)
    g = im.select("image", F.explode("gt").alias("g"), "pred").select("image", "g", F.explode(F.filter("pred", lambda p: p["class"] == F.col("g")["class"])).alias("p"))
    scored = g.select("image", F.col("g.class").alias("class"), geometry.array_iou(F.col("g.bbox"), F.col("p.bbox")).alias("iou")).where("iou >= 0.5")
    return scored.groupBy("image", "class", F.round("iou", 9).alias("iou")).agg(F.count(F.lit(1)).alias("n"))


_SWEEP = f"""WITH RECURSIVE {_IMAGES}, ts AS (SELECT i / 10 AS t FROM range(1, 10) r(i)),
  good AS (SELECT t, image, class, g, list({{'s': inter / (3200 - inter), 'p': p}}) AS c FROM pairs, ts WHERE inter / (3200 - inter) >= 0.5 AND confidence > t GROUP BY ALL),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY t, image, class ORDER BY g) AS k FROM good),
  fold AS (
    SELECT t, image, class, 0::BIGINT AS k, []::BIGINT[] AS used FROM (SELECT DISTINCT t, image, class FROM good)
    UNION ALL
    SELECT f.t, f.image, f.class, n.k, list_concat(f.used, list_transform(list_reverse_sort(list_filter(n.c, lambda x: NOT list_contains(f.used, x.p)))[1:1], lambda x: x.p))
    FROM fold f JOIN numbered n ON n.t = f.t AND n.image = f.image AND n.class = f.class AND n.k = f.k + 1
  ),
  tps AS (SELECT t, class, sum(len(used)) AS tp FROM (SELECT t, image, class, arg_max(used, k) AS used FROM fold GROUP BY ALL) GROUP BY ALL),
  np AS (SELECT t, class, count(*) AS n FROM preds, ts WHERE confidence > t GROUP BY ALL),
  ng AS (SELECT class, count(*) AS n FROM truths GROUP BY ALL),
  per AS (SELECT t, c.class, coalesce(tp, 0) AS tp, coalesce(np.n, 0) AS n_pred, coalesce(ng.n, 0) AS n_gt FROM ts CROSS JOIN (SELECT unnest({_NAMES}) AS class) c LEFT JOIN tps USING (t, class) LEFT JOIN np USING (t, class) LEFT JOIN ng USING (class)),
  every AS (SELECT * FROM per UNION ALL SELECT t, 'all', sum(tp), sum(n_pred), sum(n_gt) FROM per GROUP BY t),
  rejects AS (SELECT t, count(DISTINCT image) FILTER (confidence > t) AS n FROM ts, preds WHERE image NOT IN (SELECT image FROM truths) GROUP BY t)
SELECT t AS threshold, class AS class_name, round(CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END, 9) AS precision, round(CASE WHEN n_gt = 0 THEN 0 ELSE tp / n_gt END, 9) AS recall,
  (n_pred - tp)::BIGINT AS false_positives, (n_gt - tp)::BIGINT AS false_negatives, CASE WHEN class = 'all' THEN rejects.n END AS false_rejects, '' AS note FROM every LEFT JOIN rejects USING (t)"""


@query(_SWEEP)
def threshold_sweep(spark, sf_dir):
    out = matching.sweep(lenses.matching_images(spark, sf_dir))
    return out.withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


# ---- pairing, counts, reconciliation ----


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unlabelled_docs(spark, sf_dir):
    return validation.unpaired(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_labels(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return validation.unpaired(table(spark, sf_dir, "orders").select("o_orderkey"), items, ["o_orderkey"])


@query("SELECT doc_id, source FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def split_eligible(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return validation.paired(table(spark, sf_dir, "documents").select("doc_id", "source"), good, ["doc_id"])


@query(f"WITH {_BOXES} SELECT i::INT AS class_id, {_name('i')} AS class_name, (SELECT count(*) FROM boxes WHERE class_id = i) AS n_annotations FROM range(7) r(i)")
def class_counts_zero_filled(spark, sf_dir):
    return validation.class_counts(lenses.label_boxes(spark, sf_dir).select("class_id"))


@query(f"SELECT i::INT AS class_id, {_name('i')} AS class_name FROM range(7) r(i) WHERE i NOT IN (SELECT s_suppkey % 5 FROM supplier)")
def class_warnings(spark, sf_dir):
    return validation.class_warnings(table(spark, sf_dir, "supplier").select(F.pmod("s_suppkey", F.lit(5)).alias("class_id")))


def _manifest(supplier: DataFrame) -> DataFrame:
    """A copy of the plan with missing, changed and extra rows."""
    changed = supplier.where("s_suppkey % 10 <> 3").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 10 == 4, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return changed.union(supplier.where("s_suppkey % 10 = 5").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000))


@query("""WITH m AS (SELECT * REPLACE (CASE WHEN s_suppkey % 10 = 4 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal) FROM supplier WHERE s_suppkey % 10 <> 3
  UNION ALL SELECT * REPLACE (s_suppkey + 1000000 AS s_suppkey) FROM supplier WHERE s_suppkey % 10 = 5)
SELECT s_suppkey, 'missing' AS kind, '' AS fields FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM m)
UNION ALL SELECT s_suppkey, 'extra', '' FROM m WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT p.s_suppkey, 'changed', 's_acctbal' FROM supplier p JOIN m USING (s_suppkey) WHERE p.s_acctbal IS DISTINCT FROM m.s_acctbal""")
def manifest_diff(spark, sf_dir):
    plan = table(spark, sf_dir, "supplier")
    return validation.manifest_difference(plan, _manifest(plan), "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"])


@query("SELECT l_partkey AS seed, count(DISTINCT l_suppkey % 3) AS n_splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 3) > 1")
def seed_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("seed"), F.pmod("l_suppkey", F.lit(3)).alias("split"))
    return validation.seed_overlap(rows)


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'N'")
def split_set_operations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    of = lambda c: li.where(c).select("l_suppkey")
    return of("l_returnflag = 'A'").intersect(of("l_returnflag = 'R'")).subtract(of("l_quantity > 49 and l_returnflag = 'N'"))


# ---- reports ----


@query(f"SELECT {_name('p_partkey % 7')} AS class_name, max(p_size) AS area, arg_min(p_partkey, struct_pack(a := -p_size, s := p_partkey)) AS seed FROM part GROUP BY 1")
def argmax_per_class(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(naming.class_name(F.pmod("p_partkey", F.lit(7)), CLASS_NAMES).alias("class_name"), F.col("p_size").alias("area"), F.col("p_partkey").alias("seed"))
    return rollup.largest_per_class(p)


_PIVOT = ", ".join(f"count(*) FILTER (c_custkey % 3 = {i}) AS {s}" for i, s in enumerate(SPLITS))


@query(f"SELECT c_mktsegment AS class_name, {_PIVOT} FROM customer GROUP BY 1")
def class_split_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("class_name"), F.element_at(F.array(*map(F.lit, SPLITS)), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int")).alias("split"))
    return rollup.class_split_counts(rows, SPLITS)


_QUALITY = """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') AND p_size % 2 = 0 THEN 'screenshot_or_diagram' WHEN p_size % 11 = 0 THEN 'unreadable' WHEN p_size % 13 = 0 THEN 'corrupt'
  WHEN least(p_size * 20, p_retailprice::INT) < 96 THEN 'too_small' WHEN greatest(p_size * 20, p_retailprice::INT) / greatest(1, least(p_size * 20, p_retailprice::INT)) > 6 THEN 'extreme_aspect'
  WHEN p_partkey % 100 / 100 > 0.92 AND p_size % 50 / 1000 < 0.015 THEN 'screenshot_or_diagram' ELSE 'ok' END AS status FROM part"""


def _quality(spark, sf_dir):
    name = F.when(F.contains(F.lower("p_name"), F.lit("ring")) & (F.col("p_size") % 2 == 0), F.lit("Slide_1.png")).otherwise(F.lit("photo.jpg"))
    rule = quality.status(name, F.col("p_size") % 11 != 0, F.col("p_size") % 13 != 0, F.col("p_size") * 20, F.rint("p_retailprice").cast("int"), F.col("p_partkey") % 100 / 100, F.col("p_size") % 50 / 1000)
    return table(spark, sf_dir, "part").select("p_partkey", rule.alias("status"))


@query(_QUALITY)
def file_quality_case(spark, sf_dir):
    return _quality(spark, sf_dir)


@query(f"SELECT status, count(*) AS n FROM ({_QUALITY}) GROUP BY 1")
def quality_histogram(spark, sf_dir):
    return quality.histogram(_quality(spark, sf_dir))


@query("""WITH named AS (SELECT page_id, url_decode(regexp_extract(url, '^[^?]*')) AS path FROM pages)
SELECT page_id, left(coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(rtrim(path, '/'), '[^/]*$'), '\\.[A-Za-z0-9]{1,5}$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'image'), 80) AS slug FROM named""")
def url_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", naming.url_slug(F.col("url")).alias("slug"))


# ---- duplicates ----


@query("SELECT sha256(text) AS sha256, count(*) AS n_members, array_to_string(list_sort(list(doc_id)), ',') AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), hashing.sha256(F.col("text").cast("binary")).alias("sha256"))
    return dedup.duplicate_groups(d).withColumn("members", F.array_join("members", ","))


@query("SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS is_first FROM documents")
def dedup_exact_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", hashing.sha256(F.col("text").cast("binary")).alias("sha256"))
    return dedup.first_of_digest(d, "doc_id").select("doc_id", "is_first")


@query(f"WITH {_FILES} SELECT id, lower(lpad(to_hex(dhash), 16, '0')) AS dhash FROM files")
def text_dhash(spark, sf_dir):
    return lenses.files(spark, sf_dir).select("id", hashing.hex16(F.col("dhash")).alias("dhash"))


_NEAR = "near AS (SELECT a.id AS a, b.id AS b FROM files a JOIN files b ON a.id < b.id AND bit_count(xor(a.dhash, b.dhash)::BIT) <= 6)"


_PAIRS = f"""{_FILES}, held AS (SELECT dhash, min(id) AS r, count(*) AS n FROM files GROUP BY 1),
  pairs AS (SELECT a.r AS a, b.r AS b, bit_count(xor(a.dhash, b.dhash)::BIT)::INT AS distance, a.n AS n_a, b.n AS n_b FROM held a JOIN held b ON a.r < b.r AND bit_count(xor(a.dhash, b.dhash)::BIT) <= 6)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def near_dup_pairs(spark, sf_dir):
    """Pairs of classes of equal hashes, by their representatives."""
    return dedup.near_pairs(lenses.files(spark, sf_dir))


@query(f"""WITH {_PAIRS}, linked AS (SELECT r, sum(n)::BIGINT AS n FROM (SELECT a AS r, n_b AS n FROM pairs UNION ALL SELECT b, n_a FROM pairs) GROUP BY 1)
SELECT id, r AS representative, held.n - 1 + coalesce(linked.n, 0) AS n_links FROM files JOIN held USING (dhash) LEFT JOIN linked USING (r)""")
def near_dup_members(spark, sf_dir):
    """The class of every document, and how many others are near it."""
    return dedup.near_members(lenses.files(spark, sf_dir))


@query(f"""WITH {_FILES}, held AS (SELECT dhash, split, min(id) AS r, count(*) AS n FROM files GROUP BY ALL)
SELECT a.r AS a, b.r AS b, bit_count(xor(a.dhash, b.dhash)::BIT)::INT AS distance, a.split AS split_a, b.split AS split_b, a.n AS n_a, b.n AS n_b
FROM held a JOIN held b ON a.r < b.r AND a.split <> b.split AND bit_count(xor(a.dhash, b.dhash)::BIT) <= 6""")
def cross_split_leakage(spark, sf_dir):
    return dedup.cross_split_leaks(lenses.files(spark, sf_dir))


_COMPONENTS = f"""{_FILES}, {_NEAR}, ways AS (SELECT a AS u, b AS v FROM near UNION SELECT b, a FROM near UNION SELECT id, id FROM files),
  reach AS (SELECT id AS node, id AS r FROM files UNION SELECT ways.v, reach.r FROM reach JOIN ways ON ways.u = reach.node),
  clusters AS (SELECT node AS id, min(r) AS cluster FROM reach GROUP BY 1)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT * FROM clusters")
def dup_components(spark, sf_dir):
    return splits.near_clusters(lenses.files(spark, sf_dir))


_CUT = "CASE WHEN rn <= train THEN 'train' WHEN rn <= train + val THEN 'val' ELSE 'test' END AS split"


@query(f"""WITH RECURSIVE {_COMPONENTS}, names AS (SELECT DISTINCT cluster FROM clusters),
  ranked AS (SELECT cluster, row_number() OVER (ORDER BY sha256('42:' || cluster), cluster) AS rn, count(*) OVER () AS n FROM names),
  shares AS (SELECT n, floor(n * 0.7) AS t0, floor(n * 0.15) AS v0, n * 0.7 - floor(n * 0.7) AS tf, n * 0.15 - floor(n * 0.15) AS vf FROM ranked LIMIT 1),
  rest AS (SELECT *, n - t0 - 2 * v0 AS spare FROM shares),
  sized AS (SELECT t0 + (CASE WHEN spare > (CASE WHEN vf > tf THEN 2 ELSE 0 END) THEN 1 ELSE 0 END) AS train, v0 + (CASE WHEN spare > (CASE WHEN tf >= vf THEN 1 ELSE 0 END) THEN 1 ELSE 0 END) AS val FROM rest)
SELECT id, c.cluster, {_CUT} FROM clusters c JOIN ranked USING (cluster), sized""")
def cluster_split(spark, sf_dir):
    return splits.cluster_split(splits.near_clusters(lenses.files(spark, sf_dir))).select("id", "cluster", "split")


@query(f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('42:' || c_custkey), c_custkey) AS rn, count(*) OVER () * 70 // 100 AS train, count(*) OVER () * 15 // 100 AS val FROM customer) SELECT c_custkey, {_CUT} FROM r")
def plain_split(spark, sf_dir):
    return splits.plain_split(table(spark, sf_dir, "customer"), "c_custkey")


@query(f"WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:' || c_custkey), c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) * 70 // 100 AS train, count(*) OVER (PARTITION BY c_mktsegment) * 15 // 100 AS val FROM customer) SELECT c_custkey, c_mktsegment, {_CUT} FROM r")
def stratified_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")


@query(f"""WITH RECURSIVE {_FILES}, edges AS MATERIALIZED (
    SELECT a.id AS src, b.id AS dst, CASE WHEN a.sha256 = b.sha256 THEN 0 ELSE 1 END AS kind FROM files a JOIN files b ON a.id < b.id AND (a.sha256 = b.sha256 OR bit_count(xor(a.dhash, b.dhash)::BIT) <= 6)),
  befores AS MATERIALIZED (SELECT dst, list(src) AS srcs FROM edges GROUP BY 1),
  numbered AS MATERIALIZED (SELECT id, coalesce(srcs, []) AS srcs, row_number() OVER (ORDER BY id) AS k FROM files LEFT JOIN befores ON dst = id),
  scan AS (
    SELECT 0::BIGINT AS k, []::BIGINT[] AS kept
    UNION ALL
    SELECT n.k, CASE WHEN len(n.srcs) > 0 AND list_has_any(s.kept, n.srcs) THEN s.kept ELSE list_append(s.kept, n.id) END FROM scan s JOIN numbered n ON n.k = s.k + 1),
  winners AS (SELECT unnest(arg_max(kept, k)) AS id FROM scan),
  matched AS (SELECT dst, arg_min(struct_pack(kind := kind, src := src), struct_pack(kind := kind, src := src)) AS m FROM edges WHERE src IN (SELECT id FROM winners) GROUP BY 1)
SELECT f.id, CASE WHEN w.id IS NOT NULL THEN 'ok' WHEN m.kind = 0 THEN 'duplicate_sha256' ELSE 'near_duplicate' END AS verdict, CASE WHEN w.id IS NULL THEN m.src END AS match
FROM files f LEFT JOIN winners w ON w.id = f.id LEFT JOIN matched ON dst = f.id""")
def dedup_greedy(spark, sf_dir):
    return dedup.greedy(lenses.files(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 2 AS u, l_partkey * 2 + 1 AS v FROM lineitem), b AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
  r(node, root) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM b GROUP BY 1
    UNION SELECT n.node, n.root FROM (SELECT b.v AS node, min(r.root) AS root FROM r JOIN b ON b.u = r.node GROUP BY 1) n JOIN recurring.r AS o ON o.node = n.node WHERE n.root < o.root)
SELECT node, root FROM r""")
def connected_components(spark, sf_dir):
    """Orders (even nodes) and parts (odd nodes) connected by all line items."""
    return graph.components(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


# ---- metrics, small conversions, streams ----


@query(f"""WITH h AS (SELECT {_name('l_partkey % 7')} AS class_name, round(l_discount * 100)::INT / 100 AS confidence, (l_quantity > 20)::INT AS tp FROM lineitem),
  g AS (SELECT class_name, confidence, sum(tp) AS tp, count(*) AS n FROM h GROUP BY ALL),
  c AS (SELECT *, sum(tp) OVER (PARTITION BY class_name ORDER BY confidence DESC) / sum(n) OVER (PARTITION BY class_name ORDER BY confidence DESC) AS p FROM g),
  b AS (SELECT *, max(p) OVER (PARTITION BY class_name ORDER BY confidence) AS best FROM c)
SELECT class_name, round(sum(best * tp) / (2 * sum(tp)), 6) AS average_precision FROM b GROUP BY 1""")
def average_precision(spark, sf_dir):
    """Average precision where half of the truths are found."""
    li = table(spark, sf_dir, "lineitem")
    hits = li.select(naming.class_name(F.pmod("l_partkey", F.lit(7)), CLASS_NAMES).alias("class_name"), (F.round(F.col("l_discount") * 100) / 100).alias("confidence"), (F.col("l_quantity") > 20).cast("int").alias("tp"))
    return matching.average_precision(hits, hits.groupBy("class_name").agg((2 * F.sum("tp")).alias("n")))


@query("SELECT s_nationkey, round(coalesce(2 * avg(p) * avg(r) / nullif(avg(p) + avg(r), 0), 0), 9) AS f1 FROM (SELECT s_nationkey, (s_suppkey % 10) / 10 AS p, (s_suppkey % 7) / 7 AS r FROM supplier) GROUP BY 1")
def f1_of_means(spark, sf_dir):
    """F1 of mean precision and mean recall."""
    means = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg(F.col("s_suppkey") % 10 / 10).alias("p"), F.avg(F.col("s_suppkey") % 7 / 7).alias("r"))
    return means.select("s_nationkey", F.round(rollup.harmonic_f1(F.col("p"), F.col("r")), 9).alias("f1"))


@query("SELECT round(avg(abs(l_discount - l_tax)), 9) AS mean_abs, max(abs(l_discount - l_tax)) AS max_abs, round(count(*) FILTER (l_discount <> l_tax) / count(*), 9) AS changed FROM lineitem")
def difference_statistics(spark, sf_dir):
    out = rollup.difference_statistics(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax")
    return out.select(F.round("mean_abs", 9).alias("mean_abs"), "max_abs", F.round("changed", 9).alias("changed"))


@query("SELECT p_partkey, 42 * 1000003 + p_partkey % 7 * 100000 + p_size AS seed FROM part")
def image_seeds(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", naming.image_seed(42, F.pmod("p_partkey", F.lit(7)), F.col("p_size")).alias("seed"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey % 7)), ',') AS class_ids, len(list(DISTINCT l_partkey % 7)) AS n FROM lineitem GROUP BY 1")
def class_id_lists(spark, sf_dir):
    """Class ids as the comma list of a manifest, read back for their number."""
    ids = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.pmod("l_partkey", F.lit(7)))).alias("ids"))
    return ids.select("l_orderkey", naming.ints_to_text(F.col("ids")).alias("class_ids")).withColumn("n", F.size(naming.text_to_ints(F.col("class_ids"))).cast("bigint"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS total_inspections, count(*) FILTER (event_type <> 'error') AS passes, count(*) FILTER (event_type = 'error') AS fails, round(sum(value), 4) AS total_inference_ms FROM events GROUP BY 1")
def streaming_hourly(spark, sf_dir):
    """The hourly rollup as a stream over everything there is, its result kept in the shared folder."""
    import uuid

    from ..storage import checkpoint_dir
    from ..streaming import hourly

    at = f"{checkpoint_dir(spark)}/hourly-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet*"  # as a pattern it may be one file or a folder
    events = hourly.read(spark, path, table(spark, sf_dir, "events").schema).select(F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("overall_result"), F.col("value").alias("inference_ms"))
    rolled = hourly.hourly_rollup(events)
    writer = rolled.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out"))
    writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(rolled.schema).parquet(f"{at}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "total_inspections", "passes", "fails", F.round("total_inference_ms", 4).alias("total_inference_ms"))


# ---- whole reports ----


@query("""WITH b AS (SELECT l_orderkey, min(l_partkey % 960) AS x1, min(l_suppkey % 640) AS y1, max(l_partkey % 960) + 1 AS x2, max(l_suppkey % 640) + 1 AS y2 FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
SELECT l_orderkey, round((x1 + x2) / 2 / 960, 9) AS cx, round((y1 + y2) / 2 / 640, 9) AS cy, round((x2 - x1) / 960, 9) AS w, round((y2 - y1) / 640, 9) AS h FROM b""")
def mask_boxes(spark, sf_dir):
    """Boxes around the pixels of masks of three pixels at least."""
    px = table(spark, sf_dir, "lineitem").select("l_orderkey", F.pmod("l_partkey", F.lit(960)).alias("x"), F.pmod("l_suppkey", F.lit(640)).alias("y"))
    b = px.groupBy("l_orderkey").agg(*geometry.mask_bounds(), F.count(F.lit(1)).alias("n")).where("n >= 3").select("l_orderkey", geometry.bounds_to_box(960, 640).alias("b"))
    return b.select("l_orderkey", *(F.round(f"b.{c}", 9).alias(c) for c in ("cx", "cy", "w", "h")))


@query("""WITH c AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'timeout' END AS error, ['image/jpeg', 'image/png', 'text/html', 'image/webp', 'image/gif'][1 + page_id % 5] AS mime, page_id % 7 <> 0 AS decoded, length(html) AS width, length(url) * 4 AS height FROM pages)
SELECT page_id, CASE WHEN error IS NOT NULL THEN 'fetch_error' WHEN mime NOT IN ('image/jpeg', 'image/jpg', 'image/png', 'image/webp', 'image/bmp', 'image/tiff') THEN 'rejected_mime' WHEN NOT decoded THEN 'corrupt' WHEN least(width, height) < 96 THEN 'too_small' ELSE 'ok' END AS status FROM c""")
def collection_rules(spark, sf_dir):
    """The stateless rules of collecting, with content types in several spellings."""
    kinds = F.array(*map(F.lit, ["image/jpeg", "IMAGE/PNG; q=1", "text/html", "image/webp;x", "image/gif"]))
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 13 == 0, "timeout").alias("error"),
        F.element_at(kinds, (F.pmod("page_id", F.lit(5)) + 1).cast("int")).alias("mime"),
        (F.col("page_id") % 7 != 0).alias("decoded"),
        F.char_length("html").alias("width"),
        (F.char_length("url") * 4).alias("height"),
    )
    return quality.collected(pages).select("page_id", "status")


@query(f"""WITH {_BOXES} SELECT 'folder' AS section, source AS name, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'class', name, (SELECT count(*) FROM boxes WHERE coalesce({_NAMES}[class_id + 1], class_id::VARCHAR) = name) FROM (SELECT unnest({_NAMES}) AS name UNION SELECT DISTINCT coalesce({_NAMES}[class_id + 1], class_id::VARCHAR) FROM boxes)
UNION ALL SELECT 'split', ['train', 'val', 'test'][1 + doc_id % 3], count(*) FROM documents GROUP BY 2""".replace("[class_id + 1]", "[CASE WHEN class_id BETWEEN 0 AND 6 THEN class_id + 1 ELSE 99 END]"))
def dataset_statistics(spark, sf_dir):
    """Images per folder, annotations per class (also of unknown ids) and rows per split."""
    from .inspect import dataset_statistics as report

    docs = table(spark, sf_dir, "documents")
    folders = docs.groupBy(F.col("source").alias("parent")).agg(F.count(F.lit(1)).alias("n_images"))
    manifest = docs.select(F.element_at(F.array(*map(F.lit, SPLITS)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("split"))
    return report(folders, lenses.label_boxes(spark, sf_dir), manifest)


_VALIDATION_PARTS = f"""WITH {_BOXES}, {_FILES},
  images AS (SELECT id, split, 'd' || id AS stem, 'd' || id || '.png' AS filename, split || '/d' || id || '.png' AS name, sha256, dhash, CASE WHEN id % 17 = 0 THEN 'corrupt' WHEN id % 19 = 0 THEN 'too_small' ELSE 'ok' END AS status FROM files),
  marked AS (SELECT doc_id, ['train', 'val', 'test'][1 + doc_id % 3] AS split, 'd' || doc_id AS stem, quality = 1 AS valid FROM labels UNION ALL SELECT s_suppkey, 'val', 's' || s_suppkey, true FROM supplier WHERE s_suppkey < 5),
  sound AS (SELECT images.* FROM images SEMI JOIN (SELECT * FROM marked WHERE valid) m ON m.split = images.split AND m.stem = images.stem),
  held AS (SELECT dhash, split, min(name) AS name, count(*) AS n FROM sound WHERE status = 'ok' GROUP BY ALL),
  lab AS (SELECT * FROM boxes WHERE l_orderkey IN (SELECT id FROM sound)),
  broken AS ({" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{n}' AS rule FROM lab WHERE {c}" for n, c in _RULES.items())})"""
_VALIDATION = f"""{_VALIDATION_PARTS}
SELECT 1 AS ordinal, 'label_without_image' AS rule, split, stem AS key, stem || '.txt has no image' AS message FROM marked WHERE stem NOT IN (SELECT stem FROM images)
UNION ALL SELECT 2, 'image_without_label', split, stem, filename || ' has no label file' FROM images WHERE stem NOT IN (SELECT stem FROM marked)
UNION ALL SELECT 3, 'label_unparsable', split, stem, 'label file cannot be parsed' FROM marked WHERE NOT valid AND stem IN (SELECT stem FROM images)
UNION ALL SELECT 4, 'label_geometry', ['train', 'val', 'test'][1 + l_orderkey % 3], 'd' || l_orderkey, 'box ' || l_linenumber || ': ' || rule FROM broken
UNION ALL SELECT 5, 'image_quality', split, stem, status FROM sound WHERE status <> 'ok'
UNION ALL SELECT 6, 'duplicate_sha256', '', substr(sha256, 1, 12), array_to_string(list_sort(list(name)), ', ') FROM sound GROUP BY sha256 HAVING count(*) > 1
UNION ALL SELECT 7, 'near_duplicate_leakage', '', a.name, 'and ' || b.name || ' differ by ' || bit_count(xor(a.dhash, b.dhash)::BIT) || ' bits' || CASE WHEN a.n + b.n > 2 THEN ' (' || a.n || ' and ' || b.n || ' files)' ELSE '' END
  FROM held a JOIN held b ON a.name < b.name AND a.split <> b.split AND bit_count(xor(a.dhash, b.dhash)::BIT) <= 6"""


@query(_VALIDATION)
def dataset_validation(spark, sf_dir):
    """Every violation of a data set: documents as images, their labels as label files, line items as boxes."""
    return validation.validate(*validation_tables(spark, sf_dir))


def validation_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, label files and boxes; some pictures are corrupt or too small."""
    stem = F.concat(F.lit("d"), F.col("id").cast("string"))
    status = F.when(F.col("id") % 17 == 0, "corrupt").when(F.col("id") % 19 == 0, "too_small").otherwise("ok")
    images = lenses.files(spark, sf_dir).withColumn("stem", stem).withColumn("filename", F.concat("stem", F.lit(".png"))).withColumn("status", status)
    split_of = F.element_at(F.array(*map(F.lit, SPLITS)), (F.pmod("k", F.lit(3)) + 1).cast("int"))
    named = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), (F.col("quality") == 1).alias("valid"))
    marked = named.select(split_of.alias("split"), F.concat(F.lit("d"), F.col("k").cast("string")).alias("stem"), "valid")
    extra = table(spark, sf_dir, "supplier").where("s_suppkey < 5").select(F.lit("val").alias("split"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("stem"), F.lit(True).alias("valid"))
    rows = lenses.label_boxes(spark, sf_dir).withColumn("k", F.col("l_orderkey"))
    boxes = rows.select(split_of.alias("split"), F.concat(F.lit("d"), F.col("k").cast("string")).alias("stem"), F.col("l_linenumber").alias("line_no"), "class_id", "cx", "cy", "w", "h")
    return images, marked.union(extra), boxes


from . import checks, collecting, judging  # noqa: E402, F401  register more queries
