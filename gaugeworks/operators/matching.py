"""Matching of predicted to true boxes and the confidence sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import array_iou
from ..schemas import CLASS_NAMES
from ..storage import Written
from .ordered import accumulated
from .suppress import by_confidence

LEAST_IOU = 0.5
# Fixed value: the note of a sweep without confirmed good images.
NO_GOOD_IMAGES = "false reject not estimable: no confirmed-good images in this file"
THRESHOLDS = [round(i / 10, 1) for i in range(1, 10)]


def matched(gt: Column, pred: Column) -> Column:
    """How many truths find a prediction: each in order takes the unused one of its class with the largest IoU of at least 0.5, the later of equal ones.

    A fold with the used indices as state, so it stays in the JVM and in one row.
    """
    indices = F.sequence(F.lit(0), F.size(pred) - 1)
    none = F.array().cast("array<int>")

    def take(used: Column, truth: Column) -> Column:
        def better(best: Column, i: Column) -> Column:
            p = F.get(pred, i)
            score = array_iou(truth["bbox"], p["bbox"])
            fits = ~F.array_contains(used, i) & (p["class"] == truth["class"]) & (score >= best["iou"])
            return F.when(fits, F.struct(score.alias("iou"), i.alias("at"))).otherwise(best)

        start = F.struct(F.lit(LEAST_IOU).alias("iou"), F.lit(-1).alias("at"))
        best = F.aggregate(indices, start, better)
        return F.when(best["at"] < 0, used).otherwise(F.concat(used, F.array(best["at"])))

    return F.when((F.size(gt) > 0) & (F.size(pred) > 0), F.size(F.aggregate(gt, none, take))).otherwise(F.lit(0))


def candidates(gt: Column, pred: Column) -> Column:
    """The truths that overlap a prediction of their class enough, in order: struct(class, options array<struct(iou, at, confidence)>)."""

    def options(g: Column) -> Column:
        scored = F.transform(pred, lambda p, i: F.struct(F.when(p["class"] == g["class"], array_iou(g["bbox"], p["bbox"])).alias("iou"), i.alias("at"), p["confidence"].alias("confidence")))
        return F.struct(g["class"].alias("class"), F.filter(scored, lambda o: o["iou"] >= LEAST_IOU).alias("options"))

    return F.filter(F.transform(gt, options), lambda c: F.size(c["options"]) > 0)


def matched_classes(found: Column, threshold: float) -> Column:
    """Class of each truth that finds a prediction over the threshold: each in order takes its unused option of the largest IoU, the later of equal ones."""

    def take(state: Column, c: Column) -> Column:
        free = F.filter(c["options"], lambda o: (o["confidence"] > threshold) & ~F.isnan(o["confidence"]) & ~F.array_contains(state["used"], o["at"]))
        best = F.array_max(free)
        return F.when(best.isNull(), state).otherwise(F.struct(F.concat(state["used"], F.array(best["at"])).alias("used"), F.concat(state["classes"], F.array(c["class"])).alias("classes")))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("classes"))
    return F.aggregate(found, start, take)["classes"]


def sweep(images: DataFrame, thresholds: list[float] = THRESHOLDS, classes: list[str] = CLASS_NAMES) -> DataFrame:
    """Precision, recall and errors for each threshold and group (all and every class), zero-filled, with a note.

    images: gt array<struct<class,bbox>>, pred array<struct<class,confidence,bbox>>. Overlaps
    are computed once for each image, and only images that have any are matched at each
    threshold. Matching never crosses classes, so the row of all classes is a sum; boxes of
    classes outside the list count in it only. What is shuffled is one count for each class,
    kind and level (how many thresholds a confidence is over).
    """
    thresholds = sorted(thresholds)
    none_gt, none_pred = F.array().cast("array<struct<class:string,bbox:array<double>>>"), F.array().cast("array<struct<class:string,confidence:double,bbox:array<double>>>")
    base = images.select(F.coalesce("gt", none_gt).alias("gt"), F.coalesce("pred", none_pred).alias("pred")).withColumn("found", candidates(F.col("gt"), F.col("pred")))

    def entry(kind: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("class"), value.cast("double").alias("value"))

    top = F.array_max(F.transform(F.filter("pred", lambda p: ~F.isnan(p["confidence"])), lambda p: p["confidence"]))

    def hits(t: float) -> Column:
        return F.transform(matched_classes(F.col("found"), t), lambda c: entry("tp", c, F.lit(t)))

    no_entries = F.array().cast("array<struct<kind:string,class:string,value:double>>")
    rows = base.select(
        F.explode(
            F.concat(
                F.transform("gt", lambda g: entry("gt", g["class"], F.lit(None))),
                F.transform("pred", lambda p: entry("pred", p["class"], p["confidence"])),
                F.when(F.size("gt") == 0, F.array(entry("good", F.lit(None), top))).otherwise(no_entries),
                F.when(F.size("found") > 0, F.concat(*map(hits, thresholds))).otherwise(no_entries),
            )
        ).alias("e")
    ).select("e.*")
    over = [F.when((F.col("value") > t) & ~F.isnan("value"), 1).otherwise(0) for t in thresholds]
    level = F.when(F.col("kind") == "tp", F.col("value")).otherwise(sum(over[1:], over[0]).cast("double"))
    counts = rows.select("kind", F.col("class"), level.alias("level")).groupBy("kind", "class", "level").agg(F.count(F.lit(1)).alias("n"))
    spark = images.sparkSession
    steps = spark.createDataFrame(list(enumerate(thresholds)), "k int, threshold double")
    # a hit counts at its own threshold, a box at all thresholds that it is over; a row of counts for each class, kind and level
    at = counts.join(F.broadcast(steps), F.when(F.col("kind") == "tp", F.col("level") == F.col("threshold")).otherwise((F.col("level") > F.col("k")) | F.col("kind").isin("gt", "good")))
    fits = F.col("level") > F.col("k")
    n = lambda kind, c=F.lit(True): F.sum(F.when((F.col("kind") == kind) & c, F.col("n")).otherwise(0))
    named = at.withColumn("class_name", F.explode(F.when(F.col("class").isin(classes), F.array("class", F.lit("all"))).otherwise(F.array(F.lit("all")))))
    sums = named.groupBy("threshold", "class_name").agg(n("tp").alias("tp"), n("pred").alias("n_pred"), n("gt").alias("n_gt"), n("good").alias("good"), n("good", fits).alias("rejected"))
    grid = spark.createDataFrame([(t, c) for t in thresholds for c in ["all", *classes]], "threshold double, class_name string")
    filled = grid.join(F.broadcast(sums), ["threshold", "class_name"], "left").na.fill(0)  # one row for each cell of the grid
    return filled.select(
        "threshold",
        "class_name",
        F.coalesce(F.try_divide("tp", "n_pred"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "n_gt"), F.lit(0.0)).alias("recall"),
        (F.col("n_pred") - F.col("tp")).alias("false_positives"),
        (F.col("n_gt") - F.col("tp")).alias("false_negatives"),
        F.when((F.col("class_name") == "all") & (F.col("good") > 0), F.col("rejected")).alias("false_rejects"),
        F.when((F.col("class_name") == "all") & (F.col("good") == 0), F.lit(NO_GOOD_IMAGES)).otherwise(F.lit("")).alias("note"),
    )


def average_precision(hits: DataFrame, truths: DataFrame, group: str = "class_name", confidence: str = "confidence", hit: str = "tp") -> DataFrame:
    """Interpolated average precision of each group: hits has group, confidence and tp (0 or 1), truths group and n.

    Equal confidences are one step of the curve, so hits are summed by group and confidence
    before they are ranked, and a group is no more rows than it has distinct confidences.
    """
    steps = hits.groupBy(group, confidence).agg(F.sum(hit).alias("tp"), F.count(F.lit(1)).alias("n"))
    down = accumulated(steps, group, [F.col(confidence).desc()], F.sum, ["tp", "n"], ["tp_so_far", "n_so_far"])
    curve = down.select(group, confidence, "tp", (F.col("tp_so_far") / F.col("n_so_far")).alias("p"))
    best = accumulated(curve, group, [F.col(confidence)], F.max, ["p"], ["best"])
    area = best.groupBy(group).agg(F.sum(F.col("best") * F.col("tp")).alias("area"))
    return truths.join(area, group, "left").select(group, F.round(F.coalesce(F.try_divide("area", "n"), F.lit(0.0)), 6).alias("average_precision"))


#: Overlaps at which detections are judged.
LEVELS = [(50 + 5 * k) / 100 for k in range(10)]


def level_hits(gt: Column, pred: Column, levels: list[float] = LEVELS) -> Column:
    """struct(class, confidence, hits) of each prediction in falling confidence; bit k of hits: it finds a truth at the k-th level.

    At each level a prediction takes the truth of its class of the largest overlap, of equal
    ones the first, that no surer prediction took at that level. All levels are one pass: the
    state of the fold is what is taken at each.
    """

    truths = F.filter(F.transform(gt, lambda g, i: F.struct(g["class"].alias("class"), g["bbox"].alias("bbox"), (-i).alias("at"))), lambda g: g["class"].isNotNull())
    named = F.array_distinct(F.transform(truths, lambda g: g["class"]))
    by_class = F.map_from_entries(F.transform(named, lambda c: F.struct(c, F.filter(truths, lambda g: g["class"] == c))))

    def options(p: Column, of: Column) -> Column:
        scored = F.transform(F.try_element_at(of, p["class"]), lambda g: F.struct(array_iou(g["bbox"], p["bbox"]).alias("iou"), g["at"].alias("at")))
        return F.struct(p["class"].alias("class"), p["confidence"].alias("confidence"), F.filter(scored, lambda o: o["iou"] >= min(levels)).alias("options"))

    limits, bits = F.array(*map(F.lit, levels)), F.array(*(F.lit(1 << k) for k in range(len(levels))))

    def take(state: Column, p: Column) -> Column:
        best = F.zip_with(state["taken"], limits, lambda t, least: F.array_max(F.filter(p["options"], lambda o: (o["iou"] >= least) & ~F.array_contains(t, o["at"]))))

        def marked(picks: Column) -> Column:
            taken = F.zip_with(state["taken"], picks, lambda t, x: F.when(x.isNull(), t).otherwise(F.concat(t, F.array(x["at"]))))
            hits = F.aggregate(F.zip_with(picks, bits, lambda x, b: F.when(x.isNull(), 0).otherwise(b)), F.lit(0), lambda s, v: s + v)
            return F.struct(taken.alias("taken"), F.concat(state["out"], F.array(F.struct(p["class"].alias("class"), p["confidence"].alias("confidence"), hits.alias("hits")))).alias("out"))

        return F.get(F.transform(F.array(best), marked), F.lit(0))  # so that the picks are worked out once

    start = F.struct(
        F.array_repeat(F.array().cast("array<int>"), len(levels)).alias("taken"),
        F.array().cast("array<struct<class:string,confidence:double,hits:int>>").alias("out"),
    )
    # a prediction looks at the truths of its class only, which are put together once
    optional = F.get(F.transform(F.array(by_class), lambda of: F.transform(by_confidence(pred), lambda p: options(p, of))), F.lit(0))
    return F.aggregate(optional, start, take)["out"]


def detection_metrics(images: DataFrame, levels: list[float] = LEVELS) -> DataFrame:
    """class_name, n_truths, precision, recall, ap50 and ap50_95 of each class that has truths, and the mean of all classes as the class "all".

    images: gt array<struct<class,bbox>>, pred array<struct<class,confidence,bbox>>. The first
    level gives ap50 and, where F1 is best (of equal ones at the highest confidence),
    precision and recall; ap50_95 is the mean over the levels. An average precision is the
    mean of the best precision at a recall of at least 0, 0.01 ... 1. Hits of one class and
    confidence are one step of the curves, so what is shuffled and ranked is a row for each of
    these; sums of decimals are the same in any order.
    """
    none_gt, none_pred = F.array().cast("array<struct<class:string,bbox:array<double>>>"), F.array().cast("array<struct<class:string,confidence:double,bbox:array<double>>>")
    base = images.select(F.coalesce("gt", none_gt).alias("gt"), F.coalesce("pred", none_pred).alias("pred"))
    truths = base.select(F.explode("gt.class").alias("class_name")).groupBy("class_name").agg(F.count(F.lit(1)).alias("n_truths"))
    hits = base.select(F.explode(level_hits(F.col("gt"), F.col("pred"), levels)).alias("h")).select(F.col("h.class").alias("class_name"), "h.confidence", "h.hits")
    t, all_t, best = ([f"{x}{k}" for k in range(len(levels))] for x in ("t", "all_t", "best"))
    steps = hits.groupBy("class_name", "confidence").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.getbit("hits", F.lit(k)).cast("long")).alias(c) for k, c in enumerate(t)))
    down = accumulated(steps, "class_name", [F.col("confidence").desc()], F.sum, ["n", *t], ["all_n", *all_t])
    curve = Written(down.join(truths, "class_name").withColumns({f"p{k}": F.col(c) / F.col("all_n") for k, c in enumerate(all_t)}), "precision-steps").df
    high = accumulated(curve, "class_name", [F.col("confidence")], F.max, [f"p{k}" for k in range(len(levels))], best)
    # points of the recall that this step is the first to reach; the first step has that of 0, too
    point = lambda x: F.call_function("div", 100 * x, F.col("n_truths"))
    reached = [point(F.col(a)) - point(F.col(a) - F.col(b)) + (F.col("all_n") == F.col("n")).cast("int") for a, b in zip(all_t, t, strict=True)]
    area = [F.sum((F.col(b) * r).cast("decimal(28,12)")).cast("double").alias(f"ap{k}") for k, (b, r) in enumerate(zip(best, reached, strict=True))]
    areas = high.groupBy("class_name").agg(*area)
    f1 = 2 * F.col("all_t0") / (F.col("all_n") + F.col("n_truths"))
    top = curve.groupBy("class_name").agg(F.max_by(F.struct((F.col("all_t0") / F.col("all_n")).alias("precision"), (F.col("all_t0") / F.col("n_truths")).alias("recall")), F.struct(f1.alias("f1"), "confidence")).alias("top"))
    known = truths.join(areas, "class_name", "left").join(top, "class_name", "left")
    mean = sum((F.coalesce(f"ap{k}", F.lit(0.0)) for k in range(1, len(levels))), F.coalesce("ap0", F.lit(0.0))) / len(levels)
    value = {"precision": F.coalesce("top.precision", F.lit(0.0)), "recall": F.coalesce("top.recall", F.lit(0.0)), "ap50": F.coalesce("ap0", F.lit(0.0)) / 101, "ap50_95": mean / 101}
    per = known.select("class_name", "n_truths", *(v.cast("decimal(20,12)").alias(c) for c, v in value.items()))
    named = per.select(F.explode(F.array("class_name", F.lit("all"))).alias("class_name"), "n_truths", *value)  # a row a class
    means = named.groupBy("class_name").agg(F.sum("n_truths").alias("n_truths"), *(F.round(F.sum(c).cast("double") / F.count(F.lit(1)), 6).alias(c) for c in value))
    return means


def metric_vectors(metrics: DataFrame, classes: list[str] = CLASS_NAMES) -> DataFrame:
    """One row of vectors for metrics_by_class() from detection_metrics(): of the listed classes that have truths, in their order."""
    at = F.array_position(F.array(*map(F.lit, classes)), F.col("class_name"))
    names = ["precision", "recall", "ap50", "ap50_95"]
    listed = metrics.where(F.col("class_name").isin(classes)).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), *names))).alias("m"))  # a row a class
    return listed.select(*(F.col(f"m.{c}").alias(c) for c in names))


def metrics_by_class(vectors: DataFrame, classes: list[str] = CLASS_NAMES) -> DataFrame:
    """A row for each class from one row of metric vectors (precision, recall, ap50, ap50_95); blank where a vector isn't of the classes' number."""
    names = F.posexplode(F.array(*map(F.lit, classes))).alias("class_id", "class")
    each = [F.when(F.size(v) == len(classes), F.get(v, F.col("class_id"))).alias(v) for v in ("precision", "recall", "ap50", "ap50_95")]
    return vectors.select("*", names).select(*[c for c in vectors.columns if c not in ("precision", "recall", "ap50", "ap50_95")], "class", *each)
