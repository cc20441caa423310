"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The class dimension (id order) and its two families.
CLASS_NAMES = ["scratch", "dent", "weld_porosity", "weld_crack", "corrosion", "misaligned_busbar", "missing_or_loose_component"]
ASSEMBLY_CLASSES = ["misaligned_busbar", "missing_or_loose_component"]
SURFACE_CLASSES = ["scratch", "dent", "weld_porosity", "weld_crack", "corrosion"]
SPLITS = ["train", "val", "test"]


def _of(**kinds) -> StructType:
    return StructType([StructField(n, k() if isinstance(k, type) else k) for n, k in kinds.items()])


_S, _D, _L, _I = StringType, DoubleType, LongType, IntegerType

INSPECTIONS = _of(inspection_id=_L, timestamp=TimestampType, image_name=_S, model_version=_S, overall_result=_S, max_confidence=_D, inference_ms=_D, device=_S, threshold_config=_S, notes=_S)
DETECTIONS = _of(detection_id=_L, inspection_id=_L, class_name=_S, confidence=_D, x1=_D, y1=_D, x2=_D, y2=_D)
_BOX = ArrayType(DoubleType())
DETECTION = StructType([StructField("class", StringType()), StructField("confidence", DoubleType()), StructField("bbox", _BOX)])
TRIGGERED = StructType([*DETECTION.fields, StructField("threshold", DoubleType()), StructField("triggered_fail", BooleanType())])
DECISION = _of(result=_S, max_confidence=_D, failing_classes=ArrayType(StringType()), detections=ArrayType(TRIGGERED))
LABELS = _of(split=_S, stem=_S, line_no=_I, class_id=_I, cx=_D, cy=_D, w=_D, h=_D)
TRUTH = StructType([StructField("class", StringType()), StructField("bbox", _BOX)])
PREDICTIONS = _of(image=_S, split=_S, dataset=_S, gt=ArrayType(TRUTH), pred=ArrayType(DETECTION))
QUALITY = _of(relative_path=_S, class_name=_S, filename=_S, sha256=_S, dhash=_S, width=_I, height=_I, status=_S, reason=_S)
SOURCES = _of(url=_S, target_class=_S, source_page=_S)
DOWNLOADS = _of(filename=_S, source_url=_S, source_page=_S, download_timestamp=_S, sha256=_S, width=_I, height=_I, status=_S)
FAILED_URLS = _of(url=_S, error=_S)
SPLIT_MANIFEST = _of(filename=_S, split=_S, cluster_id=_L, sha256=_S, class_name=_S, n_boxes=_I)
DIAGRAM_MANIFEST = _of(filename=_S, relative_path=_S, class_id=_I, class_name=_S, seed=_L, split=_S, sha256=_S, width=_I, height=_I, n_boxes=_I, yolo=_S, domain=_S, generator=_S, note=_S)
DIAGRAM_SPLIT_COLUMNS = ["filename", "relative_path", "class_id", "class_name", "seed", "split", "sha256", "n_boxes"]
SHOP_MANIFEST = _of(filename=_S, seed=_I, split=_S, class_ids=_S, width=_I, height=_I, generator_version=_S, synthetic=_S)
SWEEP = _of(threshold=_D, class_name=_S, precision=_D, recall=_D, false_positives=_L, false_negatives=_L, false_rejects=_L, note=_S)
DASHBOARD = _of(date=DateType, hour=_I, total_inspections=_L, passes=_L, fails=_L, failure_rate=_D, average_inference_ms=_D, defect_class=_S, defect_count=_L, average_confidence=_D)
CLASS_METRICS = StructType([StructField("class", StringType())] + [StructField(n, DoubleType()) for n in ("precision", "recall", "ap50", "ap50_95")])
VALIDATION = _of(train_count=_L, val_count=_L, test_count=_L, annotations_per_class=MapType(StringType(), LongType()), errors=ArrayType(StringType()), warnings=ArrayType(StringType()), near_duplicate_bits=_I)
ATTRIBUTION = _of(annotated_file=_S, source_page=_S, creator=_S, license=_S, license_url=_S, modifications=_S)
IMAGES = _of(path=_S, filename=_S, stem=_S, suffix=_S, content=BinaryType)
