"""Registered queries on what comes in batches and streams: duplicates through the index, and the dashboard as a stream."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.known import KnownFiles
from ..session import table
from ..storage import checkpoint_dir, remove
from ..streaming import hourly
from . import lenses
from .queries import _EVENT_DETECTIONS, _EVENT_INSPECTIONS, ORACLES, query


@query(f"SELECT id, verdict FROM ({ORACLES['dedup_greedy']})")
def dedup_in_batches(spark, sf_dir):
    """The greedy rule over four batches of files, each checked against the index of those before."""
    files = lenses.files(spark, sf_dir)
    at = f"{checkpoint_dir(spark)}/known-{uuid.uuid4().hex}"
    index = KnownFiles(spark, at, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = files.select(F.expr("percentile_approx(id, array(0.25D, 0.5D, 0.75D))")).first()[0] or []
    last, out = None, []
    for k, cut in enumerate([*cuts, None]):
        part = files if last is None else files.where(F.col("id") > last)
        out.append(index.take(part if cut is None else part.where(F.col("id") <= cut), k))
        last = cut
    index.drop()
    remove(spark, at)
    return reduce(DataFrame.union, out)


@query(f"""WITH {_EVENT_INSPECTIONS}, {_EVENT_DETECTIONS}, hours AS (SELECT *, date_trunc('hour', timestamp) AS start FROM inspections), closed AS (SELECT least(max(timestamp), max(timestamp) FILTER (inspection_id IN (SELECT inspection_id FROM detections))) - INTERVAL 3 HOUR AS mark FROM inspections),
totals AS (SELECT start, count(*) AS total_inspections, count(*) FILTER (overall_result = 'FAIL') AS fails FROM hours GROUP BY 1),
found AS (SELECT start, class_name, count(*) AS defect_count, sum(confidence::DECIMAL(24, 8)) AS total_confidence FROM detections JOIN hours USING (inspection_id) GROUP BY ALL)
SELECT start, total_inspections, fails, coalesce(class_name, '') AS defect_class, coalesce(defect_count, 0) AS defect_count, total_confidence::DOUBLE AS total_confidence FROM totals LEFT JOIN found USING (start), closed WHERE start + INTERVAL 1 HOUR <= mark""")
def streaming_dashboard(spark, sf_dir):
    """The hourly dashboard from two streams, of the hours that the slower stream's watermark has closed."""
    schema = table(spark, sf_dir, "events").schema
    events = lambda: hourly.read(spark, f"{sf_dir}/events.parquet*", schema)  # noqa: E731  as a pattern it may be one file or a folder
    rolled = hourly.dashboard(lenses.event_inspections(spark, sf_dir, events()), lenses.event_detections(spark, sf_dir, events()))
    out = hourly.drained(rolled, f"{checkpoint_dir(spark)}/dashboard-{uuid.uuid4().hex}")
    return out.select("start", "total_inspections", "fails", "defect_class", "defect_count", "total_confidence")
