"""File quality: one status for each file, by rules of fixed precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SIDE, MAX_ASPECT = 96, 6.0
WHITE, EDGES = 0.92, 0.015
# Name parts of files that are no photographs.
NAME_TOKENS = ["screenshot", "diagram", "slide"]


def aspect(width: Column, height: Column) -> Column:
    return F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height))


def status(filename: Column, readable: Column, decoded: Column, width: Column, height: Column, white: Column, edges: Column) -> Column:
    """The first rule that a file breaks, or ok."""
    named = F.lit(False)
    for token in NAME_TOKENS:
        named = named | F.contains(F.lower(filename), F.lit(token))
    return (
        F.when(named, F.lit("screenshot_or_diagram"))
        .when(~readable, F.lit("unreadable"))
        .when(~decoded, F.lit("corrupt"))
        .when(F.least(width, height) < MIN_SIDE, F.lit("too_small"))
        .when(aspect(width, height) > MAX_ASPECT, F.lit("extreme_aspect"))
        .when((white > WHITE) & (edges < EDGES), F.lit("screenshot_or_diagram"))
        .otherwise(F.lit("ok"))
    )


def histogram(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def collected(candidates: DataFrame, min_side: int = MIN_SIDE) -> DataFrame:
    """The stateless part of the collection rules: fetch error, type, decoding, size; survivors are ok and go to dedup.greedy().

    candidates: error, mime, decoded, width, height and what else there is.
    """
    from ..functions.naming import mime_extension

    rule = (
        F.when(F.col("error").isNotNull(), F.lit("fetch_error"))
        .when(mime_extension(F.col("mime")).isNull(), F.lit("rejected_mime"))
        .when(~F.coalesce("decoded", F.lit(False)), F.lit("corrupt"))
        .when(F.least("width", "height") < min_side, F.lit("too_small"))
        .otherwise(F.lit("ok"))
    )
    return candidates.withColumn("status", rule)
