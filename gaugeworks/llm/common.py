"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of at most this many bytes are handled together inside one Arrow batch; a longer text is handled alone.
SLICE_BYTES = 2_000_000
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder, opened by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(col: str, modulus: int) -> Column:
    """crc32(id as text) mod modulus; a null id gives null."""
    return F.crc32(F.col(col).cast("string")) % F.lit(modulus)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice has SLICE_ROWS rows and about so many bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()]
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
