"""Fetching the urls of a manifest."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "url string, target_class string, source_page string, mime string, content binary, error string"


def fetch(url: str, timeout: float) -> tuple[str, bytes]:
    """Content type (lower case, without parameters) and bytes of a url."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "gaugeworks"}), timeout=timeout) as answer:
        return (answer.headers.get("Content-Type") or "").split(";")[0].strip().lower(), answer.read()


def fetched(manifest: DataFrame, tasks: int = 4, delay: float = 1.0, timeout: float = 20.0) -> DataFrame:
    """The rows of a manifest (url, target_class, source_page) with what their urls gave, or the error.

    The tasks are few and each waits between its requests, so that sites aren't overrun.
    Write the result before it is read twice: every reading fetches anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            for row in batch.to_pylist():  # a batch a row: contents may be large
                if not first:
                    time.sleep(delay)
                first = False
                try:
                    mime, content, error = *fetch(row["url"], timeout), None
                except Exception as e:
                    mime, content, error = None, None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row | {"mime": mime, "content": content, "error": error}], schema=_ARROW)

    return manifest.select("url", "target_class", "source_page").repartition(tasks, "url").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([(n, pa.binary() if n == "content" else pa.string()) for n in ("url", "target_class", "source_page", "mime", "content", "error")])
