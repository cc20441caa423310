"""URL filter by a sorted digest array.

Rules are host + path strings (``org/``, ``example.org/es/``). Their 64-bit XXH64 keys
form one sorted array; keys, strings and actions lie in one file that each Python worker
memory-maps. A url is looked up through every suffix of its host and every path length
that occurs among the rules; a batch of candidate keys is probed by one vectorised binary
search and each hit is confirmed against the stored full string, so a collision of two
keys cannot give a wrong verdict. Rules and the method's own list of hosts each have an
array. An array of more than BROADCAST_BYTES is cut by key into several, which are probed
one after the other.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule and the verdict allow; a rule's path starts with a slash, so no rule fits an empty
path, while the method's own list looks at hosts only; repeated rows are judged alike; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import table

# The rules of the query (action, host/path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

# Hosts that the method itself blocks, with all their subdomains, where no rule fits.
BLOCKED_HOSTS = [
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
]

#: Bytes of a digest array that are sent to the executors as one broadcast.
BROADCAST_BYTES = 256 << 20

SEED = 0
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    end = min((i for i in (tail.find("?"), tail.find("#")) if i >= 0), default=len(tail))
    return host, tail[:end]


class Digests(NamedTuple):
    """Part of a sorted digest array, as bytes, and the path lengths in use."""

    keys: bytes
    ends: bytes  # of each entry's string in strings
    strings: bytes
    blocks: bytes  # 1 for each entry that blocks
    lengths: list[int]


def build(entries: Iterable[tuple[str, str]], most: int = BROADCAST_BYTES) -> list[Digests]:
    """The sorted digest array of (action, host/path) entries, in parts of about so many bytes; the first of two with equal strings stays."""
    first: dict[str, str] = {}
    for action, rule in entries:
        first.setdefault(rule, action)
    rows = sorted((xxhash.xxh64_intdigest(rule.encode(), SEED), rule.encode(), action) for rule, action in first.items())
    lengths = sorted({len(rule) - rule.index("/") for rule in first})
    out, at = [], 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size + len(rows[end][1]) + 17 <= most):
            size += len(rows[end][1]) + 17
            end += 1
        part = rows[at:end]
        out.append(Digests(np.array([r[0] for r in part], "<u8").tobytes(), np.cumsum([len(r[1]) for r in part]).astype("<i8").tobytes(), b"".join(r[1] for r in part), bytes(r[2] == "block" for r in part), lengths))
        at = end
    return out


class Mapped(NamedTuple):
    keys: np.ndarray
    ends: np.ndarray
    strings: np.ndarray
    blocks: np.ndarray
    lengths: list[int]

    def entry(self, k: int) -> tuple[str, str]:
        low = int(self.ends[k - 1]) if k else 0
        return self.strings[low : int(self.ends[k])].tobytes().decode(), "block" if self.blocks[k] else "allow"


def mapped(part: Digests) -> Mapped:
    """One memory-mapped file in the worker's own temporary folder; its name goes at once."""
    data = part.keys + part.ends + part.strings + part.blocks
    fd, path = tempfile.mkstemp(suffix=".digests")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        held = np.memmap(path, np.uint8, mode="r")
    finally:
        os.unlink(path)
    a, b, c = len(part.keys), len(part.keys) + len(part.ends), len(data) - len(part.blocks)
    return Mapped(held[:a].view("<u8"), held[a:b].view("<i8"), held[b:c], held[c:], part.lengths)


def longest_rules(pairs: list[tuple[str, str]], held: Mapped) -> list[tuple[str, str] | None]:
    """For each (host, path) the longest stored entry that fits it, as (rule, action)."""
    owners, candidates = [], []
    for i, (host, path) in enumerate(pairs):
        if not host:
            continue
        labels = host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for n in held.lengths:
                if n > len(path):
                    break
                candidates.append(suffix + path[:n])
                owners.append(i)
    found: list[tuple[str, str] | None] = [None] * len(pairs)
    if not candidates:
        return found
    probe = np.fromiter((xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass"), SEED) for c in candidates), dtype="<u8", count=len(candidates))
    at = np.searchsorted(held.keys, probe)
    hit = np.nonzero(held.keys[np.minimum(at, len(held.keys) - 1)] == probe)[0]
    for j in hit:
        k = int(at[j])
        while k < len(held.keys) and held.keys[k] == probe[j]:  # equal keys of different strings stand side by side
            entry = held.entry(k)
            if entry[0] == candidates[j]:
                i = owners[j]
                if found[i] is None or len(entry[0]) > len(found[i][0]):
                    found[i] = entry
                break
            k += 1
    return found


def judge(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url", most: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    ident = pages.schema[id_col]
    names = ["id", "url", "rule", "action", "listed"]
    schema = StructType([StructField("id", ident.dataType), *(StructField(n, StringType()) for n in names[1:4]), StructField("listed", BooleanType())])
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"), F.lit(False).alias("listed"))
    for own, entries in ((False, rules), (True, [("block", f"{h}/") for h in blocked_hosts])):
        for part in build(entries, most):
            sent = spark.sparkContext.broadcast(part)

            def run(batches: Iterator[pa.RecordBatch], sent=sent, own=own) -> Iterator[pa.RecordBatch]:
                held = mapped(sent.value)
                for b in batches:
                    pairs = [split_url(u) for u in b.column("url").to_pylist()]
                    # the method's own list looks at the host only
                    found = longest_rules([(h, "/") for h, _ in pairs] if own else pairs, held)
                    cols = [b.column(n).to_pylist() for n in ("rule", "action", "listed")]
                    if own:
                        cols[2] = [was or f is not None for was, f in zip(cols[2], found, strict=True)]
                    else:
                        best = [f if f and (was is None or len(f[0]) > len(was)) else (was, act) for f, was, act in zip(found, cols[0], cols[1], strict=True)]
                        cols[:2] = [x[0] for x in best], [x[1] for x in best]
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_())], names=names)

            out = out.mapInArrow(run, schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [split_url(u) for u in b.column("url").to_pylist()]
            verdict = [a or ("block" if x else "allow") for a, x in zip(b.column("action").to_pylist(), b.column("listed").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([h for h, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string()), b.column("rule"), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    return out.mapInArrow(split, StructType([StructField(id_col, ident.dataType), *(StructField(n, StringType()) for n in ("host", "path", "rule", "verdict"))]))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_HOSTS = ", ".join(f"'{h}'" for h in BLOCKED_HOSTS)
ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(action, rhost, rpath) AS (
  VALUES {", ".join(f"('{a}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in RULES)}
), fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.action, CASE WHEN regexp_extract(p.host, '[^.]+[.][^.]+[.][^.]+$') IN ({_HOSTS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fit f USING (page_id)
"""
