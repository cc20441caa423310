"""What the reviewer of round 3 found, on small tables that failed before."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as e
from gaugeworks.functions import hashing
from gaugeworks.llm import decontaminate, jaccard_join, segment, simhash
from gaugeworks.operators import dedup, graph, matching, suppress
from gaugeworks.plans import lenses


def test_prices_of_half_a_unit_round_to_even(spark, tmp_path):
    """F13, F14"""
    rows = [(i, f"part {i}", 8, 959.0 + i / 2) for i in range(8)]
    path = str(tmp_path / "part.parquet")
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/*.parquet'")
    for name in ("file_quality_case", "quality_histogram"):
        assert sorted(map(tuple, e.queries()[name](spark, str(tmp_path)).collect())) == sorted(con.execute(e.oracle_sql()[name]).fetchall())


def test_near_hashes_are_compared_as_arrays(spark, monkeypatch):
    """F4 to F11: groups over the size of a block, cut over Arrow batches, and each pair once."""
    monkeypatch.setattr(dedup, "FEW", 4)
    monkeypatch.setattr(dedup, "BLOCK", 16)
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    hashes = sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)})
    want = {(i, j) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if i < j and (x ^ y).bit_count() <= 6}
    h = np.array(hashes, np.uint64)
    assert {(int(a), int(b)) for i, j in dedup._met(np.zeros(len(h), np.int64), h, 6) for a, b in zip(i, j, strict=True)} == want
    got = dedup.hash_links(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")).collect()
    signed = h.view(np.int64)
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == {tuple(sorted((int(signed[i]), int(signed[j])))) for i, j in want}
    parts = [signed[k : k + 20] for k in range(0, len(signed), 20)]
    same = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p), np.int64)), pa.array(p), pa.array(np.full(len(p), 3, np.int32)), pa.array(np.full(len(p), -1, np.int32))], names=["code", "h", "mask", "sub"]) for p in parts]
    found = [(a, b) for r in dedup._links_of_keys(iter(same), 6) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)]
    low = lambda x: int(x) & 0xFFFF  # noqa: E731  the segments of mask 3
    assert sorted(found) == sorted(tuple(sorted((int(signed[i]), int(signed[j])))) for i, j in want if low(h[i]) == low(h[j]))


def test_near_copies_by_deletion_variants(spark):
    """the stage links what the fingerprints' variants link, and through it what their sets link."""
    import corpus_pipeline

    rnd = random.Random(8)
    own = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    body, long = "red green blue " * 300, own(100)
    rows = [(9, body + own(12)), (4, body + own(12)), (6, long), (7, long + " more"), (1, own(60)), (None, body), (8, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "de") for i, t in rows], "doc_id long, text string, lang string")
    out = corpus_pipeline.near_copies_out(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 4, 5, 6]


def test_crowded_boxes_are_decided_in_lots(spark, monkeypatch):
    """the same boxes stay as by a plain scan, and far fewer pairs are made than there are."""
    monkeypatch.setattr(suppress, "LOT", 16)
    rnd, made = random.Random(2), []
    boxes = [(f"{i:03}", rnd.randrange(50) / 50, *(x := float(rnd.randrange(30)), y := float(rnd.randrange(30)), x + 20, y + 20 + rnd.randrange(3))) for i in range(300)]
    iou = lambda p, q: (i := max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))) / (20 * (p[5] - p[3] + q[5] - q[3]) - i)
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[1], b[0])):
        if not any(iou(k, b) > 0.5 for k in kept):
            kept.append(b)
    dropped = suppress._dropped
    monkeypatch.setattr(suppress, "_dropped", lambda links: made.append(links.count()) or dropped(links))
    df = spark.createDataFrame([("i", "c", *b) for b in boxes], "image string, class_name string, key string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = suppress.suppress(df, few=10)
    assert sorted(r["key"] for r in got.collect()) == sorted(b[0] for b in kept)
    assert sum(made) * 4 < sum(iou(a, b) > 0.5 for i, a in enumerate(boxes) for b in boxes[:i])


def test_components_shrink_in_each_round(spark, monkeypatch):
    """paths, a hub and a clique; the edges of all later rounds together are fewer than three times the first ones."""
    made, real = [], graph.Written

    def counted(df, name):
        out = real(df, name)
        made.extend([out.df.count()] if name == "edges" else [])
        return out

    monkeypatch.setattr(graph, "Written", counted)
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 2000 + i) for i in range(100)] + [(1000, 999)]
    clique = [(i, j) for i in range(500, 510) for j in range(500, 510)]
    edges = spark.createDataFrame([*path, *hub, *clique, (5, None), (7000, 7000)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    want = {i: 0 for i in range(301)} | {2000 + i: 999 for i in range(100)} | {1000: 999, 999: 999} | {i: 500 for i in range(500, 510)}
    assert got == want
    assert sum(made[1:]) < 3 * made[0] and made[-1] == 0
    assert graph.components(edges.where("a < 0")).count() == 0


def test_frequent_ngrams_beyond_the_list_are_told_by_a_map(spark):
    """none is left out, however many there are, so blocks don't grow; the map is of a fixed size."""
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten eleven twelve {i} {i} {i} {i} {i}") for i in range(12)], "doc_id long, text string").repartition(4)
    listed, mapped = (jaccard_join.frequent_ngrams(docs, most=n) for n in (100, 2))
    assert len(listed) > 2 and mapped.nbytes == 1 << jaccard_join.MAP_BITS - 3
    bits = np.flatnonzero(np.unpackbits(mapped, bitorder="little"))
    assert bits.tolist() == sorted({int(x) >> 40 - jaccard_join.MAP_BITS for x in listed})
    for i in range(12):
        h = jaccard_join.shingle_set(f"one two three four five six seven eight nine ten eleven twelve {i} {i} {i} {i} {i}")
        assert jaccard_join.prefix(h, listed, 80).tolist() == jaccard_join.prefix(h, mapped, 80).tolist()


def test_boxes_are_shuffled_as_the_numbers_they_are_made_of(spark):
    """below the grouping of scored images there is neither a key nor a place."""
    images = lenses.scored_images(spark, "/root/testdata/sf0.001")
    below = images._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]
    assert "concat_ws" not in below and "double" not in below and "collect_list" in below


def test_predictions_look_at_truths_of_their_class(spark):
    """truths are put together by class; boxes without a class find nothing, and of equal overlaps the first truth is taken."""
    box = [0.0, 0.0, 10.0, 10.0]
    rows = [([("a", box), (None, box), ("b", box), ("a", box)], [("a", 0.9, box), (None, 0.8, box), ("a", 0.7, box), ("a", 0.6, box), ("c", 0.5, box)]), ([], [("a", 0.5, box)])]
    df = spark.createDataFrame(rows, "gt array<struct<class:string,bbox:array<double>>>, pred array<struct<class:string,confidence:double,bbox:array<double>>>")
    out = df.select(matching.level_hits(F.col("gt"), F.col("pred")).alias("h"))
    assert [[x["hits"] for x in r["h"]] for r in out.collect()] == [[1023, 0, 1023, 0, 0], [0]]
    assert "map_from_entries" in out._jdf.queryExecution().analyzed().toString()


def test_the_latent_space_is_fitted_to_all_documents(spark):
    """F16: its two passes read every document; the sum over the executors' pieces is that of one task."""
    rnd, read = random.Random(4), spark.sparkContext.accumulator(0)
    texts = [" ".join(rnd.choices("abcdefghijklmnop", k=64)) for _ in range(9_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    vocabulary = {bytes([c]): i for i, c in enumerate(b"abcdefghijklmnop")}
    w = np.linspace(0.5, 1.5, 16).astype(np.float32)
    one = decontaminate.latent_space(docs.mapInArrow(seen, docs.schema), ["a b c d"], vocabulary, w)
    assert read.value == 2 * 9_000
    other = decontaminate.latent_space(docs.coalesce(1), ["a b c d"], vocabulary, w)
    assert np.allclose(abs(one @ one.T), abs(other @ other.T), atol=1e-3)


def test_texts_are_hashed_in_one_scan(spark, monkeypatch):
    """F5 to F10: digest and hash come from one scan, each different word of a lot is hashed once, lots are cut anywhere."""
    monkeypatch.setattr(hashing, "TEXT_HELD", 40)
    texts = [None, "", " \t\n", "a", " a b\x0b\x0cb\r\na ", "x\x1cy z  q", "long " * 50, "été a \U0001f600 a", *(" ".join(f"w{i * k % 7}" for k in range(i)) for i in range(30))]

    def plain(text: str | None) -> int:
        n = [0] * 72
        for w in (text or "").encode().split():
            n[int(hashlib.md5(w).hexdigest()[:8], 16) % 72] += 1
        return sum((n[9 * r + c + 1] > n[9 * r + c]) << (63 - 8 * r - c) for r in range(8) for c in range(8))

    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("n", F.length("text"))
    got = hashing.text_hashes(docs, "id", also=("n",)).orderBy("id").collect()
    assert [(r["id"], r["n"], r["dhash"] % 2**64) for r in got] == [(i, None if t is None else len(t), plain(t)) for i, t in enumerate(texts)]


def test_first_key_of_a_pair_by_the_differing_segments():
    """F5 to F10: the highest bits of the differing segments tell the same first key as a walk over the segments."""
    rnd = random.Random(3)
    x = np.array([sum(1 << b for b in rnd.sample(range(64), rnd.randrange(9))) for _ in range(2000)], np.uint64)
    for distance, clean in ((6, 2), (6, 3), (3, 2), (10, 2)):
        n = distance + clean
        edges = [64 * i // n for i in range(n + 1)]
        want = [[int(v) >> a & (1 << b - a) - 1 != 0 for a, b in zip(edges, edges[1:], strict=False)] for v in x]
        found = hashing.differing(x, distance, clean)
        for i, high in enumerate(edges[1:]):
            top = hashing.tops(np.full(1, 1 << i), distance, clean)[0]
            assert int(top) == 1 << high - 1
            assert [(v & top) != 0 for v in found] == [w[i] for w in want]


def test_greedy_rounds_go_on_with_what_is_open(spark, monkeypatch):
    """F6 to F8: along a chain each round settles a kept row and the one that it drops, and takes neither on."""
    seen = []

    class Counted(dedup.Written):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name in ("dedup-state", "dedup-open"):
                seen.append(self.df.count())

    monkeypatch.setattr(dedup, "Written", Counted)
    chain = [sum(15 << (4 * k) for k in range(i)) for i in range(8)]
    got = dedup.greedy(spark.createDataFrame([(i, f"s{i}", h, "ok") for i, h in enumerate(chain)], "id long, sha256 string, dhash long, status string"))
    assert [(r["id"], r["verdict"], r["match"]) for r in got.orderBy("id").collect()] == [(i, "near_duplicate", i - 1) if i % 2 else (i, "ok", None) for i in range(8)]
    assert seen == [8, 6, 4, 2, 0]


def test_greedy_compares_all_hashes_once(spark, monkeypatch):
    """F6 to F8: the links are written both ways from one comparison."""
    plans = []

    class Read(dedup.Written):
        def __init__(self, df, name):
            if name == "dedup-links":
                plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
            super().__init__(df, name)

    monkeypatch.setattr(dedup, "Written", Read)
    got = dedup.greedy(spark.createDataFrame([(i, f"s{i}", i, "ok") for i in range(3)], "id long, sha256 string, dhash long, status string"))
    assert [r["match"] for r in got.orderBy("id").collect()] == [None, 0, 0]
    assert plans[0] == 1


def test_variants_are_not_broadcast(spark):
    """64 variants a fingerprint, which Spark takes for the size of one, went through the driver."""
    prints = spark.createDataFrame([(0,), (3,), (7,), (1 << 40,), (-1,)], "fp long")
    found = simhash.links(prints)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2  # of the hot variants, which are few, on both sides
    assert sorted(map(tuple, found.collect())) == [(0, 3), (0, 1 << 40), (3, 7)]


def test_sampled_rows_are_decoded_together():
    """op1_sentencepiece: a slice's rows in one go, and single random numbers without arrays, give what the plain ways give."""
    v = segment.load()
    surface = segment.Lattices(v).surface
    rnd = random.Random(3)
    rows = [[], [rnd.randrange(len(v.pieces)) for _ in range(50)], [], [int(v.byte_ids[32])], v.byte_ids[[32, 32, 0xC3, 0x9F, 0xFF]].tolist(), [-1, 7], []]
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    assert list(segment.decoded_all(np.array([i for r in rows for i in r], np.int32), ends, surface)) == [segment.decode(r, v) for r in rows]
    assert list(segment.decoded_all(np.empty(0, np.int32), np.zeros(3, np.int32), surface)) == ["", ""]
    for key, purpose, place in ((0, 0, 0), (2**64 - 1, 4095, 2**40), (12345678901234567890, 1025, 64 * 7)):
        assert segment.uniform_one(key, purpose, place) == float(segment.uniform(np.uint64(key), purpose, place))


def test_texts_are_cut_into_words_once(spark):
    """op5_decontamination: all passes read the term numbers; sums over runs of any length and windows are as plain ones."""
    rng = np.random.default_rng(3)
    v, rows, value = rng.standard_normal((40, 6)).astype(np.float32), rng.integers(0, 40, 9_000), rng.random(9_000).astype(np.float32)
    cuts = np.concatenate([[0, 1, 2, 5, 8], np.arange(11, 900, 7), [900, 5_000]])
    plain = np.array([(v[r] * x[:, None]).sum(0) for r, x in zip(np.split(rows, cuts[1:]), np.split(value, cuts[1:]), strict=True)])
    assert np.allclose(decontaminate._weighted(v, rows, value, cuts), plain, atol=1e-3)

    space = rng.standard_normal((40, 6)).astype(np.float32)
    space[20:] = 0
    lengths = [0, 5, 16, 200, 0, 333]
    starts = np.cumsum([0, *lengths])
    ids = np.where(rng.random(starts[-1]) < 0.9, -1, rng.integers(0, 40, starts[-1])).astype(np.int32)
    assert not any(len(decontaminate.windows(b)[0]) for b in decontaminate.block_sums(np.full(40, -1, np.int32), np.array([0, 40]), space))
    for b in decontaminate.block_sums(ids, starts, space):
        got = {(int(t), int(a)): x for x, t, a in zip(*decontaminate.windows(b), strict=True)}
        want = {}
        for t, (low, high) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            for a in range(low, high, b.size):
                heavy = [i for i in ids[a : min(high, a + 2 * b.size)] if 0 <= i < 20]
                if heavy:
                    want[t, a] = space[heavy].sum(0)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)

    docs = spark.createDataFrame([(1, "The cat, the DOG"), (2, None), (None, "dog x cat"), (4, "")], "doc_id long, text string")
    numbers = decontaminate.numbered(docs, {b"cat": 0, b"dog": 1})
    assert [(r["doc_id"], np.frombuffer(bytes(r["ids"]), "<u2").tolist()) for r in numbers.collect()] == [(1, [0, 1, 0, 2]), (2, []), (None, [2, 0, 1]), (4, [])]
    df, n = decontaminate.document_frequencies(numbers, 2)
    assert df.tolist() == [2, 2] and n == 4
