"""Ranked search, the n-gram Jaccard join and importance resampling against brute force, SQL and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from gaugeworks.llm import importance, jaccard_join, ranked_search
from gaugeworks.llm.queries import ORACLES, QUERIES
from gaugeworks.storage import Written

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

LONG = "the quick brown fox " * 3000
#: Nulls, empty, blank, very long, repeated rows and ids, and columns with clashing names.
ODD = [(1, None, "en", 5, "a"), (2, "", None, 6, "b"), (3, LONG, "en", 7, "c"), (4, "a b c d e f g", "en", 8, None), (4, "a b c d e f g", "en", 8, None), (5, "A b C d e f g", "de", 9, "x"), (None, "x y z", "en", 1, "y"), (6, "12 % 34", None, 2, "z"), (7, "ünïcödé — ß\n\t日本語 🙂", "de", 3, ""), (8, " \n\t ", "en", 4, "w"), (9, "xy z", "en", 4, "w")]
ODD_SCHEMA = "doc_id long, text string, lang string, score int, rank string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@data
@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_ngram_jaccard", "op13_importance_resampling"])
def test_registered_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


# ---------------------------------------------------------------- 11


def plain_terms(text):
    return [t for t in "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isdigit() or c.isalpha() else " " for c in text or "").split(" ") if t]


def plain_search(docs, queries, k):
    found = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in found:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out[q] = [(k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize(("shard", "batch", "top"), [(4096, 256, 10), (7, 2, 3), (1, 1, 10), (64, 5, 1000)])
def test_search_equals_brute_force(spark, monkeypatch, shard, batch, top):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked_search, "BATCH", batch)
    rnd = random.Random(shard)
    word = lambda: f"w{min(rnd.randrange(60), rnd.randrange(60))}"
    docs = [(i * 3, " ".join(word() for _ in range(rnd.randrange(0, 30)))) for i in range(150)] + [(1000 + i, "w1 w2, W2! Ünï") for i in range(20)]
    rnd.shuffle(docs)
    queries = [(i, " ".join(word() for _ in range(rnd.randrange(0, 12)))) for i in range(30)] + [(30, "ünï Ünï w2 w2 nowhere"), (31, None), (32, ""), (33, "nowhere")]
    got = collections.defaultdict(list)
    rows = ranked_search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string"), k=top)
    for r in rows.collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    want = plain_search(docs, queries, top)
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_blocks_of_queries_and_string_ids(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 40)
    docs = [(f"d{i}", f"w{i % 5} w{i % 7} w{i % 3}") for i in range(60)]
    queries = [(i, f"w{i % 5} w{i % 3}") for i in range(25)]
    got = ranked_search.ranked(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "q int, text string"), key="q", k=4).collect()
    want = collections.defaultdict(list)
    n = {i: collections.Counter(plain_terms(t)) for i, t in docs}
    df = collections.Counter(t for c in n.values() for t in c)
    for q, text in queries:
        scores = sorted((-sum(ranked_search.term_weight(60, df[t]) * (10**9 * c[t] // (1000 * c[t] + 8 * 100)) for t in plain_terms(text) if t in c), i) for i, c in n.items())
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:4])]
    found = collections.defaultdict(list)
    for r in got:
        found[r["q"]].append((r["rank"], r["doc_id"], r["score"]))
    assert {q: sorted(x) for q, x in found.items()} == want


def test_search_of_odd_tables(spark, odd):
    asked = spark.createDataFrame([(1, "x a 12", 1), (1, "x a 12", 2), (None, "fox", 3), (2, None, 4), (3, "日本語", 5)], "item_id long, text string, score int")
    got = ranked_search.ranked(odd, asked).collect()
    assert {r["doc_id"] for r in got if r["item_id"] is None} == {3} and {r["doc_id"] for r in got if r["item_id"] == 3} == {7}
    ones = sorted((r["rank"], r["score"]) for r in got if r["item_id"] == 1)
    assert len(ones) == 10 and ones[0] == ones[1] and {r["doc_id"] for r in got if r["item_id"] == 1} == {None, 4, 5, 6}  # the same item twice
    assert ranked_search.ranked(odd.limit(0), asked).count() == 0 and ranked_search.ranked(odd, asked.limit(0)).count() == 0


def test_a_tree_keeps_both_orders():
    rnd = np.random.default_rng(1)
    docs, sizes = 37, [20, 1, 37, 5]
    lists = [np.sort(rnd.choice(docs, n, replace=False)) for n in sizes]
    impact = [rnd.integers(1, 1000, n) for n in sizes]
    order = [np.argsort(-x, kind="stable") for x in impact]
    at = np.concatenate([x[o] for x, o in zip(lists, order, strict=True)])
    bits = []
    for level in reversed(range(6)):
        one = (at >> level) & 1 == 1
        bits.append(np.packbits(one).tobytes())
        at = np.concatenate([at[~one], at[one]])
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    tree = ranked_search.Tree(docs, b"a b c d", starts.tobytes(), b"".join(bits), np.concatenate([x[o] for x, o in zip(impact, order, strict=True)]).astype(np.int32).tobytes())
    for asked in ([(b"a", 2), (b"c", 1)], [(b"d", 5), (b"b", 3), (b"c", 7), (b"z", 9)], [(b"z", 1)]):
        want = collections.Counter()
        for t, w in asked:
            for k, name in enumerate((b"a", b"b", b"c", b"d")):
                if name == t:
                    want.update({int(d): int(v) * w for d, v in zip(lists[k], impact[k], strict=True)})
        for k in (1, 5, 100):
            found, score = tree.search(asked, k, 1)
            top = sorted(want.values(), reverse=True)[:k]
            assert sorted(score.tolist(), reverse=True)[:k] == top and all(want[int(d)] == s for d, s in zip(found, score, strict=True))


# ---------------------------------------------------------------- 12


def plain_sets(text, width=5):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_classes(rows, percent=80, width=5):
    sets = [plain_sets(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(s), least.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(rnd, n=260):
    """Families of near copies, passages and lines that many share, short texts and copies."""
    word = lambda: f"w{rnd.randrange(3000)}"
    passage, line = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(12))
    out = []
    for family in range(12):
        base = [word() for _ in range(rnd.randrange(1, 120))]
        for _ in range(rnd.choice([1, 3, 30])):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = word()
            text = " ".join(w)
            out.append(f"{passage} {text}" if rnd.random() < 0.3 else f"{text} {line}" if rnd.random() < 0.3 else text)
    out += [" ".join(word() for _ in range(rnd.randrange(0, 8))) for _ in range(40)] + [out[0]] * 10 + ["same few words"] * 5
    rnd.shuffle(out)
    return [(i, t) for i, t in enumerate(out[:n])]


@pytest.mark.parametrize(("seed", "page", "frequent", "most"), [(1, 4_000_000, 4, 4_000_000), (2, 3000, 4, 4_000_000), (3, 900, 2, 50), (4, 4_000_000, 10**9, 1)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, page, frequent, most):
    monkeypatch.setattr(jaccard_join, "PAGE", page)
    monkeypatch.setattr(jaccard_join.frequent_ngrams, "__defaults__", (5, frequent, most))
    rows = corpus(random.Random(seed))
    got = jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == plain_classes(rows)


def test_classes_of_odd_tables(spark, odd):
    got = sorted(map(tuple, jaccard_join.near_classes(odd).collect()), key=str)
    assert got == plain_classes([(r[0], r[1]) for r in ODD])
    assert jaccard_join.near_classes(odd.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "one two three four five six"), ("a", "ONE two three four five six"), ("c", None)], "doc_id string, text string")
    assert {tuple(r) for r in jaccard_join.near_classes(named).collect()} == {("a", 2, "a"), ("b", 2, "a"), ("c", 0, "c")}
    assert {tuple(r)[2] for r in jaccard_join.near_classes(named, percent=100, width=3).collect()} == {"a", "c"}


def test_tree_traversal_equals_all_pairs():
    rnd = random.Random(1)
    for trial in range(60):
        n = rnd.randrange(1, 100)
        base = [sorted({rnd.randrange(1 << 40) for _ in range(rnd.randrange(1, 60))}) for _ in range(max(1, n // 6))]
        sets = []
        for _ in range(n):
            s = set(rnd.choice(base))
            for _ in range(rnd.randrange(0, 6)):
                s ^= {rnd.choice(sorted(s)) if rnd.random() < 0.5 and len(s) > 1 else rnd.randrange(1 << 40)}
            sets.append(np.array(sorted(s), np.uint64))
        near = [(a, b) for a in range(n) for b in range(a + 1, n) if 180 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 80 * (len(sets[a]) + len(sets[b]))]
        classes = np.arange(n) if trial % 2 else np.array([rnd.randrange(n) for _ in range(n)])

        def joined(links, classes=classes):
            label = list(classes)
            for a, b in links:
                label = [label[a] if x == label[b] else x for x in label]
            first = {}
            return [first.setdefault(x, i) for i, x in enumerate(label)]

        got = jaccard_join.tree_links(sets, classes)
        assert all((a, b) in near or (b, a) in near for a, b in got) and joined(got) == joined(near)
        m = rnd.randrange(0, n)
        if m:
            got = [(a, b + m) for a, b in jaccard_join.tree_links(sets[:m], classes[:m], sets[m:], classes[m:])]
            assert joined(got) == joined([(a, b) for a, b in near if a < m <= b])


def test_similar_sets_share_an_announcement():
    rnd = random.Random(6)
    for _ in range(300):
        a = {rnd.getrandbits(64) for _ in range(rnd.randrange(1, 80))}
        b = set(list(a)[rnd.randrange(0, 1 + len(a) // 6) :]) | {rnd.getrandbits(64) for _ in range(rnd.randrange(0, 1 + len(a) // 8))}
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        often = np.unique(np.array([v >> 23 for v in rnd.sample(sorted(a | b), rnd.randrange(len(a | b)))], np.uint64))
        assert set(jaccard_join.prefix(x, often, 80).tolist()) & set(jaccard_join.prefix(y, often, 80).tolist())


# ---------------------------------------------------------------- 13


def plain_scores(rows, target, percent=25, least=20):
    def features(text):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c in "0123456789" or "a" <= c <= "z" else " " for c in text or "").split(" ") if x]
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    each = [(i, *features(t)) for i, t in rows]
    s, t = collections.Counter(c for _, _, f in each for c in f), collections.Counter(c for x in target for c in features(x)[1])
    gain = {c: math.floor(1000 * math.log((t[c] + 1) * float(s.total() + 10_000) / ((s[c] + 1) * float(t.total() + 10_000)))) for c in s}
    out = []
    for i, n, f in each:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[c] for c in f) // len(f) if f else 0
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    place = {id(x): k + 1 for k, x in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*x[:4], place.get(id(x))) for x in out), key=str)


def test_scores_equal_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["the", "Zeit", "één", "a1", "b2", "x", f"w{rnd.randrange(300)}"])
    rows = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(200)] + [(300, LONG), (301, None), (302, "—;日本語,x")]
    target = [" ".join(word() for _ in range(30)) for _ in range(10)] + [None, ""]
    scores = importance.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"))
    got = importance.drawn(scores).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_scores(rows, target)


def test_resampling_of_odd_tables(spark, odd):
    target = spark.createDataFrame([("a b c",)], "text string")
    got = importance.drawn(importance.scored(odd, target), percent=50, least=1)
    assert got.count() == len(ODD) and got.where("rank is not null").count() == 8 * 50 // 100
    kept = importance.resampled(odd, target, percent=50, least=1)
    assert kept.columns == odd.columns and 4 <= kept.count() <= 5  # a repeated row comes with its copy
    assert importance.resampled(odd, target, percent=100, least=0).count() == len(ODD)
    assert importance.drawn(importance.scored(odd.limit(0), target)).count() == 0
    assert importance.drawn(importance.scored(odd, target.limit(0))).count() == len(ODD)


def test_only_totals_are_shuffled(spark):
    """The scores' plan has no exchange and no row for a feature."""
    docs = spark.createDataFrame([(i, "a b c d") for i in range(50)], "doc_id long, text string")
    plan = importance.scored(docs, docs.select("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan


def test_tables_do_not_stay(spark, odd):
    from gaugeworks import storage

    before = len(storage._tables)
    with storage.scope():
        jaccard_join.near_classes(odd).count()
        assert all(isinstance(t, Written) for t in storage._tables[before:])
    assert len(storage._tables) == before
