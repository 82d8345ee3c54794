"""Ranked search, Merkle manifests and nearest neighbours against brute force, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import LONG, ODD
from pyspark.sql import functions as F

from longitab.llm import ball_tree, learned_partitions, merkle


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- 11 -----------------------------------------------------------------------------------------
def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def corpus(n):
    rng = random.Random(5)
    docs = [(i, " ".join(f"t{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60)))) for i in range(n)]
    docs += [(n + i, "t1 t2 same t77") for i in range(40)]                      # many equal scores
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 25)))) for i in range(30)]
    return docs, items + [(30, "same t1 t1"), (31, "nothing here"), (32, None), (33, " .. "), (34, LONG)]


@pytest.mark.parametrize("limits", [{}, {"LEAF": 4, "BLOCK_DOCS": 64}, {"PASS_BYTES": 1500, "ITEMS": 3}])
def test_ranking_equals_brute_force(spark, frame, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ball_tree, name, value)
    docs, items = corpus(400)
    if "PASS_BYTES" in limits:
        items = items[:-1]                                                      # without the very long one: passes are jobs
    docs = docs + ODD
    got = rows(ball_tree.rank(frame(docs), spark.createDataFrame(items, "item_id long, text string")))
    want = ranked(docs, items)
    key = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got]
    assert sorted(key) == sorted(want)


def test_ranking_of_nothing(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string, score string")
    one = spark.createDataFrame([("x", "a b", "s"), ("x", "a b", "s")], "item_id string, text string, score string")
    assert rows(ball_tree.rank(frame([]), one)) == [] and rows(ball_tree.rank(frame(ODD), none)) == []
    got = ball_tree.rank(frame(ODD), one)
    assert [(r["item_id"], r["doc_id"]) for r in rows(got.orderBy("rank"))][:2] == [("x", 5), ("x", 5)]
    assert dict(got.dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    groups = rng.integers(0, 12, 3000)                                          # documents of a topic share terms
    parts = [np.unique(np.concatenate((g * 20 + np.arange(20), rng.integers(0, 240, 2)))) for g in groups]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    impact = rng.integers(400_000, 500_000, ends[-1])
    block = ball_tree.Block(np.arange(3000), ends, np.concatenate(parts), impact, 240)
    query = np.zeros(240, np.int64)
    query[40:60] = rng.integers(1, 9000, 20)
    bound = block.bounds(query[:, None].astype(float))[:, 0]
    exact = {}
    for leaf in range(len(block.leaf_ends) - 1):
        exact |= dict(zip(*[x.tolist() for x in block.scores(leaf, query)]))
    for (_, _, children, leaf), b in zip(block.nodes, bound):
        if leaf is not None:
            assert block.scores(leaf, query)[1].max() <= b
    found = []
    visited = block.search(bound, query, found, 10)
    assert sorted(found, reverse=True) == sorted(((s, -i) for i, s in exact.items() if s), reverse=True)[:10]
    assert visited < 0.75 * (len(block.leaf_ends) - 1)


# -- 12 -----------------------------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def walk(tree, at, now):
    proof = ""
    for level in tree[:-1]:
        run, i = level[at - at % 3:at - at % 3 + 3], at % 3
        proof += "".join(run[:i] + run[i + 1:])
        now, at = sha("".join(run[:i] + [now] + run[i + 1:])), at // 3
    return proof, now


def manifest_by_hand(docs):
    groups = defaultdict(list)
    for i, source, text in docs:
        later = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        groups[source].append((i is not None, i or 0, *[sha(field(i) + field(source) + field(t)) for t in (text, later)], i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([r[2] for r in sorted(groups[s], key=lambda r: r[:4])]) for s in order}
    over, out = up([trees[s][-1][0] for s in order]), []
    for rank, s in enumerate(order):
        for at, r in enumerate(sorted(groups[s], key=lambda r: r[:4])):
            low, now = walk(trees[s], at, r[3])
            high, now = walk(over, rank, now)
            out.append((r[4], r[2], trees[s][-1][0], over[-1][0], sha(low + high), now, now == over[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("depth", [merkle.DEPTH, 1, 2])
def test_manifest_equals_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", merkle.ARITY**depth)
    docs = [(i, f"s{i % 11 // 2}" if i % 3 else "hot", f"line {i}\n" * (i % 4)) for i in range(220)]
    docs += [(1000 + i, s, "a\nb") for i, s in enumerate([None, None, "", "é", "Z", "=", "-"])]
    docs += [(i, "odd", t) for i, t in ODD] + [(None, "odd", None)]
    df = spark.createDataFrame([(*d, 3, "x") for d in docs], "doc_id long, source string, text string, key int, leaf string")
    out = merkle.manifest(df, ["doc_id", "source", "text"], changed={"text": F.translate("text", "\n", "")},
                          when=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    got = [tuple(r[c] for c in COLUMNS) for r in rows(out)]
    want = manifest_by_hand(docs)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[6] for r in got} == {True, False}
    one = rows(out.limit(1))[0]
    assert merkle.fold(bytes.fromhex(one["leaf"]), one["group_rows"], one["position"], one["proof"])[0].hex() == one["subroot"]


@pytest.mark.parametrize("slice_rows", [4, 40])
def test_manifest_of_sources_numbered_by_slices(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(merkle, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    monkeypatch.setattr(merkle, "DEPTH", 2)
    docs = [(i, f"s{i % 50}" if i % 3 else "hot", f"line {i}\n" * (i % 4)) for i in range(300)]
    docs += [(None, "hot", t) for t in ("a\nb", "a", None)] + [(5, "hot", "a\nb")] * 2 + [(i, None, "a") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    out = merkle.manifest(df, ["doc_id", "source", "text"], changed={"text": F.translate("text", "\n", "")},
                          when=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    assert sorted([tuple(r[c] for c in COLUMNS) for r in rows(out)], key=repr) == sorted(manifest_by_hand(docs), key=repr)


def test_manifest_of_one_row_and_none(spark):
    one = rows(merkle.manifest(spark.createDataFrame([(1, "s", "t")], "doc_id long, source string, text string"), ["text"]))
    assert one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == one[0]["folded_root"] and one[0]["verified"]
    assert one[0]["proof_sha256"] == sha("")
    assert rows(merkle.manifest(spark.createDataFrame([], "doc_id long, source string, text string"), ["text"])) == []


def test_versions_share_nodes():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(27)]
    top = merkle.build(leaves, 3)
    other = merkle.with_leaf(top, 14, 3, b"x" * 32)
    assert other[1][0] is top[1][0] and other[1][2] is top[1][2] and other[1][1][1][0] is top[1][1][1][0]
    assert other[0] == merkle.build([*leaves[:14], b"x" * 32, *leaves[15:]], 3)[0] != top[0]


# -- 13 -----------------------------------------------------------------------------------------
def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())))


def true_nearest(table, queries, k=5):
    out = {}
    for q, v in queries.items():
        near = sorted((-cosine(v, x), i) for i, x in table.items() if i != q)[:k]
        out[q] = [(r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return out


def clustered(n, d=12):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, d))
    return {i: (centres[rng.integers(40)] + 0.3 * rng.normal(size=d)).round(4).tolist() for i in range(n)}


VEC = "vec_id long, embedding array<double>, label int, part int, x string"


def found(spark, table, queries=None, **more):
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in table], VEC)
    asked = df.filter("vec_id % 50 = 0") if queries is None else spark.createDataFrame([(i, v, 0, 1, "x") for i, v in queries], VEC)
    out = defaultdict(list)
    for r in rows(learned_partitions.nearest(df, asked, **more).orderBy("query_id", "rank")):
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return dict(out)


def test_neighbour_recall_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "BLOCK_ROWS", 100)                  # several blocks of a part
    monkeypatch.setattr(learned_partitions, "BLOCK_QUERIES", 20)
    table = clustered(3000)
    got = found(spark, table.items())
    want = true_nearest(table, {i: v for i, v in table.items() if i % 50 == 0})
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)
    assert all(s == pytest.approx(cosine(table[q], table[i]), abs=1e-12) for q in got for _, i, s in got[q])
    x = np.array(list(table.values()))
    router = learned_partitions.fit_router(x, 5)
    assert router.parts == learned_partitions.PARTS and router.route(x).sum(axis=1).mean() < router.parts / 2
    assert np.bincount(router.place(x), minlength=router.parts).max() < 4 * len(x) / router.parts


def test_neighbours_of_one_part_are_exact_with_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "HOT_ROWS", 20)                     # the copies are collapsed
    table = clustered(300)
    table |= {1000 + i: table[50] for i in range(60)}                           # a very frequent vector
    want = true_nearest(table, {i: v for i, v in table.items() if i % 50 == 0})
    got = found(spark, [*table.items(), (1003, table[50]), (7, table[7])], parts=1)
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {q: [i for _, i, _ in v] for q, v in want.items()}
    assert [r for r, _, _ in got[50]] == [1, 2, 3, 4, 5]


def test_odd_vectors(spark):
    good = {i: [1.0, float(i)] for i in range(1, 4)}
    odd = [(None, [1.0, 1.0]), (60, None), (61, [0.0, 0.0]), (62, [1.0, None]), (63, [float("nan"), 1.0]), (64, [float("inf"), 1.0]), (65, [1.0]), (66, [])]
    got = found(spark, [*good.items(), *odd], [(2, [1.0, 2.0]), (50, [1.0, 2.0]), *odd])
    assert [i for _, i, _ in got[2]] == [3, 1] and [i for _, i, _ in got[50]] == [2, 3, 1] and set(got) == {2, 50}
    assert found(spark, []) == {} and found(spark, odd, odd) == {}
    assert found(spark, [(50, [1.0, 2.0])]) == {}
