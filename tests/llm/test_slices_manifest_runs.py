from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from playmetrics.llm import manifest, runs, slices
from playmetrics.llm.queries import QUERIES, SQL, _loop

from .conftest import prose

# Exact top-k search ------------------------------------------------------------------------------


@pytest.mark.parametrize("added", [1, 3, 9])
def test_sliced_block_finds_all_rows_at_or_above_the_kth_score(added):
    rng = np.random.default_rng(added)
    for _ in range(150):
        rows = rng.integers(-rng.integers(1, 60), rng.integers(1, 60), (rng.integers(1, 200), rng.integers(1, 7)))
        query, k = rng.integers(-40, 40, rows.shape[1]), int(rng.integers(1, 9))
        found, scores = slices.SlicedBlock(rows).best(query, k, added)
        exact = rows @ query
        least = np.sort(exact)[-min(k, len(exact))]
        assert set(found) == set(np.flatnonzero(exact >= least)) and (scores == exact[found]).all()


def slow_top(rows, k, scale):
    """Each distinct row (id, vector) that asks, against all other rows."""
    kept = set()
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept.add((i, tuple(max(-slices.LIMIT, min(slices.LIMIT, math.floor(scale * x))) for x in v)))
    out = []
    for q in kept:
        if q[0] % 4 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[1], c[1], strict=False)), c[0]) for c in kept if c != q)
            out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(slices, "BLOCK", 40)
    monkeypatch.setattr(slices, "QUERIES", 7)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(150)]
    # A vector that many rows share, repeated rows, two vectors of one id, and rows that take no part.
    rows += [(200 + i, [0.5, -0.5, 0.5, 0.25, 0.0, 1.0]) for i in range(70)] + rows[:5] * 2 + [(8, [0.1] * 6), (12, [3.0, 1.0])]
    rows += [(None, [0.5] * 6), (300, None), (304, [0.5, None]), (308, [float("nan")] * 6), (312, [float("inf")] * 6), (316, [])]
    rows += [(320, [1e30, -1e30])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, emb array<float>, score string").repartition(3)
    got = slices.top_k(df, "vec_id", "emb", F.col("vec_id") % 4 == 0, 5, 256)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == slow_top(rows32, 5, 256)
    few = df.where("vec_id in (4, 5, 6)")
    assert [r.rank for r in slices.top_k(few, "vec_id", "emb", F.col("vec_id") == 4, 5, 256).orderBy("rank").collect()] == [1, 2]
    assert slices.top_k(df.limit(0), "vec_id", "emb", F.lit(True), 5, 256).count() == 0


# Merkle manifest ---------------------------------------------------------------------------------


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def written(*values) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(leaves: list[str], arity: int):
    """The root, and each leaf's path of (before, after)."""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for leaf, j in enumerate(at):
            first = j - j % arity
            paths[leaf].append(("".join(level[first:j]), "".join(level[j + 1 : first + arity])))
        level = [h("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        at = [j // arity for j in at]
    return level[0], paths


def slow_manifest(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, written(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in order}
    root, upper = slow_tree([trees[g][0] for g in order], arity)
    out = []
    for g, above in zip(order, upper, strict=True):
        subroot, paths = trees[g]
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            full = [*path, *above]
            node = written(r[0], r[1], None if r[2] is None else r[2] + 1) if (r[0] or 0) % 3 == 1 else leaf
            for before, after in full:
                node = h(before + node + after)
            out.append((str(r[0]), leaf, subroot, root, h("".join(b + a for b, a in full)), node))
    return sorted(out)


@pytest.mark.parametrize("arity, slots", [(2, 256), (2, 4), (3, 9)])
def test_manifest_equals_brute_force(spark, monkeypatch, arity, slots):
    monkeypatch.setattr(manifest, "SLOTS", slots)
    monkeypatch.setattr(manifest, "COPIES", 4)
    rng = random.Random(arity + slots)
    ids = [*range(-70, 130, 2), *[rng.getrandbits(62) for _ in range(40)]]
    rows = [(i, rng.choice([None, "a", "b", "é", ""]), rng.choice([None, 0, 5, 7])) for i in ids]
    # Lone groups, null ids, ids that repeat, and equal rows.
    rows += [(1, "lone", 3), (None, "a", 1), (None, "a", 2), (None, "a", 2), (10, "a", 1), (10, "a", 9), (None, None, None)]
    rows += [(64, "b", 4)] * 11
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, lang string, n bigint, leaf string").repartition(4)
    leaf = manifest.leaf_digest(F.col("doc_id"), F.col("lang"), F.col("n"))
    other = F.when(F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(3)) == 1, manifest.leaf_digest(F.col("doc_id"), F.col("lang"), F.col("n") + 1))
    got = manifest.manifest(df, "doc_id", "lang", leaf, other, arity)
    got = got.select(F.col("id").cast("string"), "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof"), "folded")
    rows = [(i, g, n) for i, g, n in rows]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == slow_manifest(rows, arity)
    assert manifest.manifest(df.limit(0), "doc_id", "lang", leaf, other, arity).count() == 0


def test_places_need_no_sort_of_rows(spark):
    rows = spark.range(3000).select(F.lit("=a").alias("grp"), (F.col("id") * 7 - 900).alias("id"), F.lit("x").alias("leaf"), F.lit("y").alias("other"))
    found = manifest.places(rows)
    assert sorted((r["held"]["id"], r["pos"]) for r in found.collect()) == [(7 * i - 900, i) for i in range(3000)]
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


# Periodic runs -----------------------------------------------------------------------------------


def slow_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                length = j + q - i
                smaller = any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q))
                if length >= max(6, 4 * q) and not smaller:
                    out.append((i, length, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([1, 2, 2, 3, 4])
        words = [rng.randrange(k) for _ in range(rng.randrange(60))]
        part = [rng.randrange(k) for _ in range(rng.randrange(1, 7))]
        words[len(words) // 3 : len(words) // 3] = (part * rng.randrange(2, 9))[: rng.randrange(1, 50)]
        assert runs.runs_of(words) == slow_runs(words)
        # The windows that are counted first leave no run out, also beside another text.
        ids = np.array([*words, 9, *words], np.int64)
        owner = np.repeat([0, 1], [len(words) + 1, len(words)])
        found = [(a + s, n, q) for a, b in runs.stretches(ids, owner) for s, n, q in runs.runs_of(ids[a:b].tolist())]
        both = slow_runs([*words, 9]) + [(s + len(words) + 1, n, q) for s, n, q in slow_runs(words)]
        assert sorted(found) == sorted(both)


def slow_document(doc_id, text):
    words = (text or "").encode().split()
    seed = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and words and (loop := _loop(seed, len(words))):
        first, turn = loop
        words = [words[i] if i < first else words[first + (i - first) % turn] for i in range(len(words))]
    found = slow_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (str(doc_id), len(found), *best, None if not found else 1000 * best[1] // best[2], h(lines), hashlib.sha256(kept).hexdigest())


def test_runs_of_documents(spark, odd, none, monkeypatch, tmp_path):
    monkeypatch.setattr(runs, "BLOCK_BYTES", 900)
    texts = [prose(k, 40) for k in range(60)] + ["a b " * 30 + prose(2, 9), "x " * 500, "tick tock\n" * 4, "one two three " * 3, "\x1ca\x1c " * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 9]
    path = str(tmp_path / "tables")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = sorted(((str(r[0]), *r[1:]) for r in QUERIES["op13_runs"](spark, path).collect()), key=str)
    want = sorted((slow_document(*r) for r in rows), key=str)
    assert got == want and sum(r[1] for r in got) > 8
    assert runs.find_runs(none, ["doc_id"]).count() == 0


def test_a_long_text_is_read_whole(spark):
    words = [f"w{k % 5000}" for k in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    row = runs.find_runs(docs, ["doc_id"]).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 60_000, 5000)
    assert len(bytes(row.collapsed).split()) == 5000


def test_new_queries_run_on_odd_rows(spark, folder, odd, tmp_path):
    for name in ("op12_manifest", "op13_runs"):
        assert QUERIES[name](spark, folder).count() == odd.count()
    found = QUERIES["op12_manifest"](spark, folder)
    assert found.where("verified").count() >= found.count() // 2 and found.select("root").distinct().count() == 1
    assert {"op11_topk", "op12_manifest"} <= set(SQL)
