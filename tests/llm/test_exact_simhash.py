from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from playmetrics.llm import exact, links, simhash
from playmetrics.llm.queries import QUERIES

from .conftest import prose


def test_exact_groups(odd):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact.deduplicate(odd).collect()
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        per[bytes(r.digest)].append(r)
    for text, ids in groups.items():
        mine = per[hashlib.sha256(text.encode()).digest()]
        largest = max((i for i in ids if i is not None), default=None)
        assert {(r.group_size, r.keep_id) for r in mine} == {(len(ids), largest)}
        assert sum(r.kept for r in mine) == 1 and [r.doc_id for r in mine if r.kept] == [largest]


def test_exact_compares_bytes_when_digests_collide(odd):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(text.cast("binary")), F.lit(3))), 2, "0"))
    got = exact.deduplicate(odd, digest=weak).select("doc_id", "keep_id", "group_size", "kept")
    want = exact.deduplicate(odd).select("doc_id", "keep_id", "group_size", "kept")
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(want)


def test_exact_carries_clashing_columns_and_empty_tables(odd, none):
    got = exact.deduplicate(odd, carry=True)
    assert got.columns[: len(odd.columns)] == odd.columns and "_kept" in got.columns
    assert got.where("_kept").count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact.deduplicate(none).count() == 0


def test_two_deliveries_through_one_store_equal_one(spark, odd, tmp_path):
    rows = odd.collect()
    order = lambda df: sorted(map(str, df.select("doc_id", "keep_id", "group_size", "kept", "digest").collect()))
    want = order(exact.deduplicate(odd))
    store = str(tmp_path / "store")
    first = spark.createDataFrame(rows[:9], odd.schema)
    assert order(exact.deduplicate(first, store=store)) == order(exact.deduplicate(first))
    # Each call starts the stream anew from the state that the one before left in the folder.
    second = spark.createDataFrame(rows[9:], odd.schema)
    assert order(exact.deduplicate(second, store=store)) == want
    nothing = spark.createDataFrame([], odd.schema)
    assert order(exact.deduplicate(nothing, store=store)) == want


def test_rows_that_stay(spark, odd, none, tmp_path):
    path = str(tmp_path / "docs")
    odd.write.parquet(path)
    weak = lambda text: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(text.cast("binary")), F.lit(3))), 2, "0"))
    last = {}
    for r in odd.collect():
        last[r.text or ""] = max(last.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    for docs in (odd, spark.read.parquet(path)):
        for digest in (exact.sha256, weak):
            got = exact.distinct_rows(docs, digest=digest)
            assert got.columns == odd.columns
            assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in got.collect()) == sorted(last.items())
    assert exact.distinct_rows(none).count() == 0


def slow_fingerprint(text: str, size: int) -> int:
    import xxhash

    words = [w.decode() for w in text.encode().lower().split()]
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_and_components(odd):
    rows = odd.collect()
    prints = [slow_fingerprint(r.text or "", 3) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(top(i)), r.doc_id) if x is not None]
        least[top(i)] = min(ids, default=None)
    want = sorted((str(r.doc_id), prints[i], str(least[top(i)])) for i, r in enumerate(rows))
    got = simhash.near_duplicates(odd, size=3).collect()
    assert sorted((str(r.id), r.fp % 2**64, str(r.component)) for r in got) == want


def test_one_row_of_each_component(spark, none, tmp_path):
    rng, rows = random.Random(7), []
    for k in range(12):
        base = prose(60 + k, 120).split()
        for _ in range(rng.randrange(1, 5)):
            words = list(base)
            if rng.random() < 0.6:
                words[rng.randrange(120)] = "changed"
            rows.append((rng.choice([None, 3, 8, len(rows) + 20]), " ".join(words), "x"))
    rows += [(None, None, "y"), (4, "", "y"), (4, "", "y")]
    prints = [slow_fingerprint(t or "", 3) for _, t, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = classes(pairs)
    least = defaultdict(list)
    for i, (doc_id, _, _) in enumerate(rows):
        least[root.get(i, i)].append((doc_id is None, doc_id or 0))
    want = sorted(min(ids) for ids in least.values())
    assert len(want) < len(rows) - 10
    schema, path = "doc_id bigint, text string, _place_row string", str(tmp_path / "docs")
    spark.createDataFrame(rows, schema).repartition(3).drop("_place_row").write.parquet(path)
    for docs in (spark.createDataFrame(rows, schema).drop("_place_row").repartition(3), spark.read.parquet(path)):
        got = simhash.one_of_each(docs, 3, 2).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == want
        kept = {root.get(i, i) for r in got for i, row in enumerate(rows) if row[:2] == (r.doc_id, r.text)}
        assert len(kept) == len(want)
    assert simhash.one_of_each(none).count() == 0


def test_links_within_a_radius_miss_nothing(spark):
    rng = random.Random(4)
    points = {rng.getrandbits(64) for _ in range(60)}
    for p in list(points):
        for _ in range(4):
            q = p
            for _ in range(rng.randrange(1, 5)):
                q ^= 1 << rng.randrange(64)
            points.add(q)
    points = sorted(p - 2**64 if p >> 63 else p for p in points)
    df = spark.createDataFrame([(p,) for p in points], "fp bigint")
    for radius in (1, 2):
        close = {(a, b) for a in points for b in points if a < b and ((a ^ b) % 2**64).bit_count() <= radius}
        got = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.links_within(df, radius).collect()}
        assert got <= close
        assert classes(close) == classes(got)


def classes(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = list(range(100))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:], strict=False)) + [(200, 200 + k) for k in range(1, 50)] + [(300, 300)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {**{c: 0 for c in range(1, 100)}, **{200 + k: 200 for k in range(1, 50)}}
    assert links.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_copies_by_shingles(spark, none):
    text = prose(9, 300).split()
    near, far = list(text), list(text)
    near[50], near[200] = "changed", "words"
    for k in range(0, 300, 12):
        far[k] = f"x{k}"
    rows = [(7, " ".join(text)), (3, " ".join(near)), (1, " ".join(far)), (9, prose(10, 300)), (11, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r.component for r in simhash.near_copies(docs).collect()}
    assert got == {7: 3, 3: 3, 1: 1, 9: 9, 11: 11, 12: 11}
    assert simhash.near_copies(none).count() == 0


def test_queries_run_on_odd_rows(spark, folder, odd):
    for name in ("op6_simhash", "op9_exact"):
        assert QUERIES[name](spark, folder).count() == odd.count()


def brute_classes(texts: dict, similarity: float = 0.8, size: int = 5) -> dict:
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {" ".join(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))}
    close = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    found = classes(close)
    return {i: found.get(i, i) for i in sets}


def linked_classes(spark, texts: dict) -> dict:
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    pairs = [(r.u, r.v) for r in simhash.similar_pairs(docs, 0.8, 5, "doc_id").collect()]
    found = classes(pairs)
    return {i: found.get(i, i) for i in texts}


def test_similar_pairs_connect_stars_and_pairs_that_share_hot_passages(spark):
    rng = random.Random(8)
    base = prose(20, 240).split()
    texts = {500: " ".join(base)}
    for k in range(320):
        words = list(base)
        for at in (rng.randrange(48 * part + 4, 48 * part + 44) for part in range(5)):
            words[at] = f"v{k}x{at}"
        texts[k] = " ".join(words)
    hot = [prose(30 + k, 60) for k in range(4)]
    texts |= {600 + k: f"{prose(100 + k, 150)} {hot[k % 4]} {prose(300 + k, 20)}" for k in range(60)}
    texts |= {700: " ".join(hot) + " one end", 701: " ".join(hot) + " another close", 702: "a b", 703: "A B"}
    texts |= {710 + k: f"{hot[0]} {prose(400 + k, 3)}" for k in range(40)}
    want = brute_classes(texts)
    assert want[500] == 0 and want[701] == 700 and want[703] == 702
    assert linked_classes(spark, texts) == want


def test_similar_pairs_compare_distinct_shingles_not_lengths(spark):
    part = prose(50, 12)
    texts = {1: f"{part} {part}", 2: " ".join([part] * 6), 3: prose(51, 70)}
    assert brute_classes(texts) == {1: 1, 2: 1, 3: 3}
    assert linked_classes(spark, texts) == {1: 1, 2: 1, 3: 3}
