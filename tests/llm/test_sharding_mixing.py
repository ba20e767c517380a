from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

from playmetrics.llm import mixing, sharding


def test_best_fit_against_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randrange(10, 60)
        sizes = sorted((rng.randrange(1, capacity + 5) for _ in range(rng.randrange(0, 80))), reverse=True)
        rooms, want = [], []
        for s in sizes:
            fits = [(room, i) for i, room in enumerate(rooms) if room >= s]
            if fits:
                i = min(fits)[1]
                rooms[i] -= s
            else:
                i = len(rooms)
                rooms.append(capacity - s)
            want.append(i)
        assert list(sharding.best_fit(sizes, capacity)) == want


def test_tree_keeps_order_under_changes():
    rng = random.Random(2)
    room, keys = sharding.Room(), set()
    for _ in range(3_000):
        key = (rng.randrange(50), rng.randrange(50))
        if key in keys:
            room.remove(key)
            keys.remove(key)
        else:
            room.add(key)
            keys.add(key)
        size = rng.randrange(55)
        assert room.tightest(size) == min((k for k in keys if k[0] >= size), default=None)


def check_shards(rows, got, shards, overhead):
    want = Counter((r.doc_id, len((r.text or "").encode()) + overhead, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.id, r.size, r.crc) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_groups_stay_whole(spark, odd):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6) * (1 + i % 9)))) for i in range(600)]
    rows += [(1000 + i, "the same text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.shard_by_bytes(docs, 8).collect()
    check_shards(docs.collect(), got, 8, 16)
    sizes = Counter()
    places = defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        places[bytes(r.digest)].add(r.shard)
    share = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.02 * share and min(sizes.values()) > 0.95 * share
    totals = Counter()
    for r in got:
        totals[bytes(r.digest)] += r.size
    for digest, shards in places.items():
        assert len(shards) == 1 or totals[digest] > share
    assert len(places[hashlib.sha256(b"the same text").digest()]) > 1  # larger than a share
    check_shards(odd.collect(), sharding.shard_by_bytes(odd, 3, overhead=1).collect(), 3, 1)


def test_shards_of_nothing(none):
    assert sharding.shard_by_bytes(none, 4).count() == 0


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_copies_against_a_plain_inversion(spark, odd):
    rows = odd.collect()
    n = Counter(r.source for r in rows)
    weights = {s: c**0.5 for s, c in n.items()}
    rate = {s: weights[s] / sum(weights.values()) * len(rows) * 1.5 / n[s] for s in n}
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:13], 16)
    want = Counter()
    for r in rows:
        name = f"x:{'null' if r.doc_id is None else r.doc_id}"
        for k in range(poisson(number(name) / 16**13, rate[r.source])):
            want[r.doc_id, r.source, k, number(f"{name}:{k}")] += 1
    got = mixing.replicate(odd, seed="x", exponent=0.5, total=1.5).collect()
    assert Counter((r.held.doc_id, r.held.source, r.replica, r["key"]) for r in got) == want
    assert got[0].held.asDict().keys() == set(odd.columns)


def test_mean_rates_and_places(spark, none):
    docs = spark.range(4_000).selectExpr("id AS doc_id", "'t' AS text", "if(id < 3000, 'big', if(id < 3990, 'small', 'off')) AS source")
    copies = mixing.replicate(docs, weights={"big": 1, "small": 3})
    counts = {r["source"]: r["count"] for r in copies.groupBy("held.source").count().collect()}
    assert "off" not in counts and abs(counts["big"] - 1_000) < 120 and abs(counts["small"] - 3_000) < 220
    placed = mixing.shuffled(copies.select("held.doc_id", "key", "replica"), "doc_id", "replica").orderBy("position").collect()
    assert [r.position for r in placed] == list(range(len(placed)))
    assert [r["key"] for r in placed] == sorted(r["key"] for r in placed)
    assert mixing.replicate(none).count() == 0
