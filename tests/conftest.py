from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__  # noqa: E402, F401  (makes worker functions travel by value)

SCHEMA = (
    "player bigint, ts bigint, event_id bigint, action string, key_index bigint, level int, power bigint, "
    "vip_level int, num_days_played int, device string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make(spark, rows):
    """Events from dicts; missing columns get plain defaults."""
    base = {
        "action": "a", "key_index": 0, "level": 1, "power": 0, "vip_level": 0, "num_days_played": 1, "device": "d",
    }
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    full = [{**base, "event_id": i, **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def random_rows(seed: int, players: int = 5, rows: int = 240):
    """A small log, shuffled, in which player 1 has about half of all rows; seconds repeat."""
    rng = random.Random(seed)
    clock = {p: rng.randrange(50) for p in range(1, players + 1)}
    power = dict.fromkeys(clock, 0)
    vip = dict.fromkeys(clock, 0)
    out = []
    for i in range(rows):
        p = 1 if rng.random() < 0.5 else rng.randrange(1, players + 1)
        clock[p] += rng.choice([0, 0, 1, 2, 3, 5, 9, 10, 11, 30])
        power[p] += rng.choice([0, 0, 3, -2])
        if rng.random() < 0.02:
            vip[p] = 1
        out.append(
            dict(
                player=p, ts=clock[p], event_id=i, action=rng.choice(["a", "b", "in", "out", "pay"]),
                key_index=rng.randrange(8), level=1 + clock[p] // 60, power=power[p], vip_level=vip[p],
                num_days_played=1 + clock[p] // 100, device=rng.choice("xyz"),
            )
        )
    rng.shuffle(out)
    return out


def by_player(rows):
    """Histories in order of (ts, event_id)."""
    found: dict[int, list[dict]] = {}
    for row in sorted(rows, key=lambda r: (r["player"], r["ts"], r["event_id"])):
        found.setdefault(row["player"], []).append(row)
    return found


def table(df, *columns):
    """Sorted tuples of a result, floats rounded."""
    def clean(v):
        return round(v, 9) if isinstance(v, float) else v

    chosen = columns or df.columns
    rows = [tuple(clean(r[c]) for c in chosen) for r in df.collect()]
    return sorted(rows, key=lambda t: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in t))
