import random

import numpy as np
import pytest

from playmetrics.operators import blocks
from playmetrics.plans.cuts import chain_of_cuts
from playmetrics.sources import tables
from playmetrics.streaming import streams

from .conftest import make, random_rows, table
from .test_streams import files


def cuts_by_definition(ts, gap, interval):
    """A row cuts if it is near and the near gaps since the last cut sum up to the interval before it."""
    cuts, start = [], 0
    for k in range(1, len(ts)):
        clock = sum(ts[j] - ts[j - 1] for j in range(start + 1, k) if ts[j] - ts[j - 1] <= gap)
        if ts[k] - ts[k - 1] <= gap and clock >= interval:
            cuts.append(k)
            start = k
    return cuts


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chain_in_parts_of_any_size(size):
    rng = random.Random(size)
    for _ in range(80):
        ts = np.cumsum([rng.choice([0, 1, 2, 5, 30]) for _ in range(rng.randrange(1, 60))])
        found, last, clock = [], int(ts[0]), 0
        for at in range(0, len(ts), size):
            part = ts[at : at + size]
            cuts, clock = chain_of_cuts(part, last, clock, 9, 12)
            found += (at + cuts).tolist()
            last = int(part[-1])
        assert found == cuts_by_definition(ts.tolist(), 9, 12)


def test_blocks_do_not_depend_on_batches(spark):
    events = make(spark, random_rows(5, rows=400))
    wanted = table(blocks.block_map(events, 15, 9))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert table(blocks.block_map(events, 15, 9)) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_stream_keeps_blocks_across_long_breaks(spark, tmp_path):
    rows, n = [], 0
    for visit in range(12):
        for minute in range(0, 31):
            rows.append(dict(player=1, ts=visit * 36_000 + 60 * minute, event_id=n, action="a"))
            rows.append(dict(player=2, ts=visit * 36_000 + 20_000 + minute, event_id=n + 1, action="a"))
            n += 2
    stream = files(spark, tmp_path, rows, parts=8)
    found = streams.drain(streams.stream_active_blocks(stream, 3_600), "blocks")
    wanted = blocks.active_blocks(make(spark, rows), 3_600)
    assert wanted.where("player = 1").count() >= 5
    assert table(found) == table(wanted, "player", "block", "start_ts", "end_ts", "clicks")


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        tables.work_dir(Cluster, "x")
