from playmetrics.operators import blocks, sessions
from playmetrics.streaming import streams

from .conftest import SCHEMA, make, random_rows, table


def files(spark, tmp_path, rows, parts=4):
    """The log in order of time, in several files that are read one per batch."""
    rows = sorted(rows, key=lambda r: (r["ts"], r["event_id"]))
    size = -(-len(rows) // parts)
    for i in range(parts):
        make(spark, rows[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def closing(rows):
    """A late row of another player moves the watermark past every session."""
    return [*rows, dict(player=99, ts=10**6, event_id=10**6, action="a")]


def test_sessions_equal_the_batch_form(spark, tmp_path):
    rows = random_rows(61)
    stream = files(spark, tmp_path, closing(rows))
    found = streams.drain(streams.stream_sessions(stream, 10), "sessions")
    wanted = sessions.gap_sessions(make(spark, rows), 10)
    assert table(found) == table(wanted, "player", "start_ts", "end_ts", "clicks")


def test_blocks_equal_the_batch_form(spark, tmp_path):
    rows = random_rows(62, rows=300)
    stream = files(spark, tmp_path, rows)
    found = streams.drain(streams.stream_active_blocks(stream, 15, 9), "blocks")
    wanted = blocks.active_blocks(make(spark, rows), 15, 9)
    assert table(found) == table(wanted, "player", "block", "start_ts", "end_ts", "clicks")


def test_blocks_of_a_player_with_several_arrow_batches(spark, tmp_path):
    rows = random_rows(63, rows=300)
    stream = files(spark, tmp_path, rows, parts=2)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "3")
    try:
        found = table(streams.drain(streams.stream_active_blocks(stream, 15, 9), "blocks-small"))
    finally:
        spark.conf.set(setting, before)
    assert found == table(blocks.active_blocks(make(spark, rows), 15, 9), "player", "block", "start_ts", "end_ts", "clicks")


def test_enter_ratio(spark, tmp_path):
    rows = [dict(player=p, ts=p, event_id=p, action="in" if p < 4 else "a") for p in range(8)]
    stream = files(spark, tmp_path, closing(rows))
    found = streams.drain(streams.stream_enter_ratio(stream, "in"), "ratio")
    assert table(found)[0] == (0, 8, 4, 0.5)


def test_enter_ratio_counts_players_once_and_drops_late_rows(spark, tmp_path):
    day = 86_400
    first = [dict(player=p % 5, ts=p * 60, event_id=p, action="in" if p % 5 == 3 else "a") for p in range(40)]
    second = [dict(player=p, ts=day + 900 + p, event_id=100 + p, action="in") for p in range(3)]
    # Comes two batches after the watermark has passed the first day.
    between = [dict(player=1, ts=day + 1000, event_id=150, action="a")]
    late = [dict(player=77, ts=50, event_id=200, action="in")]
    for rows in (first, second, between, late, closing([])):
        make(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    found = streams.drain(streams.stream_enter_ratio(stream, "in"), "ratio")
    assert table(found) == [(0, 5, 1, 0.2), (day, 3, 3, 1.0)]
