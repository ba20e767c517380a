"""Per-player sequence operators and their streaming forms on the game log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, episodes, growth, players, sessions
from ..sources.events import as_events
from ..sources.tables import settle
from ..streaming import streams
from .registry import (
    BEGIN,
    BLOCK,
    DAY0,
    FULL,
    GAP,
    LOG,
    RETAINED_DAYS,
    blocks_sql,
    full_log,
    log,
    profile_log,
    query,
    rounded,
    sessions_sql,
    table,
)

DAYS = 3
END = BEGIN + (DAYS + 1) * 86_400 - 1
WINDOW = 4
LIMIT = 172_800
ACTIONS = ("click", "error", "purchase", "signup", "view")
EVERYONE = "everyone AS (SELECT DISTINCT player FROM log)"
PRE_VIP = "pre_vip AS (SELECT * FROM full_log WHERE vip_level < 1)"

# Sessions and play time -----------------------------------------------------------------------


@query("gap_sessions", f"WITH {LOG}, {sessions_sql()} SELECT * FROM sessions")
def _(spark, sf):
    return sessions.gap_sessions(log(spark, sf), GAP)


@query(
    "click_frequency",
    f"""WITH {LOG}, {sessions_sql()},
    rated AS (SELECT *, end_ts - start_ts AS length, session = max(session) OVER (PARTITION BY player) AS is_last FROM sessions)
    SELECT player, round(coalesce(median((clicks - 1) / length) FILTER (NOT is_last AND length >= 300),
      max((clicks - 1) / length) FILTER (is_last AND length > 0)), 9) AS freq FROM rated GROUP BY 1""",
)
def _(spark, sf):
    return rounded(sessions.click_frequency(log(spark, sf), GAP, 300), 9)


@query(
    "click_frequency_pre_vip",
    f"""WITH {FULL}, {PRE_VIP}, {sessions_sql("pre_vip")}, {EVERYONE}
    SELECT player, round(median((clicks - 1) / (end_ts - start_ts)) FILTER (end_ts > start_ts), 9) AS freq
    FROM everyone LEFT JOIN sessions USING (player) GROUP BY 1""",
)
def _(spark, sf):
    return rounded(sessions.click_frequency_pre_vip(full_log(spark, sf), GAP), 9)


@query(
    "play_time_in_range",
    f"""WITH {LOG}, ranged AS (SELECT * FROM log WHERE ts BETWEEN {BEGIN} AND {END}), {sessions_sql("ranged")}, {EVERYONE}
    SELECT player, CAST(coalesce(sum(end_ts - start_ts), 0) AS BIGINT) AS duration FROM everyone LEFT JOIN sessions USING (player) GROUP BY 1""",
)
def _(spark, sf):
    return sessions.play_time_in_range(log(spark, sf), BEGIN, END, GAP)


@query("play_span", f"WITH {LOG} SELECT player, max(ts) - min(ts) AS span FROM log GROUP BY 1")
def _(spark, sf):
    return sessions.play_span(log(spark, sf))


DAILY = f"daily AS (SELECT *, CAST(ts // 86400 - {DAY0} AS INTEGER) AS day_no FROM log WHERE ts BETWEEN {BEGIN} AND {END})"
PLAYED = (
    f"{LOG}, {DAILY}, {sessions_sql('daily', keys='player, day_no')}, "
    "played AS (SELECT player, day_no, CAST(sum(end_ts - start_ts) AS BIGINT) AS duration FROM sessions GROUP BY 1, 2)"
)


@query("play_time_by_day", f"WITH {PLAYED} SELECT * FROM played")
def _(spark, sf):
    return sessions.play_time_by_day(log(spark, sf), DAY0, DAYS, GAP)


@query(
    "first_day_and_retention",
    f"""WITH {PLAYED}, {EVERYONE}
    SELECT player, coalesce(arg_min(duration, day_no) FILTER (duration > 0), 0) AS first_day_duration,
    count(*) FILTER (duration > 0) > 1 AS retained FROM everyone LEFT JOIN played USING (player) GROUP BY 1""",
)
def _(spark, sf):
    return sessions.first_day_and_retention(log(spark, sf), DAY0, DAYS, GAP)


SLOT = """CASE WHEN (start_ts % 86400) // 3600 BETWEEN 8 AND 12 THEN 'morning' WHEN (start_ts % 86400) // 3600 IN (13, 14) THEN 'noon'
 WHEN (start_ts % 86400) // 3600 BETWEEN 15 AND 18 THEN 'afternoon' ELSE 'night' END"""


def favourite_sql(source: str) -> str:
    return f"""{sessions_sql(source, name="slot_sessions")},
    favourite AS (SELECT player, slot, sessions FROM (SELECT player, {SLOT} AS slot, count(*) AS sessions,
      row_number() OVER (PARTITION BY player ORDER BY count(*) DESC, min(start_ts)) AS r FROM slot_sessions GROUP BY 1, 2) WHERE r = 1)"""


@query("favourite_slot", f"WITH {LOG}, {favourite_sql('log')} SELECT * FROM favourite")
def _(spark, sf):
    return sessions.favourite_slot(log(spark, sf), GAP)


FIRST_SLOT = f"""first_slot AS (SELECT player, {SLOT.replace("start_ts", "min(ts)")} AS slot FROM log GROUP BY 1)"""


@query(
    "favourite_slot_pre_vip",
    f"""WITH {FULL}, {PRE_VIP}, {favourite_sql("pre_vip")}, {FIRST_SLOT}
    SELECT player, coalesce(f.slot, s.slot) AS slot, coalesce(f.sessions, 1) AS sessions FROM first_slot s LEFT JOIN favourite f USING (player)""",
)
def _(spark, sf):
    return sessions.favourite_slot(full_log(spark, sf), GAP, pre_vip=True)


def top_sessions_sql(source: str) -> str:
    return f"""{sessions_sql(source)},
    best AS (SELECT * FROM (SELECT *, (clicks - 1) / (end_ts - start_ts) AS freq,
      CAST(row_number() OVER (PARTITION BY player ORDER BY (clicks - 1) / (end_ts - start_ts) DESC, start_ts) AS INTEGER) AS rank
      FROM sessions WHERE end_ts > start_ts) WHERE rank <= 10)"""


@query(
    "max_click_freq",
    f"WITH {LOG}, {top_sessions_sql('log')} SELECT player, rank, round(freq, 9) AS freq, start_ts, end_ts, clicks FROM best",
)
def _(spark, sf):
    return rounded(sessions.max_click_freq(log(spark, sf), 10, GAP), 9)


@query(
    "max_click_freq_pre_vip",
    f"""WITH {FULL}, {PRE_VIP}, {top_sessions_sql('pre_vip')}
    SELECT player, rank, round(freq, 9) AS freq, start_ts, end_ts, clicks FROM best""",
)
def _(spark, sf):
    return rounded(sessions.max_click_freq(full_log(spark, sf), 10, GAP, pre_vip=True), 9)


@query(
    "max_click_freq_actions",
    f"""WITH {LOG}, {top_sessions_sql('log')}
    SELECT l.player, rank, round(freq, 9) AS freq, ts, event_id, action FROM log l JOIN best b ON l.player = b.player
    AND ts BETWEEN start_ts AND end_ts""",
)
def _(spark, sf):
    return rounded(sessions.max_click_freq_actions(log(spark, sf), 10, GAP), 9)


# Screens and runs -----------------------------------------------------------------------------

RUNS = f"""{LOG}, linked AS (SELECT *, lag(action) OVER w AS prev FROM log WINDOW w AS (PARTITION BY player ORDER BY ts, event_id)),
marked AS (SELECT *, (prev IS NULL OR prev <> action) AS starts FROM linked),
numbered AS (SELECT *, sum(starts::INT) OVER (PARTITION BY player ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT player, run, action, count(*) - 1 AS repeats, max(ts) - min(ts) FILTER (NOT starts) AS duration,
  max(prev) FILTER (starts) AS preceding, min(ts) AS start_ts FROM numbered GROUP BY 1, 2, 3),
good AS (SELECT *, row_number() OVER (PARTITION BY player, action ORDER BY repeats DESC, run) AS r FROM runs WHERE repeats >= 1 AND duration < 172800),
top AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY repeats DESC, run, action) AS rank FROM good WHERE r = 1
  QUALIFY rank <= 3)"""


@query(
    "repeat_runs",
    f"""WITH RECURSIVE {RUNS} SELECT player, action, repeats, duration, preceding, start_ts, CAST(rank AS INTEGER) AS rank FROM top""",
)
def _(spark, sf):
    return episodes.repeat_runs(log(spark, sf), LIMIT).drop("run")


NEXT_RUNS = (
    RUNS.replace("max(ts) - min(ts) FILTER (NOT starts) AS duration", "max(ts) AS last_ts")
    .replace("FROM numbered GROUP BY 1, 2, 3)", """FROM numbered GROUP BY 1, 2, 3),
    timed AS (SELECT *, coalesce(lead(start_ts) OVER (PARTITION BY player ORDER BY run), last_ts) - start_ts AS duration FROM runs)""")
    .replace("FROM runs WHERE repeats >= 1 AND duration < 172800", "FROM timed WHERE repeats >= 1")
)


@query(
    "repeat_runs_to_next",
    f"""WITH {NEXT_RUNS} SELECT player, action, repeats, duration, preceding, start_ts, CAST(rank AS INTEGER) AS rank FROM top""",
)
def _(spark, sf):
    return episodes.repeat_runs(log(spark, sf), None, to_next=True).drop("run")


@query(
    "repeat_clicks",
    f"""WITH {RUNS}, before AS (SELECT action, preceding, count(*) AS rows, row_number() OVER (PARTITION BY action ORDER BY count(*) DESC, preceding) AS r
      FROM top WHERE preceding IS NOT NULL GROUP BY 1, 2)
    SELECT t.action, count(*) AS players, round(avg(repeats), 6) AS mean_repeats, median(repeats) AS median_repeats,
    round(avg(duration), 6) AS mean_duration, median(duration) AS median_duration, any_value(b.preceding) AS preceding
    FROM top t LEFT JOIN before b ON b.action = t.action AND b.r = 1 GROUP BY 1""",
)
def _(spark, sf):
    return rounded(episodes.repeat_clicks(log(spark, sf), LIMIT).drop("rows"))


def episode_sql(window: int | None = WINDOW, limit: int | None = LIMIT, enter: str = "view", leave: str = "purchase", tag: str = "") -> str:
    tests = [f"action = '{leave}'"]
    kinds = [f"WHEN action = '{leave}' THEN 'exit'"]
    if limit is not None:
        tests.append(f"ts - t0 > {limit}")
        kinds.append(f"WHEN ts - t0 > {limit} THEN 'timeout'")
    if window is not None:
        near = f" AND ts - t0 < {limit}" if limit is not None else ""
        tests.append(f"(seq - r0 >= {window}{near})")
        kinds.append(f"WHEN seq - r0 >= {window}{near} THEN 'window'")
    return f"""seq{tag} AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, event_id) AS seq FROM log),
    firsts{tag} AS (SELECT player, max(seq) AS size, max(ts) AS last_ts, min(seq) FILTER (action = '{enter}') AS r0,
      arg_min(ts, seq) FILTER (action = '{enter}') AS t0 FROM seq{tag} GROUP BY 1),
    ends{tag} AS (SELECT a.player, min(seq) AS end_at, arg_min(ts, seq) AS end_ts, arg_min(CASE {' '.join(kinds)} END, seq) AS kind
      FROM seq{tag} a JOIN firsts{tag} f USING (player) WHERE seq > r0 AND ({' OR '.join(tests)}) GROUP BY 1),
    episodes{tag} AS (SELECT player, last_ts, CASE WHEN r0 IS NULL THEN 'none' WHEN kind IS NULL THEN 'unfinished' ELSE kind END AS ending,
      t0 AS enter_ts, end_ts, CASE WHEN kind IS NOT NULL THEN end_at - r0 - 1 ELSE size - r0 END AS stay_clicks
      FROM firsts{tag} LEFT JOIN ends{tag} USING (player))"""


@query(
    "first_episode",
    f"WITH {LOG}, {episode_sql()} SELECT player, ending, enter_ts, end_ts, stay_clicks FROM episodes",
)
def _(spark, sf):
    return episodes.first_episode(log(spark, sf), "view", "purchase", WINDOW, LIMIT).drop("last_ts")


@query(
    "ui_stay_actions",
    f"""WITH {LOG}, {episode_sql(None, None)},
    inside AS (SELECT l.player, action, count(*) AS clicks FROM log l JOIN seq a USING (player, event_id) JOIN firsts f ON f.player = l.player
      JOIN ends e ON e.player = l.player WHERE a.seq > f.r0 AND a.seq < e.end_at GROUP BY 1, 2)
    SELECT action, count(*) AS players, CAST(sum(clicks) AS DOUBLE) AS total_clicks, round(avg(clicks), 6) AS mean_clicks,
    median(clicks) AS median_clicks FROM inside GROUP BY 1""".replace("l.player, action", "l.player, l.action"),
)
def _(spark, sf):
    return rounded(episodes.ui_stay_actions(log(spark, sf), "view", "purchase"))


LOSS = """count(*) FILTER (ending <> 'none') AS entered, count(*) FILTER (ending = 'exit') AS exited,
round(count(*) FILTER (ending NOT IN ('none', 'exit')) / count(*) FILTER (ending <> 'none'), 6) AS loss_rate,
round(avg(stay_clicks) FILTER (ending <> 'none'), 6) AS mean_stay_clicks,
count(*) FILTER (ending <> 'none' AND stay_clicks > 3) AS players_over_3"""


@query("ui_loss", f"WITH {LOG}, {episode_sql()} SELECT {LOSS} FROM episodes")
def _(spark, sf):
    return rounded(episodes.ui_loss(log(spark, sf), "view", "purchase", WINDOW, LIMIT))


@query(
    "ui_stay_time",
    f"""WITH {LOG}, {episode_sql()} SELECT player, ending,
    CASE WHEN ending IN ('exit', 'window') THEN end_ts - enter_ts ELSE 0 END AS stay_secs FROM episodes""",
)
def _(spark, sf):
    return episodes.ui_stay_time(log(spark, sf), "view", "purchase", WINDOW, LIMIT)


@query(
    "ui_stay_time_means",
    f"""WITH {LOG}, {episode_sql(WINDOW, None)} SELECT round(avg(end_ts - enter_ts) FILTER (ending = 'exit'), 6) AS mean_exit_secs,
    round(avg(coalesce(end_ts, last_ts) - enter_ts), 6) AS mean_all_secs FROM episodes""",
)
def _(spark, sf):
    return rounded(episodes.ui_stay_time_means(log(spark, sf), "view", "purchase", WINDOW))


@query(
    "ui_enter_ratio",
    f"""WITH {LOG}, r AS (SELECT * FROM log WHERE ts > {BEGIN} AND ts < {END})
    SELECT count(DISTINCT player) AS active, count(DISTINCT player) FILTER (action = 'view') AS entered,
    round(count(DISTINCT player) FILTER (action = 'view') / count(DISTINCT player), 6) AS ratio FROM r""",
)
def _(spark, sf):
    return rounded(episodes.ui_enter_ratio(log(spark, sf), "view", BEGIN, END))


@query(
    "ui_enter_ratio_by_day",
    f"""WITH {LOG}, r AS (SELECT *, CAST((ts - {BEGIN}) // 86400 AS INTEGER) AS day_no FROM log WHERE (ts - {BEGIN}) % 86400 <> 0 AND ts >= {BEGIN}),
    c AS (SELECT day_no, count(DISTINCT player) AS active, count(DISTINCT player) FILTER (action = 'view') AS entered FROM r GROUP BY 1)
    SELECT CAST(d.day_no AS INTEGER) AS day_no, coalesce(active, 0) AS active, coalesce(entered, 0) AS entered,
    CASE WHEN active > 0 THEN round(entered / active, 6) ELSE -1 END AS ratio
    FROM (SELECT unnest(range(0, {DAYS + 1})) AS day_no) d LEFT JOIN c ON c.day_no = d.day_no""",
)
def _(spark, sf):
    return rounded(episodes.ui_enter_ratio_by_day(log(spark, sf), "view", DAY0, DAYS))


PAIRS = (("view", "purchase"), ("click", "signup"), ("signup", "signup"))


def _report_sql() -> str:
    parts, selects = [], []
    for i, (enter, leave) in enumerate(PAIRS):
        parts.append(episode_sql(WINDOW, LIMIT, enter, leave, str(i)))
        selects.append(
            f"""SELECT {i} AS pair, '{enter}' AS enter, '{leave}' AS "exit",
            (SELECT round(count(DISTINCT player) FILTER (action = '{enter}') / count(DISTINCT player), 6) FROM log
             WHERE ts > {BEGIN} AND ts < {END}) AS enter_ratio, {LOSS},
            round(avg(CASE WHEN ending IN ('exit', 'window') THEN end_ts - enter_ts ELSE 0 END), 6) AS mean_stay_secs FROM episodes{i}"""
        )
    return f"WITH {LOG}, {', '.join(parts)} {' UNION ALL '.join(selects)}"


@query("ui_report", _report_sql())
def _(spark, sf):
    return rounded(episodes.ui_report(log(spark, sf), PAIRS, BEGIN, END, WINDOW, LIMIT))


@query(
    "ui_click_times",
    f"""WITH {FULL} SELECT player, count(*) AS clicks, arg_min(level, rn) AS first_level FROM full_log WHERE action = 'purchase' GROUP BY 1""",
)
def _(spark, sf):
    return episodes.ui_click_times(full_log(spark, sf), "purchase")


@query(
    "find_payers",
    f"""WITH {FULL}, k AS (SELECT *, max(CASE WHEN contains(action, 'purchase') THEN rn END)
      OVER (PARTITION BY player ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kr FROM full_log),
    h AS (SELECT k.player, k.rn, k.rn - kr AS steps FROM k JOIN full_log b ON b.player = k.player AND b.rn = k.kr
      WHERE k.rn - kr <= 6 AND k.key_index - b.key_index >= 10000)
    SELECT player, arg_min(steps, rn) AS steps FROM h GROUP BY 1""",
)
def _(spark, sf):
    return episodes.find_payers(log(spark, sf), ["purchase"], 10_000, 5)


@query(
    "first_pay_view_time",
    f"""WITH {LOG} SELECT player, coalesce(min(ts) FILTER (contains(action, 'purchase')) - min(ts), 0) AS secs FROM log GROUP BY 1""",
)
def _(spark, sf):
    return episodes.first_pay_view_time(log(spark, sf), ["purchase"])


@query(
    "pre_conversion_actions",
    f"""WITH {FULL}, o AS (SELECT *, max(CASE WHEN action <> 'purchase' THEN rn END)
      OVER (PARTITION BY player ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS outside FROM full_log),
    c AS (SELECT o.player, min(o.rn) AS seq FROM o JOIN full_log b ON b.player = o.player AND b.rn = coalesce(o.outside, 1)
      WHERE o.action = 'purchase' AND o.key_index > b.key_index GROUP BY 1)
    SELECT player, action, count(*) AS clicks FROM full_log LEFT JOIN c USING (player)
    WHERE action <> 'purchase' AND (seq IS NULL OR rn < seq) GROUP BY 1, 2""",
)
def _(spark, sf):
    return episodes.pre_conversion_actions(log(spark, sf), ["purchase"])


# Blocks of active time ------------------------------------------------------------------------

SUMMARY = """count(*) AS players, CAST(min(v) AS DOUBLE) AS min_value, CAST(max(v) AS DOUBLE) AS max_value,
round(avg(v), 6) AS mean_value, median(v) AS median_value"""


@query(
    "active_blocks",
    f"""WITH RECURSIVE {LOG}, {blocks_sql()} SELECT player, block, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS clicks
    FROM full_rows GROUP BY 1, 2""",
)
def _(spark, sf):
    return blocks.active_blocks(log(spark, sf), BLOCK, GAP)


@query(
    "clicks_by_block",
    f"""WITH RECURSIVE {LOG}, {blocks_sql()}, c AS (SELECT player, block, count(*) AS v FROM full_rows GROUP BY 1, 2)
    SELECT block, {SUMMARY} FROM c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(blocks.clicks_by_block(log(spark, sf), BLOCK, GAP))


@query(
    "key_growth_by_block",
    f"""WITH RECURSIVE {LOG}, {blocks_sql()}, c AS (SELECT player, block, arg_max(key_index, seq) AS v FROM full_rows GROUP BY 1, 2)
    SELECT block, {SUMMARY} FROM c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(blocks.key_growth_by_block(log(spark, sf), BLOCK, GAP))


@query(
    "key_growth_by_block_all",
    f"""WITH RECURSIVE {LOG}, {blocks_sql()}, c AS (SELECT player, block, arg_max(key_index, seq) AS v FROM block_rows
      WHERE block < greatest(cuts, 1) GROUP BY 1, 2) SELECT block, {SUMMARY} FROM c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(blocks.key_growth_by_block(log(spark, sf), BLOCK, GAP, keep_short=True))


@query(
    "key_value_one_player",
    f"""WITH RECURSIVE {LOG}, {blocks_sql()} SELECT player, block, arg_max(key_index, seq) AS value FROM full_rows WHERE player = 8 GROUP BY 1, 2""",
)
def _(spark, sf):
    return blocks.key_value_by_block(log(spark, sf).where("player = 8"), BLOCK, GAP)


DELTAS = "deltas AS (SELECT *, key_index - lag(key_index) OVER (PARTITION BY player ORDER BY seq) AS d, lag(action) OVER (PARTITION BY player ORDER BY seq) AS prev FROM block_rows)"


@query(
    "key_growth_times",
    f"""WITH RECURSIVE {LOG}, {blocks_sql()}, {DELTAS},
    c AS (SELECT player, block, count(*) FILTER (d > 0) AS v FROM deltas WHERE block < cuts GROUP BY 1, 2)
    SELECT block, {SUMMARY} FROM c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(blocks.key_growth_times(log(spark, sf), BLOCK, GAP))


CREDITED = f"""{LOG}, {blocks_sql()}, {DELTAS}, credited AS (SELECT player, block, prev AS action, CAST(sum(d) AS BIGINT) AS change, count(*) AS times
 FROM deltas WHERE block < cuts AND d > 0 GROUP BY 1, 2, 3)"""


def _action_sql(head: str) -> str:
    columns = ", ".join(
        f"CAST(max({m}) AS DOUBLE) AS max_{m}, CAST(min({m}) AS DOUBLE) AS min_{m}, median({m}) AS median_{m}, round(avg({m}), 4) AS mean_{m}"
        for m in ("change", "times")
    )
    return f"""WITH RECURSIVE {head} SELECT block, action, count(*) AS players, CAST(sum(change) AS DOUBLE) AS total_change, {columns}
    FROM credited GROUP BY 1, 2"""


@query("key_change_by_action", _action_sql(CREDITED))
def _(spark, sf):
    return rounded(blocks.key_change_by_action(log(spark, sf), BLOCK, GAP), 4)


@query("key_change_by_action_open", _action_sql(CREDITED.replace("WHERE block < cuts AND d > 0", "WHERE d > 0")))
def _(spark, sf):
    return rounded(blocks.key_change_by_action(log(spark, sf), BLOCK, GAP, keep_open=True), 4)


@query(
    "key_loss_by_action",
    _action_sql(CREDITED.replace("sum(d)", "sum(-d)").replace("d > 0", "d < 0")),
)
def _(spark, sf):
    return rounded(blocks.key_change_by_action(log(spark, sf), BLOCK, GAP, growth=False), 4)


@query(
    "key_change_one_player",
    f"""WITH RECURSIVE {CREDITED} SELECT player, block, action, change, times,
    CAST(sum(times) OVER (PARTITION BY block) AS BIGINT) AS block_times FROM credited WHERE player = 8""",
)
def _(spark, sf):
    return blocks.key_change_one_player(log(spark, sf), 8, BLOCK, GAP)


@query(
    "chaos_index",
    f"""WITH RECURSIVE {LOG}, {blocks_sql()}, u AS (SELECT *, row_number() OVER (PARTITION BY player, action ORDER BY seq) AS use FROM block_rows),
    c AS (SELECT player, block, count(*) FILTER (use = 1) AS v FROM u WHERE block < cuts GROUP BY 1, 2)
    SELECT block, {SUMMARY} FROM c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(blocks.chaos_index(log(spark, sf), BLOCK, GAP))


@query(
    "chaos_index_all",
    f"""WITH RECURSIVE {LOG}, {blocks_sql()}, u AS (SELECT *, row_number() OVER (PARTITION BY player, action ORDER BY seq) AS use FROM block_rows),
    c AS (SELECT player, block, count(*) FILTER (use = 1) AS v FROM u WHERE block < greatest(cuts, 1) GROUP BY 1, 2)
    SELECT block, {SUMMARY} FROM c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(blocks.chaos_index(log(spark, sf), BLOCK, GAP, keep_short=True))


def changes_sql(key: str) -> str:
    columns = ", ".join(f"median({m}) AS {m}_median, round(avg({m}), 4) AS {m}_mean" for m in blocks.CHANGES)
    return f"SELECT {key}, count(*) AS players, {columns} FROM per_player GROUP BY 1"


def per_player_sql(source: str, key: str, position: str) -> str:
    return f"""per_player AS (SELECT player, {key}, count(*) FILTER (d > 0) AS up_times, coalesce(sum(d) FILTER (d > 0), 0) AS up_volume,
      count(*) FILTER (d < 0) AS down_times, coalesce(-sum(d) FILTER (d < 0), 0) AS down_volume, arg_max(key_index, {position}) AS closing_value,
      count(*) FILTER (p > 0) AS power_times, coalesce(sum(p) FILTER (p > 0), 0) AS power_volume, arg_max(power, {position}) AS closing_power
      FROM {source} GROUP BY 1, 2)"""


@query(
    "key_change_by_time",
    f"""WITH RECURSIVE {FULL}, {blocks_sql("full_log")},
    moved AS (SELECT *, CASE WHEN NOT cut THEN key_index - lag(key_index) OVER w END AS d, CASE WHEN NOT cut THEN power - lag(power) OVER w END AS p
      FROM block_rows WINDOW w AS (PARTITION BY player ORDER BY seq)),
    kept AS (SELECT * FROM moved WHERE block < cuts), {per_player_sql("kept", "block", "seq")} {changes_sql("block")}""",
)
def _(spark, sf):
    return rounded(blocks.key_change_by_time(full_log(spark, sf), BLOCK, GAP), 4)


STAY_WALK = """numbered AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, event_id) AS seq,
      coalesce(lag(ts) OVER (PARTITION BY player ORDER BY ts, event_id), ts) AS before FROM log),
    walk AS (
      SELECT player, seq, CASE WHEN action = 'view' THEN ts END AS entered, 0 AS steps, CAST(NULL AS BIGINT) AS stay FROM numbered WHERE seq = 1
      UNION ALL
      SELECT n.player, n.seq,
        CASE WHEN w.entered IS NULL THEN CASE WHEN n.action = 'view' THEN n.ts END
             WHEN n.action = 'purchase' OR w.steps + 1 >= {w} OR n.ts - n.before > {g} THEN NULL ELSE w.entered END,
        CASE WHEN w.entered IS NULL THEN 0 ELSE w.steps + 1 END,
        CASE WHEN w.entered IS NULL THEN NULL
             WHEN n.action = 'purchase' THEN CASE WHEN n.ts - n.before <= {g} THEN n.ts - w.entered END
             WHEN w.steps + 1 >= {w} OR n.ts - n.before > {g} THEN n.before - w.entered END
      FROM walk w JOIN numbered n ON n.player = w.player AND n.seq = w.seq + 1)""".format(w=WINDOW, g=GAP)


@query(
    "ui_time_ratio",
    f"""WITH RECURSIVE {LOG}, {sessions_sql()},
    {STAY_WALK},
    stays AS (SELECT player, count(stay) AS stays, CAST(coalesce(sum(stay), 0) AS BIGINT) AS stay_secs, median(stay) AS median_stay FROM walk GROUP BY 1),
    active AS (SELECT player, CAST(sum(end_ts - start_ts) AS BIGINT) AS active_secs FROM sessions GROUP BY 1)
    SELECT player, active_secs, stays, stay_secs, median_stay, round(stay_secs / (active_secs + 1), 9) AS ratio FROM active JOIN stays USING (player)""",
)
def _(spark, sf):
    return rounded(blocks.ui_time_ratio(log(spark, sf), "view", "purchase", GAP, WINDOW), 9)


@query(
    "ui_time_ratio_pre_vip",
    f"""WITH RECURSIVE {FULL}, {PRE_VIP}, {sessions_sql("pre_vip")},
    {STAY_WALK.replace("FROM log)", "FROM pre_vip)")},
    stays AS (SELECT player, count(stay) AS stays, CAST(coalesce(sum(stay), 0) AS BIGINT) AS stay_secs, median(stay) AS median_stay FROM walk GROUP BY 1),
    active AS (SELECT player, CAST(sum(end_ts - start_ts) AS BIGINT) AS active_secs FROM sessions GROUP BY 1)
    SELECT player, active_secs, stays, stay_secs, median_stay, round(stay_secs / (active_secs + 1), 9) AS ratio FROM active JOIN stays USING (player)""",
)
def _(spark, sf):
    early = full_log(spark, sf).where("vip_level < 1")
    return rounded(blocks.ui_time_ratio(early, "view", "purchase", GAP, WINDOW), 9)


# Growth by level and day ----------------------------------------------------------------------

BY_LEVEL = """moved AS (SELECT *, key_index - lag(key_index) OVER w AS d, power - lag(power) OVER w AS p
  FROM full_log WINDOW w AS (PARTITION BY player, level ORDER BY rn))"""


@query(
    "key_change_by_level",
    f"WITH {FULL}, {BY_LEVEL}, {per_player_sql('moved', 'level', 'rn')} {changes_sql('level')}",
)
def _(spark, sf):
    return rounded(growth.key_change_by_level(full_log(spark, sf)), 4)


@query(
    "key_growth_by_days",
    f"""WITH {LOG}, {DAILY}, d AS (SELECT player, day_no, arg_max(key_index, (ts, event_id)) AS v FROM daily GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY day_no) - 1 AS seen FROM d)
    SELECT day_no, {SUMMARY} FROM k WHERE seen = day_no GROUP BY 1""",
)
def _(spark, sf):
    return rounded(growth.key_growth_by_days(log(spark, sf), DAY0, DAYS))


def cumulative_sql(sign: str = "", baseline: str = "first") -> str:
    base = "arg_min(key_index, (ts, event_id))"
    if baseline == "prior":
        base = f"coalesce(arg_max(key_index, (ts, event_id)) FILTER (ts < {BEGIN + 86_400}), {base})"
    begin = BEGIN if baseline == "first" else BEGIN + 86_400
    return f"""WITH {LOG}, f AS (SELECT player, {base} AS base FROM log GROUP BY 1),
    r AS (SELECT player, {sign}(key_index - coalesce(lag(key_index) OVER (PARTITION BY player ORDER BY ts, event_id), base)) AS d
      FROM log JOIN f USING (player) WHERE ts BETWEEN {begin} AND {END})
    SELECT player, CAST(coalesce(sum(greatest(d, 0)), 0) AS BIGINT) AS change FROM f LEFT JOIN r USING (player) GROUP BY 1"""


@query("cumulative_change", cumulative_sql())
def _(spark, sf):
    return growth.cumulative_change(log(spark, sf), BEGIN, END)


@query("cumulative_fall", cumulative_sql("-"))
def _(spark, sf):
    return growth.cumulative_change(log(spark, sf), BEGIN, END, growth=False)


@query("cumulative_change_prior", cumulative_sql(baseline="prior"))
def _(spark, sf):
    return growth.cumulative_change(log(spark, sf), BEGIN + 86_400, END, baseline="prior")


BY_DAY = f"""{LOG}, f AS (SELECT player, arg_min(key_index, (ts, event_id)) AS base FROM log GROUP BY 1),
{DAILY}, r AS (SELECT player, day_no, -(key_index - coalesce(lag(key_index) OVER (PARTITION BY player, day_no ORDER BY ts, event_id), base)) AS d
  FROM daily JOIN f USING (player)),
per_day AS (SELECT player, day_no, CAST(sum(greatest(d, 0)) AS BIGINT) AS change FROM r GROUP BY 1, 2)"""


@query(
    "repeat_by_day",
    f"""WITH {BY_DAY} SELECT player, {', '.join(f'CAST(coalesce(sum(change) FILTER (day_no = {d}), 0) AS BIGINT) AS day_{d}' for d in range(DAYS + 1))}
    FROM f LEFT JOIN per_day USING (player) GROUP BY 1""",
)
def _(spark, sf):
    events = log(spark, sf)
    return growth.days_wide(growth.change_by_day(events, DAY0, DAYS, growth=False), events, "change", DAYS)


@query(
    "repeat_play_time_by_day",
    f"""WITH {PLAYED}, {EVERYONE} SELECT player,
    {', '.join(f'CAST(coalesce(sum(duration) FILTER (day_no = {d}), 0) AS BIGINT) AS day_{d}' for d in range(DAYS + 1))}
    FROM everyone LEFT JOIN played USING (player) GROUP BY 1""",
)
def _(spark, sf):
    def played(daily):
        found = sessions.gap_sessions(daily, GAP, ("player", "day_no"))
        return found.groupBy("player", "day_no").agg(F.sum(F.col("end_ts") - F.col("start_ts")).alias("duration"))

    return growth.repeat_by_day(log(spark, sf), played, "duration", DAY0, DAYS)


@query(
    "nth_active_day",
    f"""WITH {BY_DAY}, k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY day_no) AS k FROM per_day WHERE change <> 0)
    SELECT player, {', '.join(f'coalesce(max(change) FILTER (k = {k}), 0) AS active_{k}' for k in (1, 2, 3))}
    FROM f LEFT JOIN k USING (player) GROUP BY 1""",
)
def _(spark, sf):
    events = log(spark, sf)
    return growth.nth_active_day(growth.change_by_day(events, DAY0, DAYS, growth=False), events, "change", 3)


@query(
    "first_last_diff",
    f"""WITH {FULL} SELECT player, arg_max(key_index, rn) - arg_min(key_index, rn) AS key_index_diff,
    arg_max(power, rn) - arg_min(power, rn) AS power_diff FROM full_log GROUP BY 1""",
)
def _(spark, sf):
    return growth.first_last_diff(full_log(spark, sf), ["key_index", "power"])


def _poly_sql(final: str) -> str:
    """The fit by the polynomials that are orthogonal over n even positions, p[k+1] = x p[k] - b[k] p[k-1]."""
    return f"""WITH {LOG}, placed AS (SELECT player, key_index AS y, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY player) AS n
      FROM log WINDOW w AS (PARTITION BY player ORDER BY ts, event_id)),
    b AS (SELECT *, place - (n - 1) / 2 AS x, (n * n - 1) / 12 AS b1, 4 * (n * n - 4) / 60 AS b2, 9 * (n * n - 9) / 140 AS b3, 16 * (n * n - 16) / 252 AS b4 FROM placed),
    p AS (SELECT *, x * x - b1 AS p2, x * x * x - (b1 + b2) * x AS p3, x * x * x * x - (b1 + b2 + b3) * x * x + b1 * b3 AS p4 FROM b),
    c AS (SELECT player, n, any_value(b1) AS b1, any_value(b2) AS b2, any_value(b3) AS b3, sum(y) / n AS c0, CASE WHEN n > 1 THEN sum(y * x) / (n * any_value(b1)) ELSE 0 END AS c1,
      CASE WHEN n > 2 THEN sum(y * p2) / (n * any_value(b1 * b2)) ELSE 0 END AS c2, CASE WHEN n > 3 THEN sum(y * p3) / (n * any_value(b1 * b2 * b3)) ELSE 0 END AS c3,
      CASE WHEN n > 4 THEN sum(y * p4) / (n * any_value(b1 * b2 * b3 * b4)) ELSE 0 END AS c4 FROM p GROUP BY 1, 2),
    m AS (SELECT player, (n - 1) / 2 AS m, c4 AS q4, c3 AS q3, c2 - c4 * (b1 + b2 + b3) AS q2, c1 - c3 * (b1 + b2) AS q1, c0 - c2 * b1 + c4 * b1 * b3 AS q0 FROM c),
    fits AS (SELECT player, q4 AS poly_4, q3 - 4 * m * q4 AS poly_3, q2 - 3 * m * q3 + 6 * m * m * q4 AS poly_2,
      q1 - 2 * m * q2 + 3 * m * m * q3 - 4 * m * m * m * q4 AS poly_1, q0 - m * q1 + m * m * q2 - m * m * m * q3 + m * m * m * m * q4 AS poly_0 FROM m)
    {final}"""


#: Decimals that the sums determine, whatever their order.
POLY_PLACES = {"poly_4": 9, "poly_3": 7, "poly_2": 5, "poly_1": 4, "poly_0": 3}


@query("poly_trend", _poly_sql(f"SELECT player, {', '.join(f'round({c}, {d}) AS {c}' for c, d in POLY_PLACES.items())} FROM fits"))
def _(spark, sf):
    fits = growth.poly_trend(log(spark, sf))
    return fits.select("player", *[F.round(c, d).alias(c) for c, d in POLY_PLACES.items()])


@query(
    "poly_trend_scaled",
    _poly_sql(f"SELECT player, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}' for c in POLY_PLACES)} FROM fits"),
)
def _(spark, sf):
    return rounded(growth.poly_trend(log(spark, sf), scaled=True))


def _ratio_side(side: int) -> str:
    return f"(SELECT level, median(down_volume) / nullif(median(closing_value), 0) AS ratio FROM per_player WHERE player % 2 = {side} AND level <= 30 GROUP BY 1)"


@query(
    "consume_to_keep_ratio",
    f"""WITH {FULL}, {BY_LEVEL}, {per_player_sql('moved', 'level', 'rn')}
    SELECT coalesce(a.level, b.level) AS level, round(a.ratio, 6) AS ratio_even, round(b.ratio, 6) AS ratio_odd
    FROM {_ratio_side(0)} a FULL JOIN {_ratio_side(1)} b ON a.level = b.level""",
)
def _(spark, sf):
    events = full_log(spark, sf)
    even, odd = events.where("player % 2 = 0"), events.where("player % 2 = 1")
    return rounded(growth.consume_to_keep_ratio(even, odd, 30, ("even", "odd")))


# Players --------------------------------------------------------------------------------------


@query("action_distribution", f"WITH {LOG} SELECT player, action, count(*) AS clicks FROM log GROUP BY 1, 2")
def _(spark, sf):
    return players.action_distribution(log(spark, sf))


@query(
    "action_distribution_pre_vip",
    f"WITH {FULL} SELECT player, action, count(*) AS clicks FROM full_log WHERE vip_level < 1 GROUP BY 1, 2",
)
def _(spark, sf):
    return players.action_distribution(full_log(spark, sf), pre_vip=True)


@query(
    "target_action_counts",
    f"WITH {LOG} SELECT player, {', '.join(f'count(*) FILTER (action = {a!r}) AS {a}' for a in ACTIONS)} FROM log GROUP BY 1",
)
def _(spark, sf):
    return players.target_action_counts(log(spark, sf), ACTIONS)


@query(
    "target_action_counts_pre_vip",
    f"WITH {FULL} SELECT player, {', '.join(f'count(*) FILTER (action = {a!r} AND vip_level < 1) AS {a}' for a in ACTIONS)} FROM full_log GROUP BY 1",
)
def _(spark, sf):
    return players.target_action_counts(full_log(spark, sf), ACTIONS, pre_vip=True)


FLAGS = f"""flags AS (SELECT player, arg_max(vip_level, rn) <> 0 AS vip, count(DISTINCT ts // 86400) > {RETAINED_DAYS} AS retained
  FROM full_log GROUP BY 1)"""


@query(
    "separating_actions",
    f"""WITH {FULL}, {FLAGS}, c AS (SELECT player, vip, action, count(*) AS clicks FROM full_log JOIN flags USING (player) WHERE retained GROUP BY 1, 2, 3),
    s AS (SELECT CASE WHEN vip THEN 'vip' ELSE 'not_vip' END AS list, action, median(clicks) AS score FROM c GROUP BY 1, 2
      UNION ALL SELECT 'spread', action, stddev_pop(clicks) FROM c GROUP BY 2),
    top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY list ORDER BY score DESC, action) AS INTEGER) AS rank FROM s) WHERE rank <= 3)
    SELECT list, rank, action, round(score, 6) AS score FROM top
    UNION ALL SELECT 'only_' || list, rank, action, round(score, 6) FROM top t WHERE list <> 'spread'
      AND NOT EXISTS (SELECT 1 FROM top o WHERE o.list <> 'spread' AND o.list <> t.list AND o.action = t.action)""",
)
def _(spark, sf):
    events = settle(profile_log(spark, sf), "log")
    return rounded(players.separating_actions(events, players.vip_and_retained_flags(events, RETAINED_DAYS), 3))


@query(
    "steps_to_vip",
    f"WITH {FULL} SELECT player, count(*) FILTER (vip_level = 0) AS steps FROM full_log GROUP BY 1 HAVING max(vip_level) >= 1",
)
def _(spark, sf):
    return players.steps_to_vip(full_log(spark, sf))


@query(
    "device_pay_rate",
    f"""WITH {FULL}, d AS (SELECT player, device FROM (SELECT player, device, row_number() OVER (PARTITION BY player ORDER BY count(*) DESC, device) AS r
      FROM full_log GROUP BY 1, 2) WHERE r = 1), v AS (SELECT DISTINCT player FROM full_log WHERE vip_level > 0),
    o AS (SELECT d.*, v.player IS NOT NULL AS pays FROM d LEFT JOIN v USING (player)),
    s AS (SELECT device, count(*) AS size, CASE WHEN count(*) >= 10 THEN round(avg(pays::INT), 6) ELSE 0.0 END AS rate FROM o GROUP BY 1)
    SELECT player, device, size, rate FROM o JOIN s USING (device)""",
)
def _(spark, sf):
    events = full_log(spark, sf, device=True)
    return rounded(players.device_pay_rate(events, events.where("vip_level > 0"), 10))


@query("vip_and_retained_flags", f"WITH {FULL}, {FLAGS} SELECT * FROM flags")
def _(spark, sf):
    return players.vip_and_retained_flags(profile_log(spark, sf), RETAINED_DAYS)


@query(
    "flag_crosstab",
    f"""WITH {FULL}, {FLAGS} SELECT vip, retained, count(*) AS players, round(count(*) / sum(count(*)) OVER (PARTITION BY vip), 6) AS share
    FROM flags GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(players.flag_crosstab(players.vip_and_retained_flags(profile_log(spark, sf), RETAINED_DAYS)))


def profile(spark, sf):
    return players.user_profile(
        settle(profile_log(spark, sf), "log"), "view", "purchase", GAP, GAP, GAP, WINDOW, RETAINED_DAYS
    )


@query(
    "user_profile",
    f"""WITH RECURSIVE {FULL}, {PRE_VIP}, {FLAGS}, {sessions_sql("pre_vip", name="early")}, {sessions_sql("log", name="every")}, {STAY_WALK},
    {favourite_sql("pre_vip")}, {FIRST_SLOT},
    freqs AS (SELECT player, median((clicks - 1) / (end_ts - start_ts)) FILTER (end_ts > start_ts) AS freq FROM early GROUP BY 1),
    active AS (SELECT player, sum(end_ts - start_ts) AS secs FROM every GROUP BY 1),
    stays AS (SELECT player, coalesce(sum(stay), 0) AS stay_secs FROM walk GROUP BY 1),
    slots AS (SELECT player, coalesce(f.slot, s.slot) AS slot FROM first_slot s LEFT JOIN favourite f USING (player))
    SELECT player, round(freq, 9) AS freq, vip, retained, round(stay_secs / (secs + 1), 9) AS ratio,
    {', '.join(f"CAST(slot = '{s}' AS INTEGER) AS slot_{s}" for s in players.SLOTS)}
    FROM flags LEFT JOIN freqs USING (player) JOIN active USING (player) JOIN stays USING (player) JOIN slots USING (player)""",
)
def _(spark, sf):
    return rounded(profile(spark, sf), 9)


@query(
    "user_profile_long",
    f"""WITH {PLAYED}, {sessions_sql("log", name="every")}, {episode_sql()}, {EVERYONE},
    rated AS (SELECT *, end_ts - start_ts AS length, session = max(session) OVER (PARTITION BY player) AS is_last FROM every),
    freqs AS (SELECT player, coalesce(median((clicks - 1) / length) FILTER (NOT is_last AND length >= 300),
      max((clicks - 1) / length) FILTER (is_last AND length > 0)) AS freq FROM rated GROUP BY 1),
    days AS (SELECT player, coalesce(arg_min(duration, day_no) FILTER (duration > 0), 0) AS first_day_duration,
      count(*) FILTER (duration > 0) > 1 AS retained FROM everyone LEFT JOIN played USING (player) GROUP BY 1),
    views AS (SELECT player, coalesce(min(ts) FILTER (contains(action, 'purchase')) - min(ts), 0) AS secs FROM log GROUP BY 1),
    k AS (SELECT *, max(CASE WHEN contains(action, 'purchase') THEN seq END)
      OVER (PARTITION BY player ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kr FROM seq),
    payers AS (SELECT DISTINCT k.player FROM k JOIN seq b ON b.player = k.player AND b.seq = k.kr
      WHERE k.seq - kr <= 6 AND k.key_index - b.key_index >= 10000)
    SELECT player, round(freq, 9) AS freq, first_day_duration, retained, secs,
    CASE WHEN ending IN ('exit', 'window') THEN end_ts - enter_ts ELSE 0 END AS stay_secs, player IN (SELECT player FROM payers) AS payer
    FROM freqs JOIN days USING (player) JOIN views USING (player) JOIN episodes USING (player)""",
)
def _(spark, sf):
    long = players.user_profile_long(
        log(spark, sf), "view", "purchase", ["purchase"], DAY0, DAYS, GAP, 300, WINDOW, LIMIT, 10_000, 5
    )
    return rounded(long, 9)


@query("sample_one_per_player")
def _(spark, sf):
    return players.sample_one_per_player(log(spark, sf), seed=7)


# Streaming forms ------------------------------------------------------------------------------


def _event_stream(spark, sf):
    """The log as a stream of files."""
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return as_events(source, player="user_id", ts="ts", event_id="event_id", action="event_type")


@query(
    "stream_sessions",
    f"""WITH {LOG}, {sessions_sql()} SELECT player, start_ts, end_ts, clicks FROM sessions
    WHERE end_ts + {GAP} <= (SELECT max(ts) - 600 FROM log)""",
)
def _(spark, sf):
    return streams.drain(streams.stream_sessions(_event_stream(spark, sf), GAP), "sessions")


@query(
    "stream_enter_ratio",
    f"""WITH {LOG} SELECT ts - ts % 86400 AS begin, count(DISTINCT player) AS active, count(DISTINCT player) FILTER (action = 'view') AS entered,
    round(count(DISTINCT player) FILTER (action = 'view') / count(DISTINCT player), 6) AS ratio FROM log
    WHERE ts - ts % 86400 + 86400 <= (SELECT max(ts) - 600 FROM log) GROUP BY 1""",
)
def _(spark, sf):
    return rounded(streams.drain(streams.stream_enter_ratio(_event_stream(spark, sf), "view"), "ratio"))


@query(
    "stream_active_blocks",
    f"""WITH RECURSIVE {LOG}, {blocks_sql()} SELECT player, block, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS clicks
    FROM full_rows GROUP BY 1, 2""",
)
def _(spark, sf):
    return streams.drain(streams.stream_active_blocks(_event_stream(spark, sf), BLOCK, GAP), "blocks")
