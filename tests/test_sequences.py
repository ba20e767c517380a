"""Sequence operators against the plain loops, on random logs and on hand-made edge rows."""

import random
from collections import Counter, defaultdict
from statistics import mean, median

import numpy as np
import pytest

from playmetrics.operators import blocks, episodes, growth, players, sessions

from . import twins
from .conftest import by_player, make, random_rows, table

SEEDS = [11, 12]
CHUNKS = [24, 100_000]


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("limit", [3, 10])
def test_sessions(spark, seed, limit):
    rows = random_rows(seed)
    events = make(spark, rows)
    assert table(sessions.gap_sessions(events, limit)) == twins.sessions(rows, limit)
    active = defaultdict(int)
    for player, _, start, end, _ in twins.sessions(rows, limit):
        active[player] += end - start
    assert dict(table(sessions.play_time_in_range(events, 0, 10**9, limit))) == dict(active)


def test_gap_of_exactly_the_limit_stays(spark):
    events = make(spark, [dict(player=1, ts=t) for t in (0, 299, 599, 900)])
    assert table(sessions.gap_sessions(events, 300), "start_ts", "end_ts", "clicks") == [(0, 599, 3), (900, 900, 1)]


def test_click_frequency_edges(spark):
    rows = [dict(player=1, ts=5)]  # one row: null
    rows += [dict(player=2, ts=7), dict(player=2, ts=7)]  # no length: null
    rows += [dict(player=3, ts=t) for t in (0, 100, 400, 1000, 1100)]  # one closed session of 400 s
    rows += [dict(player=4, ts=t) for t in (0, 50, 1000, 1050)]  # only the open one is left
    found = dict(table(sessions.click_frequency(make(spark, rows), 300, 300)))
    assert found == {1: None, 2: None, 3: 0.005, 4: 0.02}


def test_click_frequency_pre_vip(spark):
    rows = [dict(player=1, ts=t, vip_level=v) for t, v in ((0, 0), (10, 0), (12, 1), (14, 1))]
    rows += [dict(player=2, ts=t, vip_level=1) for t in (0, 10)]
    assert dict(table(sessions.click_frequency_pre_vip(make(spark, rows), 300))) == {1: 0.1, 2: None}
    slots = dict(table(sessions.favourite_slot(make(spark, rows), pre_vip=True), "player", "slot"))
    assert slots == {1: "night", 2: "night"}


def test_favourite_slot_tie_goes_to_the_slot_seen_first(spark):
    noon, morning = 13 * 3600, 86_400 + 9 * 3600
    events = make(spark, [dict(player=1, ts=noon), dict(player=1, ts=morning)])
    assert table(sessions.favourite_slot(events), "slot", "sessions") == [("noon", 1)]


def test_first_day_and_retention(spark):
    day = 86_400
    rows = [dict(player=1, ts=t) for t in (5, 5, day + 1, day + 61, 3 * day, 3 * day + 10)]
    rows += [dict(player=2, ts=7 * day)]
    found = table(sessions.first_day_and_retention(make(spark, rows), 0, 3))
    assert found == [(1, 60, True), (2, 0, False)]


def test_top_sessions_and_their_rows(spark):
    rows = random_rows(21)
    events = make(spark, rows)
    wanted = []
    kept = {}
    for player in by_player(rows):
        mine = [(-(n - 1) / (e - s), s, e, n) for p, _, s, e, n in twins.sessions(rows, 10) if p == player and e > s]
        for rank, (f, s, e, n) in enumerate(sorted(mine)[:2], 1):
            wanted.append((player, rank, round(-f, 9), s, e, n))
            kept[(player, rank)] = n
    assert table(sessions.max_click_freq(events, 2, 10)) == sorted(wanted)
    actions = Counter((r["player"], r["rank"]) for r in sessions.max_click_freq_actions(events, 2, 10).collect())
    assert dict(actions) == kept


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("chunk", CHUNKS)
def test_blocks(spark, seed, chunk):
    rows, gap, interval = random_rows(seed, rows=300), 9, 15
    events = make(spark, rows)
    full = list(twins.full_blocks(rows, gap, interval))
    assert len(full) > 10
    wanted = sorted((p, b, g[0][0]["ts"], g[-1][0]["ts"], len(g)) for p, b, g in full)
    assert table(blocks.active_blocks(events, interval, gap, chunk)) == wanted
    values = sorted((p, b, g[-1][0]["key_index"]) for p, b, g in full)
    assert table(blocks.key_value_by_block(events, interval, gap, grain=chunk)) == values

    previous = {}
    for history in by_player(rows).values():
        for before, row in zip([None, *history], history):
            previous[row["event_id"]] = before

    def delta(row, column="key_index"):
        before = previous[row["event_id"]]
        return 0 if before is None else row[column] - before[column]

    credited = defaultdict(lambda: [0, 0])
    for p, b, g in full:
        for row, _, _ in g:
            if delta(row) > 0:
                cell = credited[(p, b, previous[row["event_id"]]["action"])]
                cell[0] += delta(row)
                cell[1] += 1
    found = blocks.key_change_per_player(events, interval, gap, grain=chunk)
    assert table(found, "player", "block", "action", "change", "times") == sorted((*k, *v) for k, v in credited.items())

    measures = []
    for p, b, g in full:
        steps = [(0, 0) if cut else (delta(row), delta(row, "power")) for row, _, cut in g]
        last = g[-1][0]
        measures.append(
            (
                p, b, sum(d > 0 for d, _ in steps), sum(max(d, 0) for d, _ in steps), sum(d < 0 for d, _ in steps),
                sum(max(-d, 0) for d, _ in steps), sum(q > 0 for _, q in steps), sum(max(q, 0) for _, q in steps),
                last["key_index"], last["power"],
            )
        )
    found = blocks.key_change_per_player_block(events, interval, gap, chunk)
    assert table(found) == sorted(measures)

    times, novel, used = defaultdict(list), defaultdict(list), set()
    for p, b, g in full:
        times[b].append(sum(delta(row) > 0 for row, _, _ in g))
        new = {(p, row["action"]) for row, _, _ in g} - used
        used |= new
        novel[b].append(len(new))
    for found, per_block in (
        (blocks.key_growth_times(events, interval, gap, chunk), times),
        (blocks.chaos_index(events, interval, gap, grain=chunk), novel),
    ):
        wanted = sorted((b, len(v), min(v), max(v), round(mean(v), 9), median(v)) for b, v in per_block.items())
        assert table(found) == wanted


def test_cut_rules(spark):
    # Active time 0, 6, 12: the row after the one that reaches 10 opens the next block.
    rows = [dict(player=1, ts=t) for t in (0, 6, 12, 18, 1000, 1006, 1012, 1018)]
    found = table(blocks.active_blocks(make(spark, rows), 10, 10), "block", "start_ts", "end_ts", "clicks")
    assert found == [(0, 0, 12, 3), (1, 18, 1012, 4)]


def test_two_rows_in_the_second_of_a_cut(spark):
    rows = [dict(player=1, ts=t) for t in (0, 10, 10, 10, 20, 20)]
    found = table(blocks.active_blocks(make(spark, rows), 10, 10), "block", "start_ts", "end_ts", "clicks")
    assert found == [(0, 0, 10, 2), (1, 10, 20, 3)]


def test_short_players_can_be_kept(spark):
    rows = [dict(player=1, ts=t, key_index=t) for t in (0, 6, 12, 18)] + [dict(player=2, ts=3, key_index=99)]
    events = make(spark, rows)
    assert table(blocks.key_value_by_block(events, 10, 10)) == [(1, 0, 12)]
    assert table(blocks.key_value_by_block(events, 10, 10, keep_short=True)) == [(1, 0, 12), (2, 0, 99)]
    found = blocks.chaos_index(events, 10, 10, keep_short=True)
    assert table(found, "block", "players", "max_value") == [(0, 2, 1)]


def test_the_open_block_can_be_kept(spark):
    rows = [dict(player=1, ts=t, key_index=t) for t in (0, 6, 12, 18, 19)]
    events = make(spark, rows)
    closed = blocks.key_change_per_player(events, 10, 10)
    assert table(closed, "block", "change", "times") == [(0, 12, 2)]
    found = blocks.key_change_per_player(events, 10, 10, keep_open=True)
    assert table(found, "block", "change", "times") == [(0, 12, 2), (1, 7, 2)]


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("pair", [("in", "out"), ("in", "in")])
def test_episodes(spark, seed, chunk, pair):
    rows = random_rows(seed, players=8)
    events = make(spark, rows)
    for window, limit in ((4, 20), (None, 20), (4, None), (None, None)):
        found = episodes.first_episode(events, *pair, window, limit, chunk)
        wanted = {p: twins.episode(h, *pair, window, limit) for p, h in by_player(rows).items()}
        assert {r["player"]: (r["ending"], r["enter_ts"], r["end_ts"], r["stay_clicks"]) for r in found.collect()} == wanted
    loss = episodes.ui_loss(events, *pair, 4, 20, chunk).collect()[0]
    ends = [e for e in (twins.episode(h, *pair, 4, 20) for h in by_player(rows).values()) if e[0] != "none"]
    assert loss["entered"] == len(ends)
    assert loss["loss_rate"] == pytest.approx(sum(e[0] != "exit" for e in ends) / len(ends))
    assert loss["mean_stay_clicks"] == pytest.approx(mean(e[3] for e in ends))
    per_action = defaultdict(list)
    for history in by_player(rows).values():
        kind, *_ , clicks = twins.episode(history, *pair, None, None)
        if kind == "exit":
            start = next(i for i, r in enumerate(history) if r["action"] == pair[0])
            for action, n in Counter(r["action"] for r in history[start + 1 : start + 1 + clicks]).items():
                per_action[action].append(n)
    found = table(episodes.ui_stay_actions(events, *pair, chunk))
    assert found == sorted((a, len(v), sum(v), round(mean(v), 9), median(v)) for a, v in per_action.items())


def test_episode_edges(spark):
    rows = []
    for player, steps in {
        1: [(0, "a"), (1, "a")],  # never enters
        2: [(0, "out"), (1, "in"), (2, "a")],  # exits before entering, then stops
        3: [(0, "in"), (50, "a"), (51, "a")],  # elapsed exactly the limit, then over it
        4: [(0, "in"), (1, "a"), (2, "a"), (3, "a")],  # k reaches the window
        5: [(0, "in"), (1, "a"), (50, "a"), (50, "a")],  # window met only at exactly the limit: neither applies
    }.items():
        rows += [dict(player=player, ts=t, action=a) for t, a in steps]
    found = episodes.ui_stay_time(make(spark, rows), "in", "out", 3, 50)
    assert table(found) == [(1, "none", 0), (2, "unfinished", 0), (3, "timeout", 0), (4, "window", 3), (5, "unfinished", 0)]


def test_report_has_one_row_per_pair(spark):
    rows = random_rows(31, players=8)
    events = make(spark, rows)
    pairs = [("in", "out"), ("pay", "a")]
    found = {r["pair"]: r for r in episodes.ui_report(events, pairs, 0, 10**6, 4, 20, 9).collect()}
    for i, (enter, leave) in enumerate(pairs):
        one = episodes.ui_loss(events, enter, leave, 4, 20).collect()[0]
        assert all(found[i][c] == one[c] for c in one.asDict())
        assert found[i]["enter_ratio"] == episodes.ui_enter_ratio(events, enter, 0, 10**6).collect()[0]["ratio"]


def test_enter_ratio_without_players(spark):
    events = make(spark, [dict(player=1, ts=5)])
    assert episodes.ui_enter_ratio(events, "in", 100, 200).collect()[0]["ratio"] == -1.0


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("chunk", CHUNKS)
def test_runs(spark, seed, chunk):
    rows = random_rows(seed, players=6)
    rows = [{**r, "action": "b" if r["action"] in ("a", "b", "in") else r["action"]} for r in rows]
    best = []
    for player, history in by_player(rows).items():
        mine = {}
        for no, (action, times, before) in enumerate(twins.runs(history)):
            repeats = len(times) - 1
            if repeats and times[-1] - times[1] < 12 and repeats > mine.get(action, (0,))[0]:
                mine[action] = (repeats, -no, times[-1] - times[1], before, times[0])
        ranked = sorted(mine.items(), key=lambda kv: (-kv[1][0], -kv[1][1]))[:2]
        best += [(player, a, v[0], v[2], v[3], v[4]) for a, v in ranked]
    found = episodes.repeat_runs(make(spark, rows), 12, 2, chunk)
    assert table(found, "player", "action", "repeats", "duration", "preceding", "start_ts") == sorted(
        best, key=lambda t: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in t)
    )


def test_long_run_is_left_out(spark):
    rows = [dict(player=1, ts=t, action="a") for t in (0, 1, 602)] + [dict(player=2, ts=t, action="a") for t in (0, 1, 600)]
    assert table(episodes.repeat_runs(make(spark, rows)), "player", "repeats", "duration") == [(2, 2, 599)]


def test_runs_up_to_the_next_action(spark):
    clicks = [(0, "a"), (5, "a"), (9, "b"), (20, "a"), (30, "a"), (40, "a")]
    events = make(spark, [dict(player=1, ts=t, action=a) for t, a in clicks[:4]] + [dict(player=2, ts=t, action=a) for t, a in clicks])
    found = table(episodes.repeat_runs(events, None, to_next=True), "player", "repeats", "duration", "preceding")
    # Player 1's run ends at the next action; player 2's longest is the last one and ends at its last click.
    assert found == [(1, 1, 9, None), (2, 2, 20, "b")]


def test_enter_ratio_of_each_day(spark):
    rows = [dict(player=p, ts=t, action=a) for p, t, a in ((1, 1, "in"), (2, 2, "a"), (2, 86_400, "in"), (3, 2 * 86_400 + 1, "in"))]
    found = table(episodes.ui_enter_ratio_by_day(make(spark, rows), "in", 0, 2))
    assert found == [(0, 2, 1, 0.5), (1, 0, 0, -1.0), (2, 1, 1, 1.0)]


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("chunk", CHUNKS)
def test_payers_conversion_and_stays(spark, seed, chunk):
    rows = random_rows(seed, players=7)
    events, histories = make(spark, rows), by_player(rows)
    wanted = {p: twins.payers(h, "pay", 4, 3) for p, h in histories.items()}
    found = dict(table(episodes.find_payers(events, ["pay"], 4, 3, grain=chunk)))
    assert found == {p: s for p, s in wanted.items() if s is not None}
    wanted = sorted((p, a, n) for p, h in histories.items() for a, n in twins.before_conversion(h, {"pay"}).items())
    assert table(episodes.pre_conversion_actions(events, ["pay"], chunk)) == wanted
    for pair in (("in", "out"), ("in", "in")):
        wanted = sorted((p, s) for p, h in histories.items() for s in twins.stays(h, *pair, 10, 4))
        assert table(blocks.ui_stays(events, *pair, 10, 4, chunk), "player", "stay") == wanted


def test_payer_window(spark):
    def history(player, hit):
        steps = [("pay", 0)] + [("a", 0)] * (hit - 1) + [("a", 100)]
        return [dict(player=player, ts=i, action=a, key_index=v) for i, (a, v) in enumerate(steps)]

    found = table(episodes.find_payers(make(spark, history(1, 6) + history(2, 7)), ["pay"]))
    assert found == [(1, 6)]


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("chunk", CHUNKS)
def test_growth(spark, seed, chunk):
    rows = random_rows(seed)
    events, histories = make(spark, rows), by_player(rows)
    measures = []
    for p, history in histories.items():
        for level in {r["level"] for r in history}:
            mine = [r for r in history if r["level"] == level]
            d = [b["key_index"] - a["key_index"] for a, b in zip(mine, mine[1:])]
            q = [b["power"] - a["power"] for a, b in zip(mine, mine[1:])]
            measures.append(
                (
                    p, level, sum(x > 0 for x in d), sum(max(x, 0) for x in d), sum(x < 0 for x in d), sum(max(-x, 0) for x in d),
                    sum(x > 0 for x in q), sum(max(x, 0) for x in q), mine[-1]["key_index"], mine[-1]["power"],
                )
            )
    assert table(growth.key_change_per_player_level(events, chunk)) == sorted(measures)
    for lo, hi in ((20, 150), (0, 10**6)):
        for baseline in ("first", "prior"):
            for rise in (True, False):
                wanted = []
                for p, history in histories.items():
                    before = [r for r in history if r["ts"] < lo]
                    last = (before[-1] if baseline == "prior" and before else history[0])["key_index"]
                    total = 0
                    for r in history:
                        if lo <= r["ts"] <= hi:
                            total += max((r["key_index"] - last) * (1 if rise else -1), 0)
                            last = r["key_index"]
                    wanted.append((p, total))
                found = growth.cumulative_change(events, lo, hi, rise, baseline, grain=chunk)
                assert table(found) == sorted(wanted)


def test_days(spark):
    day = 86_400
    rows = [dict(player=1, ts=d * day + t, key_index=10 * d + t) for d in (0, 1, 3) for t in (0, 5)]
    rows += [dict(player=2, ts=day, key_index=7), dict(player=3, ts=2 * day - 1, key_index=4)]
    rows += [dict(player=3, ts=0, key_index=1)]
    events = make(spark, rows)
    # Day 2 has nobody left, so the result ends at day 1; player 2 was absent on day 0.
    found = table(growth.key_growth_by_days(events, 0, 3), "day_no", "players", "min_value", "max_value", "median_value")
    assert found == [(0, 2, 1.0, 5.0, 3.0), (1, 2, 4.0, 15.0, 9.5)]
    changes = growth.change_by_day(events, 0, 3)
    assert table(growth.days_wide(changes, events, "change", 3)) == [(1, 5, 15, 0, 35), (2, 0, 0, 0, 0), (3, 0, 3, 0, 0)]
    assert table(growth.nth_active_day(changes, events, "change", 3)) == [(1, 5, 15, 35), (2, 0, 0, 0), (3, 3, 0, 0)]


def test_poly_trend_equals_a_least_squares_fit(spark):
    rng = random.Random(6)
    values = {1: [2 * i**3 - i + 4 for i in range(40)], 2: [rng.randrange(900) for _ in range(57)], 3: [rng.randrange(9) for _ in range(6)]}
    values |= {4: [5, 9, 1], 5: [7, 3], 6: [8], 7: [4, 0, 2, 2]}
    rows = [dict(player=p, ts=i, key_index=v) for p, mine in values.items() for i, v in enumerate(mine)]
    for grain in (20, 1000):
        found = {r["player"]: r for r in growth.poly_trend(make(spark, rows), grain=grain).collect()}
        for p, mine in values.items():
            degree = min(4, len(mine) - 1)
            wanted = [0] * (4 - degree) + np.polyfit(range(len(mine)), mine, degree).tolist()
            assert [found[p][f"poly_{k}"] for k in (4, 3, 2, 1, 0)] == pytest.approx(wanted, rel=1e-6, abs=1e-5)


def test_players(spark):
    rows = random_rows(41)
    events, histories = make(spark, rows), by_player(rows)
    counts = sorted((p, a, n) for p, h in histories.items() for a, n in Counter(r["action"] for r in h).items())
    assert table(players.action_distribution(events)) == counts
    nested = {r["player"]: sum(x["n"] for x in r["actions"]) for r in players.action_distribution_nested(events).collect()}
    assert nested == {p: len(h) for p, h in histories.items()}
    found = table(players.target_action_counts(events, ["pay", "none"], pre_vip=True))
    assert found == sorted((p, sum(r["action"] == "pay" and r["vip_level"] < 1 for r in h), 0) for p, h in histories.items())
    vip = {p: sum(r["vip_level"] == 0 for r in h) for p, h in histories.items() if h[-1]["vip_level"]}
    assert dict(table(players.steps_to_vip(events))) == vip
    flags = {r["player"]: (r["vip"], r["retained"]) for r in players.vip_and_retained_flags(events, 2).collect()}
    assert flags == {p: (h[-1]["vip_level"] != 0, h[-1]["num_days_played"] > 2) for p, h in histories.items()}
    share = {(r["vip"], r["retained"]): r["players"] for r in players.flag_crosstab(players.vip_and_retained_flags(events, 2)).collect()}
    assert share == Counter(flags.values())
    first = table(players.sample_one_per_player(events, 5), "player", "event_id")
    assert first == table(players.sample_one_per_player(events.repartition(3, "action"), 5), "player", "event_id")
    ids = {r["event_id"]: r["player"] for r in rows}
    assert all(ids[e] == p for p, e in first) and len(first) == len(histories)


def test_device_rate(spark):
    rows = [dict(player=p, ts=0, device="x" if p < 12 else "y") for p in range(15)]
    rows.append(dict(player=0, ts=1, device="a"))  # a tie: the smaller name wins
    events = make(spark, rows)
    found = table(players.device_pay_rate(events, events.where("player in (1, 2, 13)"), 10), "player", "device", "size", "rate")
    assert found[0] == (0, "a", 1, 0.0) and found[1] == (1, "x", 11, round(2 / 11, 9)) and found[14] == (14, "y", 3, 0.0)


def test_last_player_and_row_order_do_not_matter(spark):
    rows = [dict(player=1, ts=0)] + [dict(player=9, ts=t, action=a) for t, a in ((1, "in"), (2, "a"), (3, "out"))]
    events = make(spark, rows)
    assert table(episodes.ui_stay_actions(events, "in", "out"), "action", "total_clicks") == [("a", 1.0)]
    assert (9, "a", 1) in table(players.action_distribution(events))


def test_profile_has_every_player(spark):
    rows = random_rows(51, players=9)
    events = make(spark, rows)
    for chunk in CHUNKS:
        found = players.user_profile(events, "in", "out", 10, 10, 10, 4, 2, chunk).collect()
        assert sorted(r["player"] for r in found) == sorted(by_player(rows))
        assert all(sum(r[f"slot_{s}"] for s in players.SLOTS) == 1 for r in found)


def test_consume_to_keep_ratio_of_two_populations(spark):
    rows = random_rows(61)
    events, fallen, kept = make(spark, rows), defaultdict(list), defaultdict(list)
    for p, h in by_player(rows).items():
        for level in {r["level"] for r in h if r["level"] <= 4}:
            mine = [r["key_index"] for r in h if r["level"] == level]
            fallen[level, p % 2].append(sum(max(a - b, 0) for a, b in zip(mine, mine[1:])))
            kept[level, p % 2].append(mine[-1])
    ratio = {at: np.median(v) / np.median(kept[at]) if np.median(kept[at]) else None for at, v in fallen.items()}
    wanted = sorted((level, *(None if ratio.get((level, i)) is None else round(ratio[level, i], 9) for i in (0, 1))) for level in {at[0] for at in ratio})
    found = growth.consume_to_keep_ratio(events.where("player % 2 = 0"), events.where("player % 2 = 1"), 4)
    assert sorted(table(found, "level", "ratio_left", "ratio_right")) == wanted and len(wanted) > 1
