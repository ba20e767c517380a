"""Sources, column edits, joins, aggregates, sorts and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import day_slot, has_keyword, is_close, last_segment, match
from ..operators import frames, stats
from ..operators.sessions import play_span
from ..plans.quantiles import group_stats
from ..sources import tables as io
from ..sources.tables import work_dir
from ..sources.events import calendar_ranges, epoch_seconds, hour_of
from .registry import BEGIN, DAY0, LOG, log, query, rounded, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Sources and sinks ----------------------------------------------------------------------------


@query("a1_table_scan", f"WITH {LOG} SELECT player, ts, event_id, action, key_index FROM log")
def _(spark, sf):
    return log(spark, sf).select("player", "ts", "event_id", "action", "key_index")


@query("a2_whole_table", "SELECT * FROM part")
def _(spark, sf):
    return table(spark, sf, "part")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("a3_csv_read", f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(*ORDER_COLUMNS)
    path = io.write_result(orders, work_dir(spark, "csv"), "now", "csv")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return io.read_csv(spark, path, schema)


@query(
    "a4_labelled_lines",
    """SELECT l_orderkey AS id, l_quantity AS x1, l_discount AS x2, l_tax AS x3, CAST(l_linenumber AS DOUBLE) AS label
    FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws(",", "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_linenumber").alias("value")
    )
    header = spark.sql("SELECT 'id,quantity,discount,tax,label' AS value")
    path = f"{work_dir(spark, 'lines')}/text"
    header.unionByName(lines).write.text(path)
    parsed = io.read_labelled_lines(spark, path)
    return parsed.select("id", *[F.col("features")[i].alias(f"x{i + 1}") for i in range(3)], "label")


@query(
    "a5_name_list",
    """WITH names AS (SELECT DISTINCT trim(p_name) AS n FROM part)
    SELECT DISTINCT n || '/Btn_' || i AS name FROM names, range(15) t(i)
    UNION SELECT n FROM names""",
)
def _(spark, sf):
    name = F.col("p_name")
    lines = table(spark, sf, "part").select(
        F.explode(F.array(F.concat(name, F.lit("/Btn_{0}")), F.concat(F.lit(" "), name))).alias("value")
    )
    return io.expand_names(lines)


@query(
    "a6_result_sink",
    "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def _(spark, sf):
    result = (
        table(spark, sf, "orders")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )
    root = work_dir(spark, "results")
    io.write_result(result, root, "first")
    return spark.read.schema(result.schema).parquet(root).where("run = 'first'").select(*result.columns)


@query("a7_one_player", f"WITH {LOG} SELECT player, ts, event_id, action, key_index FROM log WHERE player = 8")
def _(spark, sf):
    path = f"{work_dir(spark, 'player')}/rows"
    io.write_player(log(spark, sf).select("player", "ts", "event_id", "action", "key_index"), 8, path)
    return spark.read.parquet(path)


# Columns, filters, scalar functions -----------------------------------------------------------


@query("b1_projection", "SELECT c_custkey AS customer, c_acctbal AS balance FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance"))


@query("b2_cohort_filter", "SELECT p_partkey, p_size FROM part WHERE p_size = 2 OR p_size > 40")
def _(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").where((size == 2) | (size > 40)).select("p_partkey", "p_size")


@query(
    "b3_action_match",
    f"""WITH {LOG} SELECT action, action = 'view' AS is_view, action IN ('view', 'click') AS in_list,
    action NOT IN ('view', 'click') AS not_in_list, contains('purchase,click', action) AS in_text, count(*) AS rows
    FROM log GROUP BY ALL""",
)
def _(spark, sf):
    tests = {
        "is_view": match("action", "view"),
        "in_list": match("action", ["view", "click"], "in"),
        "not_in_list": match("action", ["view", "click"], "not_in"),
        "in_text": match("action", "purchase,click", "substring"),
    }
    counted = log(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("action", *[test.alias(name) for name, test in tests.items()], "rows")


@query(
    "b4_any_keyword",
    "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'small')",
)
def _(spark, sf):
    return table(spark, sf, "part").where(has_keyword("p_name", ["ring", "small"])).select("p_partkey", "p_name")


@query(
    "b5_drop_boot",
    """SELECT p_partkey, kind FROM (SELECT p_partkey, nullif(p_type, 'ECONOMY') AS kind FROM part)
    WHERE kind IS NOT NULL AND kind <> 'STANDARD'""",
)
def _(spark, sf):
    kinds = table(spark, sf, "part").select("p_partkey", F.nullif("p_type", F.lit("ECONOMY")).alias("kind"))
    return frames.without_boot(kinds, "kind", "STANDARD")


@query(
    "b6_drop_outliers",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (1, 2, 3)
    AND o_totalprice < (SELECT max(o_totalprice) FROM orders WHERE o_custkey NOT IN (1, 2, 3))""",
)
def _(spark, sf):
    kept = frames.without_outliers(table(spark, sf, "orders"), "o_custkey", [1, 2, 3])
    return frames.without_maximum(kept, "o_totalprice").select("o_orderkey", "o_totalprice")


@query(
    "b7_conditional_column",
    """SELECT p_partkey, CASE WHEN p_size > 16 THEN 'YES' WHEN p_size <= 16 THEN 'NO' END AS large FROM part""",
)
def _(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.when(size > 16, "YES").when(size <= 16, "NO").alias("large"))


@query(
    "b8_membership",
    """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS found FROM customer""",
)
def _(spark, sf):
    open_orders = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return frames.membership(table(spark, sf, "customer").select("c_custkey"), open_orders, "c_custkey")


@query(
    "b9_sentinel",
    """SELECT p_partkey, CASE WHEN p_size = 7 THEN 2 ELSE p_size END AS p_size FROM part""",
)
def _(spark, sf):
    marked = (
        table(spark, sf, "part")
        .select("p_partkey", F.when(F.col("p_size") == 7, -999999).otherwise(F.col("p_size")).alias("p_size"))
    )
    return frames.replace_sentinel(marked, -999999, 2)


@query(
    "b10_isclose",
    """SELECT o_orderkey, abs(o_totalprice - 112946.26) <= 1e-8 + 1e-5 * abs(112946.26) AS near FROM orders""",
)
def _(spark, sf):
    near = is_close(F.col("o_totalprice"), F.lit(112946.26))
    return table(spark, sf, "orders").select("o_orderkey", near.alias("near"))


@query(
    "b11_masked_log",
    """SELECT p_partkey, near, CASE WHEN near THEN 0.0 ELSE round(ln(p_retailprice), 6) END AS log_price
    FROM (SELECT *, abs(p_retailprice - 900.0) <= 1e-8 + 1e-5 * abs(900.0) AS near FROM part)""",
)
def _(spark, sf):
    split = frames.split_common_value(table(spark, sf, "part"), "p_retailprice", 900.0, "near", "log_price")
    return rounded(split.select("p_partkey", "near", "log_price"))


@query(
    "b12_zero_count",
    """SELECT l_orderkey, l_linenumber, CAST((l_quantity = 0)::INT + (l_extendedprice = 0)::INT + (l_discount = 0)::INT
    + (l_tax = 0)::INT AS INTEGER) AS zeros FROM lineitem""",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", frames.zero_count(LINE).alias("zeros"))


@query(
    "b13_day_slot",
    f"""WITH {LOG}, h AS (SELECT (ts % 86400) // 3600 AS hour FROM log)
    SELECT CAST(hour AS INTEGER) AS hour, CASE WHEN hour BETWEEN 8 AND 12 THEN 'morning' WHEN hour IN (13, 14) THEN 'noon'
    WHEN hour BETWEEN 15 AND 18 THEN 'afternoon' ELSE 'night' END AS slot, count(*) AS rows FROM h GROUP BY ALL""",
)
def _(spark, sf):
    hours = log(spark, sf).groupBy(hour_of(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("rows"))
    return hours.select("hour", day_slot(F.col("hour")).alias("slot"), "rows")


@query(
    "b14_dates",
    """SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS secs,
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    return orders.select("o_orderkey", epoch_seconds(orders, "o_orderdate").alias("secs"), days.alias("days"))


@query(
    "b15_calendar",
    f"""WITH {LOG}, slots AS (SELECT i AS slot, {BEGIN} + i * 3600 AS "begin", {BEGIN} + (i + 1) * 3600 AS "end" FROM range(96) t(i))
    SELECT slot, "begin", "end", count(log.ts) AS rows FROM slots LEFT JOIN log ON ts >= "begin" AND ts < "end" GROUP BY ALL""",
)
def _(spark, sf):
    return calendar_ranges(log(spark, sf), DAY0, 3, "hour")


@query("b16_rename", "SELECT n_name AS nation, n_regionkey AS region FROM nation")
def _(spark, sf):
    renamed = table(spark, sf, "nation").withColumnsRenamed({"n_name": "nation", "n_regionkey": "region"})
    return renamed.drop("n_nationkey").select("nation", "region")


@query(
    "b17_recode",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS status FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", frames.recode("o_orderstatus", {"F": 0, "O": 1, "P": 2}).alias("status"))


@query("b18_last_segment", "SELECT page_id, split_part(url, '/', -1) AS tail FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", last_segment("url").alias("tail"))


@query(
    "b19_padded_series",
    f"""WITH {LOG}, n AS (SELECT player, row_number() OVER (PARTITION BY player ORDER BY ts, event_id) AS position, key_index FROM log),
    e AS (SELECT player, max(position) AS size, arg_max(key_index, position) AS key_index FROM n GROUP BY player)
    SELECT player, position, key_index FROM n
    UNION ALL SELECT player, i AS position, key_index FROM e, range(1, 101) t(i) WHERE i > size""",
)
def _(spark, sf):
    return frames.padded_series(log(spark, sf), "key_index", 100)


@query(
    "b20_null_summary",
    """WITH t AS (SELECT p_partkey, nullif(p_size, 7) AS p_size, nullif(p_type, 'ECONOMY') AS p_type FROM part)
    SELECT 'p_partkey' AS "column", 'bigint' AS type, count(*) - count(p_partkey) AS nulls, count(p_partkey) AS present FROM t
    UNION ALL SELECT 'p_size', 'int', count(*) - count(p_size), count(p_size) FROM t
    UNION ALL SELECT 'p_type', 'string', count(*) - count(p_type), count(p_type) FROM t""",
)
def _(spark, sf):
    return stats.null_summary(_with_nulls(spark, sf))


def _with_nulls(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size"), F.nullif("p_type", F.lit("ECONOMY")).alias("p_type")
    )


@query(
    "b21_row_sum",
    """SELECT l_orderkey, l_linenumber, round(l_discount + l_tax, 6) AS off,
    CASE WHEN l_discount + l_tax >= 0.1 THEN 'YES' ELSE 'NO' END AS big FROM lineitem""",
)
def _(spark, sf):
    off = F.col("l_discount") + F.col("l_tax")
    big = F.when(off >= 0.1, "YES").otherwise("NO")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", off.alias("off"), big.alias("big")))


@query(
    "b22_ratio_in_range",
    """SELECT p_size, round(max(p_retailprice) / min(p_retailprice), 6) AS ratio FROM part GROUP BY 1 HAVING p_size <= 30""",
)
def _(spark, sf):
    by_size = table(spark, sf, "part").where("p_size <= 30").groupBy("p_size")
    return rounded(by_size.agg((F.max("p_retailprice") / F.min("p_retailprice")).alias("ratio")))


@query(
    "b23_drop_nulls",
    """SELECT p_partkey, p_size, p_type FROM part WHERE p_size <> 7 AND p_type <> 'ECONOMY'""",
)
def _(spark, sf):
    return frames.drop_null_rows(_with_nulls(spark, sf))


@query(
    "b24_impute",
    """WITH t AS (SELECT p_partkey, nullif(p_size, 7)::DOUBLE AS p_size, nullif(p_type, 'ECONOMY') AS p_type,
    CASE WHEN p_size <> 9 THEN p_retailprice END AS p_retailprice FROM part)
    SELECT p_partkey, coalesce(p_size, (SELECT median(p_size) FROM t)) AS p_size,
    coalesce(p_type, (SELECT p_type FROM t WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS p_type,
    round(coalesce(p_retailprice, (SELECT avg(p_retailprice) FROM t)), 6) AS p_retailprice FROM t""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.nullif("p_size", F.lit(7)).cast("double").alias("p_size"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("p_type"),
        F.when(F.col("p_size") != 9, F.col("p_retailprice")).alias("p_retailprice"),
    )
    filled = frames.impute(part, "p_size", "median")
    filled = frames.impute(filled, "p_type", "mode")
    return rounded(frames.impute(filled, "p_retailprice", "mean"))


# Joins ----------------------------------------------------------------------------------------


@query(
    "d1_inner_join",
    "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(customer, "c_custkey")


@query(
    "d2_left_join",
    """SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left").na.fill(0, ["orders"])


@query(
    "d3_attach_by_player",
    f"""WITH {LOG} SELECT a.player, a.rows, b.span FROM (SELECT player, count(*) AS rows FROM log GROUP BY 1) a
    JOIN (SELECT player, max(ts) - min(ts) AS span FROM log GROUP BY 1) b USING (player)""",
)
def _(spark, sf):
    events = log(spark, sf)
    rows = events.groupBy("player").agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(play_span(events), "player")


@query(
    "d4_semi_anti",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer""",
)
def _(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey")
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    have = customer.join(buyers, "c_custkey", "left_semi").withColumn("buys", F.lit(True))
    return have.unionByName(customer.join(buyers, "c_custkey", "left_anti").withColumn("buys", F.lit(False)))


@query(
    "d5_two_populations",
    """SELECT coalesce(a.level, b.level) AS level, a.total AS total_even, b.total AS total_odd FROM
    (SELECT o_orderpriority AS level, count(*) AS total FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) a
    FULL JOIN (SELECT o_orderpriority AS level, count(*) AS total FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1) b
    ON a.level = b.level""",
)
def _(spark, sf):
    counted = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("level"), (F.col("o_custkey") % 2).alias("side"))
        .agg(F.count(F.lit(1)).alias("total"))
    )
    return frames.by_level_full(counted.where("side = 0"), counted.where("side = 1"), "level", "total", ("even", "odd"))


# Aggregations ---------------------------------------------------------------------------------


@query(
    "e1_group_mean",
    "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_discount), 6) AS mean_l_discount FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    return rounded(stats.group_mean(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"]))


@query(
    "e2_block_summary",
    """SELECT l_linenumber, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
    round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS p50 FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    found = group_stats(table(spark, sf, "lineitem"), ["l_linenumber"], ["l_extendedprice"])
    return rounded(found.select("l_linenumber", "n", "min", "max", "mean", "p50"), 4)


def _describe_sql(column: str, source: str = "lineitem", keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}'{column}' AS measure, count({column}) AS n, round(avg({column}), 4) AS mean,
    round(stddev_samp({column}), 4) AS std, round(min({column}), 4) AS min, round(quantile_cont({column}, 0.25), 4) AS p25,
    round(quantile_cont({column}, 0.5), 4) AS p50, round(quantile_cont({column}, 0.75), 4) AS p75,
    round(max({column}), 4) AS max FROM {source}{tail}"""


@query("e3_describe", " UNION ALL ".join(_describe_sql(c) for c in LINE))
def _(spark, sf):
    return rounded(stats.describe(table(spark, sf, "lineitem"), LINE), 4)


@query("e3_describe_by_group", _describe_sql("l_quantity", keys="l_returnflag"))
def _(spark, sf):
    return rounded(stats.describe(table(spark, sf, "lineitem"), ["l_quantity"], ["l_returnflag"]), 4)


@query("e4_value_counts", "SELECT p_type, count(*) AS rows FROM part GROUP BY 1")
def _(spark, sf):
    return stats.value_counts(table(spark, sf, "part"), "p_type").orderBy(F.col("rows").desc())


@query(
    "e5_mode",
    """SELECT p_brand, p_type, rows FROM (SELECT p_brand, p_type, count(*) AS rows,
    row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r = 1""",
)
def _(spark, sf):
    return stats.most_common(table(spark, sf, "part"), ["p_brand"], "p_type")


@query("e6_latest_row", f"WITH {LOG} SELECT ts, event_id, player FROM log ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(spark, sf):
    return stats.latest_row(log(spark, sf), ["ts", "event_id"], ["player"])


@query(
    "e7_distinct_count",
    "SELECT count(DISTINCT o_custkey) AS distinct_o_custkey, count(DISTINCT o_orderpriority) AS distinct_o_orderpriority FROM orders",
)
def _(spark, sf):
    return stats.distinct_count(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@query(
    "e8_first_last",
    f"""WITH {LOG} SELECT player, arg_min(key_index, (ts, event_id)) AS first_key_index,
    arg_max(key_index, (ts, event_id)) AS last_key_index FROM log GROUP BY 1""",
)
def _(spark, sf):
    return stats.first_last(log(spark, sf), ["key_index"])


@query(
    "e9_group_rate",
    """SELECT p_size, count(*) AS size, CASE WHEN count(*) >= 40 THEN round(avg((p_type = 'ECONOMY')::INT), 6) ELSE 0.0 END AS rate
    FROM part GROUP BY 1""",
)
def _(spark, sf):
    return rounded(stats.group_rate(table(spark, sf, "part"), "p_size", F.col("p_type") == "ECONOMY", 40))


@query(
    "e10_count_spread",
    f"""WITH {LOG}, c AS (SELECT player, action, count(*) AS rows FROM log GROUP BY 1, 2)
    SELECT action, count(*) AS owners, median(rows) AS median_rows, round(stddev_pop(rows), 6) AS std_rows FROM c GROUP BY 1""",
)
def _(spark, sf):
    return rounded(stats.count_spread(log(spark, sf), "player", "action"))


@query(
    "e11_nonzero_median",
    " UNION ALL ".join(
        f"SELECT '{c}' AS measure, count(nullif({c}, 0)) AS n, round(median(nullif({c}, 0)), 6) AS median FROM lineitem"
        for c in ("l_discount", "l_tax")
    ),
)
def _(spark, sf):
    return rounded(stats.nonzero_median(table(spark, sf, "lineitem"), ["l_discount", "l_tax"]))


@query(
    "e12_conditional_counts",
    """SELECT l_returnflag, count(*) FILTER (l_tax = 0) AS no_tax, count(*) FILTER (l_quantity > 25) AS large FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    conditions = {"no_tax": F.col("l_tax") == 0, "large": F.col("l_quantity") > 25}
    return stats.conditional_counts(table(spark, sf, "lineitem"), conditions, ["l_returnflag"])


def _pairs_sql(fn, name: str, places: int = 6) -> str:
    parts = []
    for i, a in enumerate(LINE):
        for b in LINE[i:]:
            parts.append(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round({fn(a, b)}, {places}) + 0.0 AS {name} FROM lineitem")
    return " UNION ALL ".join(parts)


@query("e13_correlation", _pairs_sql(lambda a, b: f"corr({a}, {b})", "corr"))
def _(spark, sf):
    return rounded(stats.correlations(table(spark, sf, "lineitem"), LINE))


@query("e14_covariance", _pairs_sql(lambda a, b: f"covar_pop({a}, {b})", "cov", 2))
def _(spark, sf):
    return rounded(stats.covariances(table(spark, sf, "lineitem"), LINE), 2)


@query("e14_second_moments", _pairs_sql(lambda a, b: f"avg({a} * {b})", "cov", 2))
def _(spark, sf):
    return rounded(stats.covariances(table(spark, sf, "lineitem"), LINE, assume_centered=True), 2)


@query(
    "e15_pearson",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}, (l_returnflag = 'R')::DOUBLE), 6) AS r, count(*) AS n FROM lineitem" for c in LINE
    ),
)
def _(spark, sf):
    flagged = table(spark, sf, "lineitem").withColumn("target", (F.col("l_returnflag") == "R").cast("double"))
    scores = stats.pearson_with_target(flagged, LINE, "target")
    return rounded(scores.orderBy(F.abs("r").desc()).select("feature", "r", "n"))


@query("e15_pearson_p")
def _(spark, sf):
    flagged = table(spark, sf, "lineitem").withColumn("target", (F.col("l_returnflag") == "R").cast("double"))
    return stats.pearson_with_target(flagged, LINE, "target").orderBy(F.abs("r").desc())


def _histogram_sql(value: str, bins: int) -> str:
    return f"""WITH v AS (SELECT {value} AS v FROM lineitem), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
    c AS (SELECT least(floor((v - lo) / ((hi - lo) / {bins})), {bins} - 1) AS bin, count(*) AS rows FROM v, e GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / {bins}), 4) AS bin_start,
    round(lo + (i + 1) * ((hi - lo) / {bins}), 4) AS bin_end, coalesce(rows, 0) AS rows
    FROM range({bins}) t(i) CROSS JOIN e LEFT JOIN c ON c.bin = i"""


@query("e16_histogram", _histogram_sql("l_extendedprice", 50))
def _(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50), 4)


@query("e16_log_histogram", _histogram_sql("ln(l_extendedprice)", 40))
def _(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 40, log=True), 4)


@query(
    "e17_density",
    """WITH s AS (SELECT l_returnflag, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi,
      stddev_samp(l_quantity) * pow(count(*)::DOUBLE, -0.2) AS bw FROM lineitem GROUP BY 1),
    b AS (SELECT l_returnflag, n, lo, hi, bw, least(floor((l_quantity - lo) / ((hi - lo) / 512)), 511) AS bin, count(*) AS m
      FROM lineitem JOIN s USING (l_returnflag) GROUP BY ALL),
    g AS (SELECT *, lo + i * (hi - lo) / 49 AS x, (lo + i * (hi - lo) / 49 - (lo + (bin + 0.5) * ((hi - lo) / 512))) / bw AS z
      FROM b, range(50) t(i))
    SELECT l_returnflag, CAST(i AS INTEGER) AS point, round(x, 5) AS x, round(sum(m * exp(-z * z / 2) / (n * bw * sqrt(2 * pi()))), 5) AS density
    FROM g GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(stats.density_curve(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"), 5)


@query(
    "e18_box_summary",
    """WITH q AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS p25,
      quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75 FROM orders GROUP BY 1),
    r AS (SELECT *, o_totalprice BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25) AS inside FROM orders JOIN q USING (o_orderpriority))
    SELECT o_orderpriority, n, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75,
    min(o_totalprice) FILTER (inside) AS whisker_low, max(o_totalprice) FILTER (inside) AS whisker_high,
    count(*) FILTER (NOT inside) AS outliers FROM r GROUP BY ALL""",
)
def _(spark, sf):
    return rounded(stats.box_summary(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 4)


# Sorts, top-k, set operations -----------------------------------------------------------------


@query("g1_sort", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"))


@query("g2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return frames.top_rows(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@query(
    "g3_top_per_player",
    """SELECT o_custkey, o_orderkey, o_totalprice, r AS rank FROM (SELECT *, CAST(row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders) WHERE r <= 3""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return frames.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query(
    "g4_top_overall",
    """SELECT p_brand, p_type, median(p_retailprice) AS p50 FROM part GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
)
def _(spark, sf):
    found = group_stats(table(spark, sf, "part"), ["p_brand", "p_type"], ["p_retailprice"])
    return frames.top_rows(found.select("p_brand", "p_type", "p50"), [F.desc("p50"), F.col("p_brand"), F.col("p_type")], 20)


@query("g5_sort_abs", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY abs(s_acctbal) DESC, s_suppkey")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.abs("s_acctbal").desc(), "s_suppkey")


@query(
    "h1_union",
    "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier",
)
def _(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return customers.unionByName(suppliers)


@query(
    "h2_difference",
    "SELECT DISTINCT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
)
def _(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).distinct().join(rich, "nation", "left_anti")


@query("h3_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query(
    "h4_intersection",
    "SELECT o_custkey AS customer FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), "o_orderstatus")
    pick = lambda status: orders.where(F.col("o_orderstatus") == status).select("customer")
    return pick("P").intersect(pick("F"))
