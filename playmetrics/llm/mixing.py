"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate: the rows wanted from it over the rows it has. A document's
number of copies is the Poisson distribution of that mean, inverted at a number in [0, 1) taken from
a hash of seed and id: a table of the distribution, one row per source, is compared with the number.
Documents are exploded by their count, and the copies get a gapless place in a global order by hash.
Expected counts meet the target weights exactly; every document is decided on its own, so the order
of rows, partitioning and lost executors do not matter.

Defined cases: a null source is a source of its own; a null id hashes as the word null; rows that
share an id are drawn alike, and their copies are told apart in the order by source and text; an
empty table gives an empty result; a source without a stated weight gets none of its rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.tables import settle

#: Hexadecimal digits of md5 that make a number: 52 bits fit a double exactly.
DIGITS = 13
#: The order of copies is cut by the leading bits of their hash into so many stretches at most.
STRETCHES = 65_536


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint")


def repetition_rates(
    docs: DataFrame,
    source: str = "source",
    weights: Mapping[str | None, float] | None = None,
    exponent: float = 0.5,
    total: float = 1.0,
) -> DataFrame:
    """``source, rows, rate, cdf``: mean copies per document of each source.

    Target weights are given, or in proportion to rows ** ``exponent``; ``total`` is the number of
    copies wanted over the number of rows. ``cdf`` lists P(copies <= k) for k = 0, 1, ... as far as
    a double can tell it from one.
    """
    sources = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighted = sources.withColumn("w", F.pow(F.col("rows").cast("double"), F.lit(exponent)))
    else:
        pairs = [(None if k is None else str(k), float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(pairs, "name string, w double")
        weighted = sources.join(given, F.col("source").cast("string").eqNullSafe(F.col("name")), "left").select(
            "source", "rows", F.coalesce("w", F.lit(0.0)).alias("w")
        )
    all_w, all_rows = weighted.agg(F.sum("w"), F.sum("rows")).first()
    wanted = F.col("w") / F.lit(all_w or 1.0) * F.lit(float(all_rows or 0)) * F.lit(total)
    rated = weighted.select("source", "rows", (wanted / F.col("rows")).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    # log P(k) = k log(rate) - rate - log k!, summed up; the logarithm keeps large rates from underflow.
    logs = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.aggregate(
            F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
            -F.col("rate"),
            lambda a, i: a + F.when(k == 0, F.lit(0.0)).otherwise(F.log(F.col("rate") / i)),
        ),
    )
    cdf = F.aggregate(
        logs,
        F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("sums")),
        lambda a, x: F.struct((a["at"] + F.exp(x)).alias("at"), F.concat(a["sums"], F.array(a["at"] + F.exp(x))).alias("sums")),
        lambda a: a["sums"],
    )
    return rated.withColumn("cdf", F.when(F.col("rate") > 0, cdf).otherwise(F.array(F.lit(1.0))))


def replicate(
    docs: DataFrame,
    seed: str = "mix",
    id_col: str = "doc_id",
    source: str = "source",
    weights: Mapping[str | None, float] | None = None,
    exponent: float = 0.5,
    total: float = 1.0,
) -> DataFrame:
    """``held, rate, copies, replica, key``: one row per copy; ``held`` is a struct of the document.

    ``key`` is the hash number of the copy in the global order.
    """
    rates = settle(repetition_rates(docs, source, weights, exponent, total), "rates").select(
        F.col("source").alias("at"), "rate", "cdf"
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    drawn = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"),
        F.col(source).alias("source"),
        name.alias("name"),
        (_number(name).cast("double") / float(16**DIGITS)).alias("u"),
    ).join(rates, F.col("source").eqNullSafe(F.col("at")))
    counted = drawn.withColumn("copies", F.size(F.filter("cdf", lambda c: c <= F.col("u"))))
    return (
        counted.where("copies > 0")
        .select("held", "rate", "copies", "name", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("replica"))
        .withColumn("key", _number(F.concat("name", F.lit(":"), F.col("replica").cast("string"))))
        .drop("name")
    )


def shuffled(copies: DataFrame, *ties: str) -> DataFrame:
    """Add ``position``: the gapless place of each row in the order of ``key``, then ``ties``.

    The order is cut into stretches of the key; their counts (a bounded table) give offsets. The
    key is a hash of id and replica, so stretches are even.
    """
    copies = copies.withColumn("stretch", F.floor(F.col("key") / F.lit(16**DIGITS // STRETCHES)))
    counts = copies.groupBy("stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("stretch", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("stretch").orderBy("key", *ties)
    placed = copies.withColumn("at", F.row_number().over(order) - 1)
    return placed.join(offsets, "stretch").withColumn("position", F.col("at") + F.col("before")).drop("stretch", "at", "before")
