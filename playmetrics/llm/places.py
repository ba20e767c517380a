"""Rows named by where their content lies, so that decisions travel without the content.

A place is a file and a row number in it. A table that is read straight from files already has places; any other
is written to the shared folder once. What an operator decides is then computed on (place, digest) rows, and only at the
end are rows picked from the files.

Rows that are certainly kept are told by a sieve: one bit for each hash of a dropped place, at most 2^24 bits, so it
can be sent to all tasks. A row whose bit is not set is not dropped. The others meet the dropped
places in a join. Where very many rows are dropped all rows take the join; the result is the same.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle

PATH, ROW = "_place_path", "_place_row"

#: Bits of a sieve. It has a 64-bit word for each 64 bits: 262,144 rows of two numbers at most.
SIEVE_BITS = 1 << 24


def with_places(docs: DataFrame) -> DataFrame:
    """The rows with the columns `PATH` and `ROW`, which are stable whenever they are read again."""
    at = [F.col("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(ROW)]
    # Only a bare table of files has one row per place.
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            return docs.select("*", *at)
        except AnalysisException:
            pass
    return settle(docs, "content").select("*", *at)


def _bit(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SIEVE_BITS))


def sieve(keys: DataFrame, *names: str) -> DataFrame:
    """``word, bits``: the hashes of all keys."""
    marked = keys.select(_bit(*map(F.col, names)).alias("bit"))
    return marked.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS INT)))").alias("bits"))


def sifted(rows: DataFrame, words: DataFrame, *keys: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not in the sieve, and those whose key may be."""
    bit = _bit(*keys)
    found = rows.withColumn("_bit", bit).join(F.broadcast(words), F.expr("_bit div 64 = word"), "left")
    set_ = F.coalesce(F.expr("bits & shiftleft(1L, cast(_bit & 63 AS INT)) <> 0"), F.lit(False))
    return tuple(found.where(c).drop("_bit", "word", "bits") for c in (~set_, set_))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of `with_places` whose place is not among ``dropped`` (columns `PATH`, `ROW`), without their places."""
    words = settle(sieve(dropped, PATH, ROW), "sieve")
    sure, doubtful = sifted(rows, words, F.col(PATH), F.col(ROW))
    return sure.unionByName(doubtful.join(dropped, [PATH, ROW], "left_anti")).drop(PATH, ROW)
