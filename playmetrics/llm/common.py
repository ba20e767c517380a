"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of the six ASCII white-space characters; words are what lies between.
SPACE = "[\\x20\\x09-\\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE, -1), lambda word: word != "")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether a row is kept from training. A row without id is, as its fold is unknown."""
    return F.coalesce(fold(doc_id, folds) == 0, F.lit(True))


def columns_free(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted column name one that ``df`` does not use."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


class Sent:
    """A value for all tasks, its class included: workers need no copy of this package.

    A plain broadcast names classes by their module, which a worker would have to import.
    """

    def __init__(self, spark: SparkSession, value) -> None:
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        """The value, built once in a worker process."""
        if not hasattr(self._packed, "built"):
            self._packed.built = cloudpickle.loads(self._packed.value)
        return self._packed.built
