"""Quality rules as a short-circuit cascade.

Rules are Spark conditions on named measures of a text. On a bounded sample each rule's cost (time
to evaluate it) and selectivity (share of rows it rejects) are estimated; the cascade asks the rules
in the order of rejections per cost and stops at the first that rejects. The order changes how much
is computed, never the verdict: a document is kept if no rule rejects it.

Everything is a DataFrame expression: no Python code runs on the rows.

Defined cases: a null text has no words; an empty or blank text has none either; n-gram counts are 0
for texts shorter than a window; repeated rows get equal verdicts; an empty table gives an empty
result, with the rules in their stated order.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from .common import columns_free, text_of, words_of

#: Characters of code, tables and markup.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text, the first time included.

    Windows are compared by a 64-bit hash of their words. Most texts repeat none, which a distinct
    count shows; otherwise (hash, position) pairs are sorted, equal neighbours mark the positions,
    and the lengths that the marked windows cover are summed: n log n steps for any text.
    """
    last = F.size(words) - window
    hashes = F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(window)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(_covered(hashes, window))


def _covered(hashes: Column, window: int) -> Column:
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(hashes)
    # Each pair beside its neighbours, by zipping the sorted array with itself shifted.
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    beside = F.arrays_zip(
        pairs.alias("now"),
        F.concat(F.array(none), F.slice(pairs, F.lit(1), n - 1)).alias("left"),
        F.concat(F.slice(pairs, F.lit(2), n - 1), F.array(none)).alias("right"),
    )
    equal = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    marked = F.sort_array(
        F.transform(F.filter(beside, lambda x: equal(x["now"], x["left"]) | equal(x["now"], x["right"])), lambda x: x["now"]["i"])
    )
    return F.aggregate(
        marked,
        F.struct(F.lit(-window).alias("at"), F.lit(0).alias("sum")),
        lambda a, i: F.struct(i.alias("at"), (a["sum"] + F.least(i - a["at"], F.lit(window))).alias("sum")),
        lambda a: a["sum"],
    )


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The measures that rules are stated on."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_repeat_words": repeated_window_words(words).cast("bigint"),
        "n_echo_words": F.size(
            F.filter(words, lambda w, i: (i > 0) & (w == F.element_at(words, F.greatest(i, F.lit(1)))))
        ).cast("bigint"),
        "n_shouted": F.size(F.filter(words, lambda w: w.endswith("!!"))).cast("bigint"),
    }


#: Rule name to the SQL condition under which a text is rejected, on the measures above.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "echoed_words": "10 * n_echo_words > 3 * n_words",
    "shouted_words": "10 * n_shouted > n_words",
}


def sample_of(docs: DataFrame, text_col: str, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` texts, a share of the rows by ``rand``, written once for all jobs that are timed on it."""
    count = docs.count()
    share = min(1.0, 1.2 * rows / max(count, 1))
    return settle(docs.select(F.col(text_col)).where(F.rand(seed) < share).limit(rows), "rule-sample")


def rule_order(sample: DataFrame, rules: Mapping[str, str]) -> list[tuple[str, float, float]]:
    """``(rule, cost, rejected share)`` in the order of rejections per cost.

    ``sample`` has the columns that rules name, unevaluated. Cost is the time of a job that evaluates one
    rule on the sample, less that of a job that evaluates none.
    """

    def timed(condition: str) -> tuple[float, float]:
        started = time.perf_counter()
        hit = sample.agg(F.avg(F.expr(condition).cast("int").cast("double"))).first()[0]
        return time.perf_counter() - started, hit or 0.0

    idle, _ = min(timed("false") for _ in range(2))
    found = []
    for name, condition in rules.items():
        took, rejected = timed(condition)
        found.append((name, max(took - idle, 1e-3), rejected))
    return sorted(found, key=lambda r: -r[2] / r[1])


def cascade(rules: Sequence[str]) -> Column:
    """Whether no condition holds, asked one after the other up to the first that does."""
    verdict = F.lit(True)
    for condition in reversed(rules):
        verdict = F.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def assess(
    docs: DataFrame,
    rules: Mapping[str, str] = RULES,
    text_col: str = "text",
    carry: Sequence[str] = ("doc_id",),
    show: Sequence[str] = (),
    sample_rows: int = 2_000,
    numbered: str | None = None,
) -> DataFrame:
    """The ``carry`` columns, the measures named in ``show``, and ``kept``.

    Only measures that are shown or asked for by a rule are computed. Added names get leading
    underscores where a carried column has them. ``numbered`` adds a row number of that name.
    """
    text, words = "__text__", "__words__"
    known = measures(F.col(text), F.col(words))
    spare = {name: f"__{name}__" for name in known}

    def measure(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        base = rows.select(*[F.col(f"`{c}`") for c in columns], text_of(text_col).alias(text))
        base = base.withColumn(words, words_of(F.col(text)))
        return base.select(*[F.col(f"`{c}`") for c in columns], *[column.alias(spare[name]) for name, column in known.items()])

    measured = measure(docs, carry)

    def on_spare(condition: str) -> str:
        for name, other in spare.items():
            condition = condition.replace(name, other)
        return condition

    stated = {name: on_spare(condition) for name, condition in rules.items()}
    order = rule_order(measure(sample_of(docs, text_col, sample_rows), ()), stated)
    kept = cascade([stated[name] for name, _, _ in order])
    *named, verdict = columns_free(docs.select(*[F.col(f"`{c}`") for c in carry]), *show, "kept")
    return measured.select(
        *[F.col(f"`{c}`") for c in carry],
        *[F.col(spare[s]).alias(n) for s, n in zip(show, named, strict=True)],
        kept.alias(verdict),
        *([F.monotonically_increasing_id().alias(numbered)] if numbered else []),
    )


def keep(docs: DataFrame, rules: Mapping[str, str] = RULES, text_col: str = "text", sample_rows: int = 2_000) -> DataFrame:
    """The documents that no rule rejects, with their columns.

    The filter also asks for a row number: a condition on one is not moved below the measures, where
    each mention of a measure would compute it anew.
    """
    (row,) = columns_free(docs, "row")
    found = assess(docs, rules, text_col, docs.columns, (), sample_rows, numbered=row)
    verdict = found.columns[-2]
    return found.where(F.col(verdict) & (F.col(row) >= 0)).drop(verdict, row)
