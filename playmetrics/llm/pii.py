"""Personal data: candidate spans scored by gradient-boosted trees.

High-recall generators propose spans of four kinds; spans of different kinds may overlap. Trees score
each candidate on its format (digits, groups, separators, check digits) and its context (neighbouring
characters, telling words before it). They learn from a bounded sample of candidates, drawn for each kind
from all documents. A part of them is planted: each base span also enters in another form (other
separators, spelled-out signs, a local number, a port), and once more as a number that is none (a wrong
check digit, an order number of the same shape). What a planted candidate is, is known from how it
was made, and some keep the context of the text, so no feature tells all of them. The rest are the
corpus's own candidates, labelled by rules. For each kind the acceptance threshold is calibrated on all
documents of the half that the trees were not drawn from: the lowest one whose accepted candidates reach
the wanted precision. Base spans always stay; accepted candidates that overlap none of them are added,
best score first.

All of it is DataFrame expressions. A pattern's matches and the text between them give positions in
code points; the trees become one nested condition per tree, evaluated on the candidates of a row, so
the whole is one pass over the documents without a shuffle. The patterns start only where a run of
their first characters starts and never give back what they took, which keeps them linear on long
runs, needs no deeper stack there and finds the same matches. Places are running sums over blocks of matches, overlaps are found by
binary search, and candidates compete only within a chain of overlapping ones: the work grows with the
number of matches in a text, a hundred thousand take seconds.

Defined cases: a null text counts as empty; an empty text has no spans; null ids and repeated rows
are treated like others; a sample without candidates of both labels adds no spans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from .common import columns_free, text_of

KINDS = ("email", "ip", "card", "phone")

LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns; leftmost, non-overlapping.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators: looser forms of each kind.
LOOSE = {
    "email": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[\p{L}\p{N}-]++"
    r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[\p{L}\p{N}-]++)*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:[.:][0-9]++){2,9}+",
    "card": r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20._/-][0-9]++)*+",
    "phone": r"(?:\+|(?<![0-9(]))[0-9(][\x20()./0-9-]{4,40}+",
}
#: Something that every match of a kind holds: rows without it skip the pattern.
HINT = {"email": "@|[\\[(]at[\\])]", "ip": "[0-9][.:][0-9]", "card": "[0-9]", "phone": "[0-9]"}
LEAST_DIGITS = {"email": 0, "ip": 3, "card": 12, "phone": 7}
CONTEXT = 32
#: Candidates of one kind and label that a text gives to training.
PER_TEXT = 4
FEATURES = (
    "length", "digits", "letters", "at_sign", "spelled", "dots", "spaces", "hyphens", "plus", "parens", "check_digit",
    "four_bytes", "groups", "longest_group", "glued_left", "glued_right", "says_mail", "says_phone", "says_card", "says_host",
    "is_email", "is_ip", "is_card", "is_phone", "says_other",
)
SPAN = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"
ADDED = "array<struct<kind:string,start:int,stop:int>>"
#: Elements of an array that are scanned together.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of some numbers what ``step`` (sum, maximum) makes of zero and all numbers up to it.

    Goes by blocks, as an array that grows by one element is copied each time.
    """

    def walk(part: Column, at: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: let(
                step(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))
            ),
            lambda acc: acc["out"],
        )

    def of(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        block = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        totals = F.transform(numbers, lambda b: F.aggregate(block(b), F.lit(0), step))
        return let(
            walk(totals, F.lit(0)),
            lambda heads: F.flatten(F.transform(numbers, lambda b: walk(block(b), F.coalesce(F.get(heads, b - 1), F.lit(0))))),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def below(ascending: Column, limit: Column) -> Column:
    """How many of some ascending numbers are less than ``limit``, by binary search."""
    size = F.size(ascending)
    powers = F.sequence(F.length(F.bin(size)) - 1, F.lit(0), F.lit(-1))
    return F.aggregate(
        powers,
        F.lit(0),
        lambda low, k: let(
            low + F.call_function("shiftleft", F.lit(1), k),
            lambda tried: F.when((tried <= size) & (F.get(ascending, tried - 1) < limit), tried).otherwise(low),
        ),
    )


def matches(text: Column, pattern: str, hint: str) -> Column:
    """All matches of a pattern: start and stop in code points, the match, the text next to it."""

    def placed(found: Column, between: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i)))
        return let(
            scan(lengths, lambda a, b: a + b),
            lambda stops: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(stops, i) - F.length(m)).alias("start"),
                    F.get(stops, i).alias("stop"),
                    m.alias("value"),
                    F.right(F.get(between, i), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(between, i + 1), F.lit(1)).alias("after"),
                ),
            ),
        )

    walked = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: let(F.split(text, pattern, -1), lambda between: placed(found, between)),
    )
    return F.when(text.rlike(hint), walked).otherwise(F.array()).cast(SPAN)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""

    def summed(digits: Column) -> Column:
        doubled = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
            lambda i: F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
                F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
            ),
        )
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)

    return let(F.reverse(_only_digits(value)), summed) % 10 == 0


def _bytes_ok(value: Column) -> Column:
    parts = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    small = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3)
    return small & F.forall(parts, lambda p: F.right(p, F.lit(3)).cast("int") <= 255)


def valid(kind: str, value: Column) -> Column:
    """Whether a base match counts."""
    digits = F.length(_only_digits(value))
    if kind == "ip":
        return _bytes_ok(value)
    if kind == "card":
        return F.when(digits.between(16, 19), luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return digits.between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the valid spans of the base patterns."""

    def of(kind: str) -> Column:
        return F.filter(matches(text, BASE[kind], HINT[kind]), lambda x: valid(kind, x["value"]))

    return {kind: of(kind) for kind in KINDS}


def _well_formed(kind: str, value: Column) -> Column:
    """Variants of the base patterns that the rules label as personal data."""
    digits = F.length(_only_digits(value))
    if kind == "email":
        return value.rlike(r"^[A-Za-z0-9._%+-]+(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++$")
    if kind == "ip":
        return value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?$") & _bytes_ok(F.split(value, ":")[0])
    if kind == "card":
        return F.when(digits.between(16, 19) & value.rlike(r"^[0-9]{4}([ ._/-]?)[0-9]{4}(?:\1[0-9]{1,4})+$"), luhn(value)).otherwise(F.lit(False))
    return value.rlike(r"^(?:\+[0-9]|\([0-9]{3}\)\x20?[0-9]{3}[ .-][0-9]{4}\b|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b)") & digits.between(8, 15)


#: What a base span is made of, as a whole value. Repeated groups never give back, as a repeat that may is a call in a call
#: for each turn: a long number would overflow the stack, which ends an executor.
FORM = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++$",
    "ip": r"^[0-9]+(?:\.[0-9]+){3}$",
    "card": r"^[0-9](?:[\x20-]?[0-9])++$",
    "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$",
}
#: Words before a planted span, and before a planted number that is none.
TELLING = {"email": "mail ", "ip": "host ", "card": "visa ", "phone": "call "}
OTHER = ("order ", "invoice ", "serial ", "version ")


def _picked(turn: Column, forms: list[Column]) -> Column:
    """One of some forms, by a number."""
    return F.element_at(F.array(*forms), (F.pmod(turn, F.lit(len(forms))) + 1).cast("int"))


def _spelled(kind: str, value: Column, turn: Column) -> Column:
    """A base span in another form."""
    digits = _only_digits(value)
    if kind == "email":
        user, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        dotted = F.regexp_replace(host, "\\.", "[dot]")
        return _picked(turn, [F.concat(user, F.lit("[at]"), host), F.concat(user, F.lit(" (at) "), host), F.concat(user, F.lit("[at]"), dotted)])
    if kind == "ip":
        return F.concat_ws(":", value, (F.pmod(turn, F.lit(64_000)) + 1_024).cast("string"))
    if kind == "card":
        return _picked(turn, [F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{c}") for c in "./_"])
    local = lambda form: F.regexp_replace(digits, "^.*?([0-9]{3})([0-9]{3})([0-9]{4})$", form)
    return F.when(F.length(digits) >= 10, _picked(turn, [local("($1) $2-$3"), local("$1-$2-$3"), local("$1.$2.$3")])).otherwise(value)


def _likeness(kind: str, value: Column, turn: Column) -> Column:
    """A value of the shape of a span that is none."""
    if kind == "email":
        return _picked(turn, [F.concat(F.substring_index(value, "@", 1), F.lit(c)) for c in ("@home", "[at]line", "@x")])
    if kind == "ip":
        far = F.regexp_replace(value, "^[0-9]+", "731")
        return _picked(turn, [far, F.substring_index(value, ".", 3), F.concat(value, F.lit(".0"))])
    if kind == "card":
        wrong = (F.right(value, F.lit(1)).cast("int") + 1 + F.pmod(turn, F.lit(9)).cast("int")) % 10
        return _spelled(kind, F.concat(F.regexp_replace(value, ".$", ""), wrong.cast("string")), turn)
    return _spelled(kind, value, turn)


def planted(x: Column, turn: Column) -> Column:
    """For a candidate that is a base span: a span in another form and a number that is none, with their labels.

    Half of the spans and a quarter of the others keep the context of the text.
    """

    def one(kind: str) -> Column:
        word = _picked(F.shiftright(turn, 8), [F.lit(w) for w in OTHER])
        keeps = F.pmod(F.shiftright(turn, 16), F.lit(4))
        told = F.when(keeps < 2, x["before"]).otherwise(F.lit(TELLING[kind]))
        other = F.when(keeps == 1, x["before"]).otherwise(word)
        made = lambda value, before: F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), before.alias("before"), x["after"].alias("after")
        )
        return F.when(
            (x["kind"] == kind) & x["value"].rlike(FORM[kind]) & valid(kind, x["value"]),
            F.array(
                F.struct(made(_spelled(kind, x["value"], turn), told).alias("x"), F.lit(1.0).alias("label")),
                F.struct(made(_likeness(kind, x["value"], turn), other).alias("x"), F.lit(0.0).alias("label")),
            ),
        )

    return F.coalesce(*[one(kind) for kind in KINDS])


def candidates(text: Column) -> Column:
    """The spans that the generators propose, kind by kind."""

    def trimmed(x: Column) -> Column:
        """Without what a generator took behind the last digit."""
        value = F.regexp_replace(x["value"], "[^0-9]+$", "")
        return F.struct(
            x["start"].alias("start"),
            (x["start"] + F.length(value)).alias("stop"),
            value.alias("value"),
            x["before"].alias("before"),
            F.when(x["value"].rlike("[^0-9]$"), F.lit(" ")).otherwise(x["after"]).alias("after"),
        )

    def of(kind: str) -> Column:
        found = matches(text, LOOSE[kind], HINT[kind])
        if kind == "phone":
            found = F.transform(found, trimmed)
        if LEAST_DIGITS[kind]:
            found = F.filter(found, lambda x: F.length(_only_digits(x["value"])) >= LEAST_DIGITS[kind])
        names = ("start", "stop", "value", "before", "after")
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), *[x[c].alias(c) for c in names]))

    return F.concat(*[of(kind) for kind in KINDS])


def features(x: Column) -> Column:
    """The feature array of a candidate, in the order of ``FEATURES``."""
    value, before = x["value"], x["before"]
    count = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, pattern, ""))
    groups = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    says = lambda words: before.rlike(f"(?i)\\b(?:{words})\\b")
    given = {
        "length": F.length(value),
        "digits": F.length(_only_digits(value)),
        "letters": count("\\p{L}"),
        "at_sign": value.contains("@"),
        "spelled": value.rlike("[\\[(]at[\\])]"),
        "dots": count("\\."),
        "spaces": count(" "),
        "hyphens": count("-"),
        "plus": value.startswith("+"),
        "parens": count("[()]"),
        "check_digit": F.when(F.length(_only_digits(value)).between(12, 19), luhn(value)).otherwise(F.lit(False)),
        "four_bytes": value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::|$)") & _bytes_ok(F.split(value, ":")[0]),
        "groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "glued_left": before.rlike("[\\p{L}\\p{N}]$"),
        "glued_right": x["after"].rlike("^[\\p{L}\\p{N}]"),
        "says_mail": says("e-?mail|mail|contact|write"),
        "says_phone": says("phone|call|tel|fax|mobile|cell"),
        "says_card": says("card|visa|credit|pay(?:ment)?"),
        "says_host": says("ip|host|server|address|addr"),
        **{f"is_{k}": x["kind"] == k for k in KINDS},
        "says_other": says("order|invoice|serial|version|build|item|part"),
    }
    return F.array(*[given[name].cast("double") for name in FEATURES])


def _tree_column(node, values: Column) -> Column:
    """A fitted tree as one nested condition on a feature array."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(
        values[int(split.featureIndex())] <= F.lit(float(split.threshold())), _tree_column(node.leftChild(), values)
    ).otherwise(_tree_column(node.rightChild(), values))


class Scorer:
    """Fitted trees as an expression, and a threshold for each kind.

    ``reached`` holds precision and recall of the threshold of a kind on the documents that it was calibrated on.
    """

    def __init__(self, model=None, thresholds: dict[str, float] | None = None) -> None:
        self.trees = [] if model is None else list(zip(model.treeWeights, model.trees, strict=True))
        self.thresholds = thresholds or {}
        self.reached: dict[str, tuple[float, float]] = {}

    def probability(self, values: Column) -> Column:
        parts = [F.lit(float(w)) * _tree_column(t._call_java("rootNode"), values) for w, t in self.trees]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * reduce(lambda a, b: a + b, parts)))

    def accepted(self, kind: Column, probability: Column) -> Column:
        limit = reduce(lambda a, k: F.when(kind == k, F.lit(self.thresholds[k])).otherwise(a), self.thresholds, F.lit(2.0))
        return probability >= limit


def fit(
    docs: DataFrame,
    text_col: str = "text",
    sample_docs: int = 4_000,
    precision: float = 0.99,
    trees: int = 10,
    depth: int = 3,
    seed: int = 5,
) -> Scorer:
    """Train on a bounded sample of candidates, calibrate on the candidates of all documents.

    A hash of its text puts a document on one side or the other. Of each text training sees up to
    ``PER_TEXT`` candidates of a kind and label, own and planted, however often the text occurs, and of each kind some
    ``2 * sample_docs``, drawn by a hash of text and place.
    """
    text = text_of(text_col)
    held = docs.select(F.xxhash64(text, F.lit(seed)).alias("h"), F.posexplode(candidates(text)).alias("at", "x"))
    ruled = reduce(lambda a, k: F.when(F.col("x.kind") == k, _well_formed(k, F.col("x.value"))).otherwise(a), KINDS, F.lit(False))
    own = F.struct(
        F.struct(*[F.col("x")[c].alias(c) for c in ("kind", "value", "before", "after")]).alias("x"), ruled.cast("double").alias("label")
    )
    made = F.coalesce(planted(F.col("x"), F.xxhash64("h", "at")), F.array())
    all_of = held.select("h", "at", F.posexplode(F.concat(F.array(own), made)).alias("origin", "c"))
    found = settle(
        all_of.select(
            "h", "at", "origin", "c.x.kind", features(F.col("c.x")).alias("values"), "c.label",
            (F.pmod("h", F.lit(2)) == 0).alias("fitting"),
        ),
        "candidates",
    )
    few = found.where("fitting").groupBy("h", "kind", "label", "origin", F.pmod("at", F.lit(PER_TEXT)).alias("turn"))
    few = settle(few.agg(F.min_by("values", "at").alias("values")), "few")
    sizes = {r["kind"]: r["count"] for r in few.groupBy("kind").count().collect()}
    share = lambda k: int(min(1.0, 2 * sample_docs / sizes[k]) * 1_000_000)
    drawn = reduce(lambda a, k: F.when(F.col("kind") == k, F.lit(share(k))).otherwise(a), sizes, F.lit(0))
    sample = few.where(F.pmod(F.xxhash64("h", "label", "origin", "turn"), F.lit(1_000_000)) < drawn)
    if sample.select("label").distinct().count() < 2:
        return Scorer()
    fitting = sample.select(array_to_vector("values").alias("features"), "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(fitting)
    scorer = Scorer(model)
    # Counts for each kind and hundredth of the score: a bounded table.
    rated = found.where("not fitting").select("kind", "label", F.floor(scorer.probability(F.col("values")) * 100).alias("bin"))
    bins = rated.groupBy("kind", "bin").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect()
    for kind in KINDS:
        hits = n = 0
        total = sum(b["hits"] for b in bins if b["kind"] == kind)
        for row in sorted((b for b in bins if b["kind"] == kind), key=lambda b: -b["bin"]):
            hits, n = hits + row["hits"], n + row["n"]
            if hits >= precision * n and row["bin"] >= 50:
                scorer.thresholds[kind] = row["bin"] / 100
                scorer.reached[kind] = (hits / n, hits / total)
    return scorer


def _free(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``: those that begin before a span's end must all stop by its start."""

    def outside(ordered: Column) -> Column:
        reach = scan(F.transform(ordered, lambda t: t["stop"]), lambda a, b: F.greatest(a, b))
        return let(
            F.transform(ordered, lambda t: t["start"]),
            lambda starts: let(
                reach,
                lambda ends: F.filter(
                    spans, lambda x: F.coalesce(F.get(ends, below(starts, x["stop"]) - 1) <= x["start"], F.lit(True))
                ),
            ),
        )

    ends = F.transform(taken, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop")))
    return F.when(F.size(taken) > 0, let(F.array_sort(ends), outside)).otherwise(spans)


def _best(rated: Column) -> Column:
    """Of spans (start, stop, worse, kind) those that overlap no better one that stays, chain by chain."""

    def fight(chain: Column) -> Column:
        by_score = F.transform(chain, lambda x: F.struct(*[x[c].alias(c) for c in ("worse", "start", "stop", "kind")]))
        return F.aggregate(
            F.array_sort(by_score),
            F.array().cast(ADDED),
            lambda out, x: F.when(F.exists(out, lambda t: (t["start"] < x["stop"]) & (x["start"] < t["stop"])), out).otherwise(
                F.concat(out, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))))
            ),
        )

    def chains(ordered: Column) -> Column:
        reach = scan(F.transform(ordered, lambda x: x["stop"]), lambda a, b: F.greatest(a, b))
        heads = let(
            reach,
            lambda ends: F.filter(
                F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.get(ordered, i)["start"] >= F.coalesce(F.get(ends, i - 1), F.lit(0))
            ),
        )
        return let(
            heads,
            lambda h: F.flatten(
                F.transform(h, lambda i, j: fight(F.slice(ordered, i + 1, F.coalesce(F.get(h, j + 1), F.size(ordered)) - i)))
            ),
        )

    return let(F.array_sort(rated), lambda o: F.when(F.size(o) > 0, chains(o)).otherwise(F.array().cast(ADDED)))


def added_spans(text: Column, taken: Column, scorer: Scorer) -> Column:
    """Accepted candidates that overlap no span of ``taken`` and no better one."""
    if not scorer.thresholds:
        return F.array().cast(ADDED)

    def rated(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"),
            x["stop"].alias("stop"),
            let(features(x), lambda values: -scorer.probability(values)).alias("worse"),
            x["kind"].alias("kind"),
        )

    scored = F.transform(_free(candidates(text), taken), rated)
    return _best(F.filter(scored, lambda x: scorer.accepted(x["kind"], -x["worse"])))


def find(docs: DataFrame, scorer: Scorer, carry: list[str], text_col: str = "text") -> DataFrame:
    """The ``carry`` columns, ``base`` and ``added``: arrays of (kind, start, stop), ordered by kind, then start."""
    given = docs.select(*[F.col(f"`{c}`") for c in carry], text_of(text_col).alias("__text__"))
    base, added = columns_free(docs.select(*[F.col(f"`{c}`") for c in carry]), "base", "added")
    named = lambda k, spans: F.transform(
        spans, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    )
    spans = F.concat(*[named(k, s) for k, s in base_spans(F.col("__text__")).items()])
    with_base = given.withColumn(base, spans)
    extra = F.when(
        F.col("__text__").rlike("[0-9]{2}|[0-9][^0-9]{1,2}[0-9]|@|[\\[(]at[\\])]"), added_spans(F.col("__text__"), F.col(base), scorer)
    ).otherwise(F.array().cast(ADDED))
    return with_base.withColumn(added, extra).drop("__text__")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:stop, kind by kind as listed, then by start."""
    rank = lambda k: F.array_position(F.lit(list(KINDS)), k).cast("int")
    ordered = F.array_sort(
        F.transform(spans, lambda x: F.struct(rank(x["kind"]).alias("r"), x["start"].alias("s"), x["stop"].alias("e"), x["kind"].alias("k")))
    )
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are read in order of start."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    walked = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["stop"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(
                x["stop"].alias("at"),
                F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return walked
