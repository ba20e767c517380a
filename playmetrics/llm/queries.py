"""The operators applied to the given tables, with SQL where it can state the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, lm, manifest, mixing, pieces, pii, quality, runs, sharding, simhash, slices, suffixes, toxicity
from .common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Seed and shape of the mixture that the query and the pipeline use: weights in proportion to the
#: square root of a source's rows, one copy in all for each row.
MIX_SEED, MIX_EXPONENT, MIX_TOTAL = "mix", 0.5, 1.0


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in shards 0 to 39 of near-equal bytes."""
    placed = sharding.shard_by_bytes(documents(spark, sf), 40, overhead=16)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints over 3-word shingles and components at 2 bits."""
    found = simhash.near_duplicates(documents(spark, sf), size=3, radius=2)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


OP7_SQL = f"""
WITH counts AS (SELECT source AS s, count(*) AS n, pow(count(*)::DOUBLE, {MIX_EXPONENT}) AS w FROM documents GROUP BY source),
rates AS (
  SELECT s, w / sum(w) OVER () * (sum(n) OVER ())::DOUBLE * {MIX_TOTAL} / n AS rate FROM counts),
terms AS (
  SELECT s, rate, k, exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda i: ln(rate / i))), 0) - rate) AS p
  FROM (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rates)),
sums AS (SELECT s, rate, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
cdfs AS (SELECT s, any_value(rate) AS rate, list(c) AS cdf FROM sums GROUP BY s),
drawn AS (
  SELECT doc_id, source, rate, '{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS name, cdf
  FROM documents JOIN cdfs ON source IS NOT DISTINCT FROM s),
counted AS (
  SELECT doc_id, source, rate, name,
         len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5(name), 1, 13))::BIGINT / {16**13}.0)) AS copies FROM drawn),
copied AS (SELECT *, unnest(range(0, copies)) AS replica FROM counted)
SELECT doc_id, source, round(rate, 9) AS rate, CAST(copies AS INTEGER) AS copies, CAST(replica AS INTEGER) AS replica,
       row_number() OVER (ORDER BY ('0x' || substr(md5(name || ':' || replica), 1, 13))::BIGINT, doc_id, replica) - 1 AS position
FROM copied"""


@query("op7_mixing", OP7_SQL)
def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Every copy of every document in the mixture, with its place in the global order."""
    docs = documents(spark, sf).select("doc_id", "source")
    copies = mixing.replicate(docs, seed=MIX_SEED, exponent=MIX_EXPONENT, total=MIX_TOTAL).select(
        "held.doc_id", "held.source", F.round("rate", 9).alias("rate"), "copies", "replica", "key"
    )
    return mixing.shuffled(copies, "doc_id", "replica").drop("key")


OP8_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
rows AS (SELECT row_number() OVER () AS r, * FROM split),
grams AS (
  SELECT r, i, array_to_string(words[i:i+4], ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM rows)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(0, 5)) AS k FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_echo_words,
         len(list_filter(words, lambda w: ends_with(w, '!!'))) AS n_shouted
  FROM rows LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines
            OR 10 * n_echo_words > 3 * n_words OR 10 * n_shouted > n_words) AS kept
FROM measured"""


@query("op8_quality", OP8_SQL)
def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Measures and verdict of every document."""
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = quality.assess(documents(spark, sf), show=shown)
    failed = " OR ".join(quality.RULES[r] for r in ("few_words", "repeated_windows"))
    return found.select("doc_id", *shown, F.expr(failed).alias("base_failed"), "kept")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (w ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@query("op9_exact", OP9_SQL)
def op9_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal texts; the row with the largest id stays."""
    found = exact.deduplicate(documents(spark, sf))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query("op10_pieces")
def op10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and round trip of every whole text, as digests."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = pieces.encode_documents(documents(spark, sf), model, decode=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every whole text, learned outside the held-out fold."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = held_out(F.col("doc_id"), 5)
    found = toxicity.toxicity(documents(spark, sf), labels, ~held, ["doc_id"])
    return found.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op4_pii")
def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Base and added spans of personal data in every whole text."""
    docs = documents(spark, sf)
    found = pii.find(docs, pii.fit(docs), ["doc_id"])
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[number(k) for k in pii.KINDS],
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"),
    )


@query("op5_suffixes")
def op5_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text without the bytes of 400-byte strings that also start elsewhere, as digests."""
    found = suffixes.remove_repeated(documents(spark, sf), 400)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op3_lm")
def op3_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Base and model scores of every whole text, encoded into pieces, learned outside the held-out fold."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    held = held_out(F.col("doc_id"), 10)
    found = lm.score_documents(documents(spark, sf), ~held, model, by_pieces=True)
    return found.withColumn("held_out", held).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


OP11_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5"""


@query("op11_topk", OP11_SQL)
def op11_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five best rows for every fiftieth vector, against all vectors."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = slices.top_k(rows, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5, scale=256)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _written(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


#: One level up while a group has several nodes; a node's siblings are looked up level by level.
_TREE = """
  SELECT grp, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS left_over FROM {0}) WHERE left_over > 1 GROUP BY grp, lvl, pos // 2"""
_PATH = """
  SELECT l.grp, l.pos, list(CASE WHEN s.h IS NULL THEN 'N' WHEN (l.pos >> l.at) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY l.at) AS path
  FROM (SELECT n.grp, n.pos, unnest(range(0, h.high)) AS at FROM {0} n JOIN (SELECT grp, max(lvl) AS high FROM {0} GROUP BY grp) h USING (grp) WHERE n.lvl = 0) l
  LEFT JOIN {0} s ON s.grp = l.grp AND s.lvl = l.at AND s.pos = xor(l.pos >> l.at, 1) GROUP BY l.grp, l.pos"""

OP12_SQL = f"""
WITH RECURSIVE digits AS (
  SELECT *, list_reduce([4294967295] || list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(concat(head, {_written("n_chars")}, tail)) AS leaf,
    sha256(concat(head, {_written("more")}, tail)) AS changed, xor(crc, 4294967295) % 7 = 0 AS tampered
  FROM (SELECT *, n_chars + 1 AS more, concat({_written("doc_id")}, {_written("source")}, {_written("lang")}) AS head, {_written("text")} AS tail FROM digits)),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes(grp, lvl, pos, h) AS (SELECT grp, 0, pos, leaf FROM placed UNION ALL {_TREE.format("nodes")}),
subroots AS (SELECT grp, arg_max(h, lvl) AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos FROM nodes GROUP BY grp),
crown(grp, lvl, pos, h) AS (SELECT '', 0, pos, subroot FROM subroots UNION ALL {_TREE.format("crown")}),
low AS ({_PATH.format("nodes")}),
high AS ({_PATH.format("crown")}),
full_path AS (
  SELECT p.*, s.subroot, (SELECT arg_max(h, lvl) FROM crown) AS root, coalesce(low.path, []) || coalesce(high.path, []) AS path
  FROM placed p JOIN subroots s USING (grp) LEFT JOIN low ON low.grp = p.grp AND low.pos = p.pos LEFT JOIN high ON high.pos = s.pos),
folded AS (
  SELECT *, list_reduce([CASE WHEN tampered THEN changed ELSE leaf END] || path,
    lambda h, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) AS folded_root
  FROM full_path)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM folded"""


@query("op12_manifest", OP12_SQL)
def op12_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, roots and proof of every document; one in seven is verified after a change of n_chars."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf, other = (
        manifest.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")) for n in (F.col("n_chars"), more)
    )
    found = manifest.manifest(documents(spark, sf), "doc_id", "lang", leaf, F.when(changed, other))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        manifest.proof(F.col("path")).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _loop(seed: int, n: int) -> tuple[int, int] | None:
    """Which words of a text of ``n`` words are read as a loop: (first, turn), in one text of ten."""
    g = seed // 10
    first = g % n
    return (first, 1 + (n - first) // (3 + g % 8)) if seed % 10 == 0 else None


@query("op13_runs")
def op13_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of words in every whole text; one in ten is made to loop."""
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = runs.find_runs(documents(spark, sf), ["doc_id"], seed=seed, plant=_loop)
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
