from __future__ import annotations

import hashlib
import random
import sys
import time
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as schema

from playmetrics.llm import attention, lm, pieces, pii, quality, suffixes, toxicity
from playmetrics.llm.queries import QUERIES

from .conftest import prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(6)
    return ["", " ", "  a  b ", "▁a ▁", "日本 漢字", "a\x00b", "🙂🙂 x", "a" * 700, "\n\n x\t", "é" * 60 + " " + "ab" * 90, "<s> </s> <0x41>"] + [
        "".join(rng.choice("ab ▁é日\n🙂.1 ") for _ in range(rng.randrange(60))) for _ in range(300)
    ]


def test_pieces_like_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.read_model(MODEL)
    texts = odd_texts()
    for text, (ids, starts, ends) in zip(texts, own.encode_all(texts), strict=True):
        found = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in found]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in found]
        assert own.decode(ids) == library.decode(ids.tolist())
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.randrange(600) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_like_the_library(rule, squeeze):
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze
    )
    model = schema.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = pieces.Pieces(["<unk>"], [2], [0.0], model.normalizer_spec.precompiled_charsmap, True, squeeze, True, False, 0, -1)
    for text in [*odd_texts()[:120], "ｈｅｌｌｏ　Ⅷ ㍿ ﬁ  x ", "   ", "é é ½"]:
        want, offsets = library.normalize(text, with_offsets=True)
        got, source = own.normalise(text)
        assert got == want
        if got:
            edges = np.concatenate(([0], np.cumsum([len(c.encode()) for c in got])))
            assert [len(text.encode()[: source[k]].decode()) for k in edges] == list(offsets)


def test_encoded_rows(odd, none):
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.read_model(MODEL)
    got = pieces.encode_documents(odd, own, carry=["doc_id", "text", "ids"], decode=True).collect()
    assert len(got) == odd.count()
    for r in got:
        text = r.text or ""
        assert r["_ids"] == [*library.encode(text), 2] and r.decoded == library.decode(library.encode(text))
        assert r.ends[-1] == len(text.encode()) and len(r.starts) == len(r["_ids"])
    assert pieces.encode_documents(none, own).count() == 0


def test_encoding_holds_little_at_once(spark):
    rng = random.Random(12)
    own = pieces.read_model(MODEL)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(500)) for _ in range(300)]
    for at in range(0, len(texts), 50):
        own.encode_all(texts[at : at + 50])
    # 150,000 distinct words: what a worker keeps of them is bounded.
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) + sum(map(sys.getsizeof, v)) for k, v in own.cache.items()) < 32_000_000
    sizes = [pieces.TOGETHER // 3] * 7 + [0] * 2_000 + [5 * pieces.TOGETHER] * 2 + [1]
    ranges = list(pieces.row_ranges(sizes))
    assert [i for first, n in ranges for i in range(first, first + n)] == list(range(len(sizes)))
    assert all(n == 1 or (n <= pieces.BATCH and sum(sizes[first : first + n]) <= pieces.TOGETHER) for first, n in ranges)
    assert list(pieces.row_ranges([])) == []
    docs = spark.createDataFrame([(i, " ".join([t] * 30)) for i, t in enumerate(texts[:20])], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in pieces.encode_documents(docs.coalesce(1), own, add_end=False).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got == {i: library.encode(" ".join([t] * 30)) for i, t in enumerate(texts[:20])}


def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdict(spark, odd, none):
    more = [(100, "a b c d e a b c d e a b\nx\nx\n \n y"), (101, "### &&& $$$ " * 9), (102, prose(4, 50) + "\n" + prose(4, 50)), (103, " x y z" * 8)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality.assess(docs, show=shown, carry=("doc_id", "text")).collect()
    for r in got:
        want = slow_measures(r.text or "")
        assert tuple(r[c] for c in shown) == want
        if want[0] < 10 or 100 * want[4] > 20 * want[0] or 10 * want[2] > want[0]:
            assert not r.kept
    kept = {r.doc_id for r in got if r.kept}
    assert {7, 9} <= kept and not {100, 101, 102} & kept
    assert sorted(r.doc_id for r in quality.keep(docs).where("doc_id >= 0").collect()) == sorted(r.doc_id for r in got if r.kept and r.doc_id is not None)
    assert quality.keep(odd).columns == odd.columns and quality.keep(none).count() == 0


def test_rule_order_does_not_change_the_verdict(odd):
    turned = dict(reversed(quality.RULES.items()))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(quality.assess(odd, turned)) == order(quality.assess(odd))


def slow_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0

    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_and_redaction(spark, none):
    texts = [
        "a@b.c%d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3", "+1 (555) 123-4567. call +44 20 7946 0958x",
        "4539578763621486 4539-5787-6362-1486 4539 5787 6362 1487 5", "é@b.co a@é.com é1.2.3.4 🙂 a@b.co", "+1..2--3 +12 ", "12" * 2000,
        "a" * 20000 + "@b.c", "x." * 3000, None, "", "1 " * 2000, "a@b.c.d.e@f.g", "0001.02.3.255 1.2.3.0000300",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = pii.find(docs, pii.Scorer(), ["doc_id", "text"])
    for r in got.select("doc_id", pii.listed(F.col("base")).alias("b"), pii.redact(F.coalesce("text", F.lit("")), F.col("base")).alias("r")).collect():
        assert r.b == slow_spans(texts[r.doc_id] or "")
        if r.doc_id == 2:
            assert r.r == "[phone]. call [phone]x"
    assert pii.find(none, pii.fit(none), ["doc_id", "kept"]).count() == 0


def test_trees_add_variants_and_leave_numbers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        user, host = prose(i, 1), f"mail{i % 9}.example.com"
        parts = [f"{user}@{host}", f"{user}[at]{host}", f"{user}@ {i}", f"number {rng.randrange(10**8, 10**9)}", f"10.{i % 250}.3.4", f"{i % 99}.{i % 7}.3"]
        rows.append((i, f"{prose(i + 1, 5)} {rng.choice(parts)} {prose(i + 2, 5)} {rng.choice(parts)} end"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scorer = pii.fit(docs, trees=6)
    tried = ["write jo[at]mail3.example.com now", "number 135299847 is odd", "plain words only"]
    got = pii.find(spark.createDataFrame(list(enumerate(tried)), "doc_id bigint, text string"), scorer, ["doc_id"])
    assert {r.doc_id: r.a for r in got.select("doc_id", pii.listed(F.col("added")).alias("a")).collect()} == {0: "email:6:29", 1: "", 2: ""}


def test_long_and_hot_texts_do_not_fill_the_sample(spark):
    numbers = " ".join(f"{1_000_000 + 37 * k} x" for k in range(900))
    rows = [numbers, *[f"sum {5_550_000} y {6_660_000}"] * 300]
    rows += [f"write m{i}[at]mail{i % 7}.example.com or t{i}@ no {7_000_000 + i} more" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").coalesce(1)
    scorer = pii.fit(docs, sample_docs=60, trees=4)
    assert "email" in scorer.thresholds
    tried = ["write jo[at]mail3.example.com now", "number 135299847 is odd"]
    got = pii.find(spark.createDataFrame(list(enumerate(tried)), "doc_id bigint, text string"), scorer, ["doc_id"])
    assert {r.doc_id: r.a for r in got.select("doc_id", pii.listed(F.col("added")).alias("a")).collect()} == {0: "email:6:29", 1: ""}


def test_overlaps_are_settled_as_by_a_plain_loop(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        some = lambda n: [(a, a + rng.randrange(1, 9), rng.random(), "ip") for a in (rng.randrange(300) for _ in range(n))]
        rows.append((i, some(rng.choice([0, 1, 5, 90])), some(rng.choice([0, 1, 7, 200]))))
    span = "array<struct<start:int,stop:int,worse:double,kind:string>>"
    df = spark.createDataFrame(rows, f"i int, spans {span}, taken {span}")
    got = df.select("i", pii._best(pii._free(F.col("spans"), F.col("taken"))).alias("best")).collect()
    meets = lambda x, y: x[0] < y[1] and y[0] < x[1]
    for r in got:
        _, spans, taken = rows[r.i]
        want = []
        for x in sorted((x for x in spans if not any(meets(x, t) for t in taken)), key=lambda x: (x[2], x[0])):
            if not any(meets(x, w) for w in want):
                want.append(x)
        assert sorted((x.start, x.stop) for x in r.best) == sorted(w[:2] for w in want)


def test_scan_and_search(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 63, 64, 65, 128, 200])]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    sums = pii.scan(F.col("v"), lambda a, b: a + b)
    got = df.select("i", sums.alias("s"), F.transform(F.lit(list(range(-1, 12))), lambda x: pii.below(F.array_sort("v"), x)).alias("b"))
    for r in got.collect():
        v = rows[r.i][1]
        assert r.s == [sum(v[: k + 1]) for k in range(len(v))]
        assert r.b == [sum(x < limit for x in v) for limit in range(-1, 12)]


def planted_corpus(n: int):
    rng = random.Random(9)
    digits = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))

    def card():
        body = digits(15)
        total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(body))
        return body + str(-total % 10)

    rows = []
    for i in range(n):
        parts = [f"{prose(i, 1)}@mail{i % 9}.example.com", f"10.{i % 250}.3.4", card(), f"+1 ({200 + i % 700}) 555-{1000 + i % 9000}", digits(9)]
        rows.append((i, " ".join(f"{prose(5 * i + k, 4)} {p}" for k, p in enumerate(parts))))
    return rows, card


def test_trees_learn_variants_that_no_text_holds(spark):
    rows, card = planted_corpus(400)
    scorer = pii.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), trees=10)
    number = card()
    parted = "/".join(number[k : k + 4] for k in range(0, 16, 4))
    wrong = parted[:-1] + str((int(parted[-1]) + 3) % 10)
    tried = ["now call 555-123-4567 or so", f"my visa {parted} here", "host 10.1.2.3:8080 up", "mail jo (at) mail3.example.com now",
             "see order 555-123-4567 or so", f"my visa {wrong} here", "mail jo@home now", "plain words only"]
    got = pii.find(spark.createDataFrame(list(enumerate(tried)), "doc_id bigint, text string"), scorer, ["doc_id"])
    spans = {r.doc_id: r.s for r in got.select("doc_id", pii.listed(F.concat("base", "added")).alias("s")).collect()}
    found = [tried[i][int(s.split(":")[1]) : int(s.split(":")[2])] if s.count(",") == 0 and s else s for i, s in sorted(spans.items())]
    assert found[0] == "555-123-4567" and found[1] == parted and found[3] == "jo (at) mail3.example.com"
    assert found[2] == "10.1.2.3" and found[4:] == ["", "", "", ""]
    assert all(p >= 0.99 and r > 0.3 for p, r in scorer.reached.values()) and len(scorer.reached) == 4


def test_a_text_with_a_hundred_thousand_matches(spark):
    rows, _ = planted_corpus(200)
    scorer = pii.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), trees=4)
    n = 25_000
    text = " | ".join(f"jo{i}@x.example.org 10.0.{i % 256}.7 +1 (555) 123-{1000 + i % 9000} call 555-123-4567" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    begun = time.monotonic()
    row = pii.find(docs, scorer, ["doc_id"]).select(pii.listed(F.col("base")).alias("b"), F.size("added").alias("a")).first()
    assert time.monotonic() - begun < 60
    assert row.b == slow_spans(text) and row.b.count(",") + 1 == 3 * n and row.a == n


def test_long_numbers_and_hosts_do_not_overflow_the_stack(spark):
    n = 40_000
    long = ["1 " * n + "1", "1" * n, "1-" * n + "1", "1234 " * n + "1", "a@" + "b." * n + "c", "a[at]b" + "[dot]c" * n]
    # The driver works these out, where an overflow is an error; in a task it ends the executor.
    for text in long:
        for kind in pii.KINDS:
            spark.sql("SELECT 1").select(F.lit(text).rlike(pii.FORM[kind]), pii._well_formed(kind, F.lit(text))).collect()
    rows, _ = planted_corpus(100)
    docs = spark.createDataFrame([*rows, *((1_000 + i, f"see {t} end") for i, t in enumerate(long))], "doc_id bigint, text string")
    got = pii.find(docs, pii.fit(docs, trees=2), ["doc_id"]).where("doc_id >= 1000").select("doc_id", pii.listed(F.col("base")).alias("b")).collect()
    assert {r.doc_id: r.b for r in got} == {1_000 + i: "email:4:80007" if t.startswith("a@") else "" for i, t in enumerate(long)}


def test_suffix_order_and_prefixes():
    rng = random.Random(3)
    for t in range(200):
        data = bytes(rng.choice(b"ab\xff" if t % 3 else b"abcdefgh") for _ in range(rng.randrange(80)))
        want = sorted(range(len(data)), key=lambda i, d=data: d[i:])
        assert suffixes.two_stage(data).tolist() == want
        common = suffixes.common_prefixes(data, np.array(want, int), 24) if data else []
        for k in range(1, len(want)):
            a, b = data[want[k - 1] :][:24], data[want[k] :][:24]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def slow_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return sorted(out)


def test_salted_joins_lose_and_repeat_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 8)
    rng = random.Random(2)
    rows = [(k, 7 if k % 3 == 0 else rng.randrange(40), k % 5) for k in range(600)]
    left = spark.createDataFrame(rows, "key bigint, anchor bigint, part bigint")
    right = spark.createDataFrame([(a, a * 10 + c) for a in range(0, 40, 7) for c in range(2)], "anchor bigint, low int")
    hot = suffixes.hot_ones(left.groupBy("anchor").agg(F.count("*").alias("times")), ["anchor"], 600)
    assert [tuple(r) for r in hot.collect()] == [(7, 3)]
    got = suffixes.salted_join(left, right, hot, ["anchor"], ["key"])
    assert got.columns == ["key", "anchor", "part", "low"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "anchor").select(*got.columns).collect()))


@pytest.mark.parametrize("most", [2, 250])
def test_repeated_strings_against_brute_force(spark, none, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_SLICES", most)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(2000))
    noise = lambda: "".join(rng.choice("xyz0123é") for _ in range(rng.randrange(90)))
    texts = [None, "", "aaa" * 100, "ab" * 30, base[:900], base[300:700] + "x" + base[:100], base[:900]]
    for _ in range(25):
        a = rng.randrange(1500)
        texts.append(noise() + base[a : a + rng.randrange(30, 300)] + noise())
    texts += [noise() + base[1000:1150] + noise() for _ in range(20)]
    rows = [(None if i == 4 else i, t, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[8]], "doc_id bigint, text string, kept string")
    got = suffixes.remove_repeated(docs, 40, carry=["doc_id", "kept"]).collect()
    assert sorted((r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r["_kept"])) for r in got) == slow_removal([*texts, texts[8]], 40)
    assert suffixes.remove_repeated(none, 40).count() == 0


def test_machine_learns_pairs():
    rng = np.random.default_rng(1)
    a, b = 11, 22  # either alone is harmless, both together are not
    terms, labels = [], []
    for _ in range(4_000):
        own = set(rng.integers(100, 140, 6).tolist()) | ({a} if rng.random() < 0.5 else set()) | ({b} if rng.random() < 0.5 else set())
        terms.append(np.array(sorted(own), np.int64))
        labels.append(float(a in own and b in own))
    model = toxicity.train(terms, np.array(labels), epochs=20)
    for own, toxic in (({a}, False), ({b}, False), ({a, b}, True), (set(), False)):
        rows = model.rows(np.array(sorted(own), np.int64))
        score = toxicity.logistic(model.margins(rows[rows >= 0], np.zeros((rows >= 0).sum(), int), 1))[0]
        assert (score >= 0.5) == toxic


def test_margins_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    model = toxicity.Machine(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    docs = [sorted(rng.choice(30, rng.integers(0, 12), replace=False).tolist()) for _ in range(20)]
    flat, owner = np.array([t for d in docs for t in d], int), np.repeat(np.arange(20), [len(d) for d in docs])
    want = [0.3 + sum(model.weights[d]) + sum(model.factors[a] @ model.factors[b] for a in d for b in d if a < b) for d in docs]
    assert np.allclose(model.margins(flat, owner, 20), want)


def test_pairs_are_learnt_whose_terms_tell_nothing_alone(spark):
    rng = random.Random(5)
    words = [prose(1000 + k, 1) + f"{k}" for k in range(60)]
    rows, toxic = [], {}
    for i in range(8_000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        own = [*rng.sample(words, 12), *(["grumbler"] if insult else []), *(["villagers"] if group else [])]
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        toxic[i] = int(insult == group)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels, F.col("doc_id") < 6_000, ["doc_id"]).where("doc_id >= 6000").collect()
    assert sum((r.score >= 0.5) == bool(toxic[r.doc_id]) for r in got) >= 0.95 * len(got)


def test_toxicity_rows(spark, none):
    rows = [(i, f"{prose(i, 30)} {'idiot' if i % 4 == 0 else ''} {prose(-i, 30)}") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(900, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, F.col("doc_id") < 300, ["doc_id"]).collect()}
    assert len(got) == 402 and all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400)) and got[900] == got[901] < 0.5
    alone = toxicity.toxicity(docs, labels.limit(0), F.lit(True), ["doc_id"]).collect()
    assert {r.score for r in alone} == {0.5}
    assert toxicity.toxicity(none, labels, F.lit(True), ["doc_id", "score"]).columns == ["doc_id", "score", "_score"]


def test_attention_probabilities_sum_to_one_and_gradients_fit():
    rng = np.random.default_rng(2)
    weights = attention.fresh(rng.random(attention.SYMBOLS))
    flat, sizes = rng.integers(0, 50, 70), np.array([40, 1, 29])
    layout = attention.windows(flat, sizes)
    assert layout.wanted[layout.real].tolist() == flat.tolist()
    scorer = attention.Scorer(weights)
    total = 0.0
    for symbol in range(attention.SYMBOLS):
        other = attention.windows(np.array([5, 6, symbol]), np.array([3]))
        total += np.exp(scorer.log_probabilities(other)[0, 2])
    assert abs(total - 1) < 1e-3
    trainer = attention.Trainer(weights, rate=0.0)
    loss = trainer.step(layout)
    assert abs(loss + scorer.log_probabilities(layout).sum() / 70) < 1e-4
    gradient = trainer.mean * 10
    for name in ("query", "value", "offset", "own", "past", "member_out", "embed"):
        where = int(np.argmax(np.abs(attention.unpack(gradient)[name]))) + int(attention.unpack(np.arange(attention.SIZE))[name].flat[0])
        up, down = weights.copy(), weights.copy()
        up[where] += 1e-2
        down[where] -= 1e-2
        slope = (attention.Scorer(down).log_probabilities(layout).sum() - attention.Scorer(up).log_probabilities(layout).sum()) / 70 / 2e-2
        assert abs(slope - gradient[where]) < 0.05 * abs(gradient[where]) + 1e-3, name


def test_a_window_sees_no_other_text():
    weights = attention.fresh(np.ones(attention.SYMBOLS))
    one, two = np.arange(40), np.arange(50, 90)
    alone = attention.Scorer(weights).log_probabilities(attention.windows(two, np.array([40])))
    both = attention.Scorer(weights).log_probabilities(attention.windows(np.concatenate((one, two)), np.array([40, 40])))
    assert np.allclose(alone.sum(), both[3:].sum(), atol=1e-3)


def test_language_model_counts(spark, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY_SHARE", 0.05)
    model = pieces.read_model(MODEL)
    usable = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 0, F.lit(False))
    counts = Counter()
    for r in odd.collect():
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3:
            counts.update([*(r.text or "").encode().lower().split(), b""])
    total, spread = sum(counts.values()), np.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    got = lm.score_documents(odd, usable, model, carry=["doc_id", "text", "score"], first_steps=10).collect()
    assert len(got) == odd.count()
    for r in got:
        tokens = [*(r.text or "").encode().lower().split(), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert abs(r.base_score - sum(np.log10(counts[t] + 0.1) - spread for t in tokens)) < 1e-6 * len(tokens)
        assert r["_score"] < 0
    assert lm.score_documents(none, usable, model).count() == 0


def test_queries_run_on_odd_rows(spark, folder, odd):
    for name in ("op1_sharding", "op2_toxicity", "op3_lm", "op4_pii", "op5_suffixes", "op8_quality", "op10_pieces"):
        rows = QUERIES[name](spark, folder).collect()
        assert len(rows) == odd.count(), name
    assert QUERIES["op7_mixing"](spark, folder).count() > 0


def test_digests(spark, folder):
    rows = {r.doc_id: r for r in QUERIES["op10_pieces"](spark, folder).collect()}
    assert rows[1].ids_sha256 == hashlib.sha256(b"2").hexdigest() and rows[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_every_training_text_is_in_a_round(spark, monkeypatch):
    model = pieces.read_model(MODEL)
    texts = [prose(i, 20 + i % 7) for i in range(120)]
    docs = spark.createDataFrame([(t, i * 1_000_000 // 120) for i, t in enumerate(texts)], "text string, draw bigint")
    shared = spark.sparkContext.broadcast(model)
    symbols = lm.Symbols(np.ones(len(model.names)), len(texts))
    rounds, averaged = [], lm._averaged
    monkeypatch.setattr(lm, "_averaged", lambda rows: rounds.append(sum(r.seen for r in rows.select("seen").collect())) or averaged(rows))
    lm.train(docs, shared, symbols, first_docs=5, first_steps=1)
    wanted = symbols.of([lm.words_of(t) for t in texts], model).totals
    assert sum(rounds) == int(wanted.sum())


def test_a_word_is_one_symbol_and_scores_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY_SHARE", 0.01)
    monkeypatch.setattr(lm, "MET_WORDS", 20)
    monkeypatch.setattr(lm, "BATCH", 16)
    monkeypatch.setattr(lm, "OWN_WORDS", 40)
    model, made = pieces.read_model(MODEL), []
    monkeypatch.setattr(lm, "train", lambda docs, shared, symbols: made.append(symbols) or attention.fresh(symbols.counts))
    texts = [*(prose(i, 30 + i) + f" x{i} Ünder{i % 3}" for i in range(60)), "", None, "  zq日本 zq日本", "\x00 \x7f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(rows, F.col("doc_id") % 4 != 0, model).collect()}
    counts, symbols = Counter(), made[0]
    for i, t in enumerate(texts):
        counts.update(lm.words_of(t or "") if i % 4 else [])
    own = dict(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:40])
    assert {w: int(symbols.counts[k]) for w, k in symbols.own.items()} == own
    begin = {n[1:].encode(): i for n, i in ((n, i) for i, n in enumerate(model.names)) if n[0] == "▁"}
    place = dict(zip(symbols.pieces.tolist(), symbols.places.tolist(), strict=True))
    group = lambda w: next((place[begin[w[:k]]] for k in range(len(w), 0, -1) if begin.get(w[:k]) in place), lm.OTHER_SYMBOL)
    size = lambda w: next((k for k in range(len(w), 0, -1) if begin.get(w[:k]) in place), 0)
    tokens, types, pairs = Counter(), Counter(), Counter()
    for w, n in counts.items():
        if w not in own:
            tokens[group(w)] += n
            types[group(w)] += 1
            pairs.update(zip(b" " + w, w + b" ", strict=True))
    before = Counter()
    for (a, _), n in pairs.items():
        before[a] += n
    scorer = attention.Scorer(attention.fresh(symbols.counts))
    for i, t in enumerate(texts):
        words = lm.words_of(t or "")
        laid = symbols.of([words], model)
        assert laid.totals.tolist() == [len(words) + 1]
        want = scorer.log_probabilities(attention.windows(laid.symbols, laid.totals)).sum() / np.log(10)
        for w in words:
            if w not in own:
                letters = list(zip(b" " + w, w + b" ", strict=True))[size(w) :]
                worth = (types[group(w)] + 1) * np.prod([(pairs[p] + 1 / 256) / (before[p[0]] + 1) for p in letters])
                want += np.log10((counts[w] + worth) / (tokens[group(w)] + types[group(w)] + 1))
        assert abs(got[i] - want) < 1e-3 * len(words) + 1e-3, (i, got[i], want)


def test_scores_by_pieces_are_those_of_whole_encoded_texts(spark, folder, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY_SHARE", 0.01)
    monkeypatch.setattr(lm, "MET_WORDS", 200)
    monkeypatch.setattr(lm, "BATCH", 16)
    model, made = pieces.read_model(MODEL), []
    monkeypatch.setattr(lm, "train", lambda docs, shared, symbols: made.append(symbols) or attention.fresh(symbols.counts))
    texts = [*(prose(i, 30 + i) + f" x{i} \u00dcnder{i % 3}" for i in range(60)), "", None, "  zq\u65e5\u672c zq\u65e5\u672c", "\x00 \x7f", "\u2581x a\u2581b \u2581 " + "y" * 99]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(rows, F.col("doc_id") % 4 != 0, model, by_pieces=True).collect()}
    whole = [b" ".join(lm.words_of(t or "")).decode() for t in texts]
    ids = [found[0] for found in pieces.read_model(MODEL).encode_all(whole)]
    counts = np.zeros(len(model.names))
    for i, found in enumerate(ids):
        if i % 4:
            np.add.at(counts, found, 1)
    own = np.argsort(-counts, kind="stable")[: lm.END_SYMBOL]
    symbol = {int(k): at for at, k in enumerate(own)}
    rest = [k for k in range(len(counts)) if k not in symbol]
    spread = counts[rest].sum() + 0.1 * len(rest)
    symbols = made[0]
    assert symbols.counts[: lm.END_SYMBOL].tolist() == counts[own].tolist()
    assert symbols.counts[lm.END_SYMBOL] == sum(i % 4 > 0 for i in range(len(texts)))
    scorer = attention.Scorer(attention.fresh(symbols.counts))
    for i, found in enumerate(ids):
        flat = np.array([*(symbol.get(int(k), lm.OTHER_SYMBOL) for k in found), lm.END_SYMBOL])
        laid = symbols.of([lm.words_of(texts[i] or "")], model)
        assert laid.symbols.tolist() == flat.tolist() and laid.totals.tolist() == [len(flat)]
        want = scorer.log_probabilities(attention.windows(flat, np.array([len(flat)]))).sum() / np.log(10)
        want += sum(np.log10((counts[k] + 0.1) / spread) for k in found if int(k) not in symbol)
        assert abs(got[i] - want) < 1e-3 * len(flat), (i, got[i], want)
    # The query encodes.
    monkeypatch.undo()
    counted, count = [], lm.count_pieces
    monkeypatch.setattr(lm, "count_pieces", lambda words, shared: counted.append(count(words, shared)) or counted[-1])
    assert QUERIES["op3_lm"](spark, folder).count() > 0 and counted[0].sum() > 0
