from __future__ import annotations

from collections import Counter

import corpus_pipeline
from playmetrics.llm import quality, simhash
from playmetrics.sources.tables import settle

from .conftest import prose


def distance(a, b):
    return (simhash.fingerprint(a, 3) ^ simhash.fingerprint(b, 3)).bit_count()


def test_stages_on_odd_rows(spark, odd, folder):
    docs = odd
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, folder), name)
        if name != "encode":
            assert out.columns == odd.columns
        counts.append(out.count())
        docs = out
    assert counts[0] < odd.count() and counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] == counts[4]


def test_each_stage_on_its_own_input(spark, odd, none, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    kept = corpus_pipeline.keep_quality(spark, odd, folder).collect()
    assert Counter(r.text for r in kept) == Counter(r.text for r in quality.assess(odd, carry=("text",)).where("kept").collect())
    single = corpus_pipeline.keep_distinct(spark, odd, folder).collect()
    assert sorted((r.text or "") for r in single) == sorted({r.text or "" for r in odd.collect()})
    near = prose(20, 400)
    close = next(t for t in (f"{near} {w}" for w in "abcdefgh") if 0 < distance(t, near) <= 2)
    rows = [(5, near), (2, close), (None, near), (9, prose(21, 200)), (9, prose(22, 200)), (9, prose(22, 200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.keep_one_near(spark, docs, folder).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(2, close), (9, prose(21, 200)), (9, prose(22, 200))])


def test_the_whole_pipeline_keeps_clean_texts(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= set(range(15)) | {None} and all(r.n_tokens == len(r.ids) for r in got)
