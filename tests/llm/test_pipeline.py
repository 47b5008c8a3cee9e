"""The pipeline's stages, each held against what its operator must do."""

from __future__ import annotations

import re

import corpus_pipeline
from umbra.llm import quality, secrets
from umbra.llm.common import documents, written

from test_text_operators import near_duplicate_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    seen = [docs.cache()]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
    good, single, clean, mixed, tokens = seen[1:]
    assert all(x.columns == columns for x in (good, single, clean, mixed))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) == ids(quality.query(docs).where("kept"))
    # One of each group at five-word similarity 0.8, by all pairs; ids ascend, so a group's index is its smallest id's.
    rows = sorted((r.doc_id, r.text) for r in good.select("doc_id", "text").collect())
    assert ids(single) == {rows[k][0] for k in near_duplicate_groups([t for _, t in rows])} and single.count() == len(ids(single))
    assert ids(clean) == ids(single) and secrets.query(clean).selectExpr("sum(n_assign + n_access + n_hex)").first()[0] == 0
    assert ids(mixed) <= ids(clean) and ids(tokens) == ids(mixed) and tokens.count() == mixed.count()
    texts = {r.doc_id: r.text for r in clean.select("doc_id", "text").collect()}
    for r in mixed.select("doc_id", "text").collect():
        assert r.text == texts[r.doc_id] or re.findall(r"\S+", r.text) == re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])[: len(r.text.split(" "))]
    assert corpus_pipeline.run(spark, SF).count() == tokens.count()
