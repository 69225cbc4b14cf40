"""The pipeline on the smallest tables, stage by stage, against what each stage's own operator says."""

from __future__ import annotations

import corpus_pipeline
from clickrank.llm import decontaminate, jaccard_join, quality_rules, secret_scan
from clickrank.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = written(docs, "test-docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, written(stage(spark, kept, SF), "test-stage")
        assert kept.columns == docs.columns, name
        assert kept.count() <= before.count()
        if name == "quality_rules":
            want = {r.doc_id for r in quality_rules.score_quality(before, table(spark, SF, "labels")).where("kept").collect()}
        elif name == "ngram_jaccard":
            rows = jaccard_join.jaccard_components(before, jaccard_join.JaccardConfig(words=5, percent=80)).collect()
            want = {r.component_id for r in rows}
        elif name == "decontamination":
            rows = decontaminate.score_contamination(before, table(spark, SF, "benchmark")).where("not contaminated").collect()
            want = {r.doc_id for r in rows}
        else:
            want = {r.doc_id for r in before.collect()}
            assert secret_scan.report(kept, secret_scan.scan(kept)[0]).where("n_assign + n_access + n_hex > 0").count() == 0
        assert {r.doc_id for r in kept.collect()} == want, name
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {"doc_id", "epoch", "n_tokens"} <= set(out.columns) and out.count() > 0
