"""The similarity join moves no texts between tasks and keeps the sets of one verification at a time."""

import os
import re
from collections import Counter

from oddsloom.llm import jaccard_join
from oddsloom.session import ensure_checkpoint_dir

from .cases import rows, table
from .test_llm_operators import brute_components, texts_of


def test_sets_are_made_where_the_texts_are(spark, monkeypatch):
    docs, plans, there = table(spark, rows(8)).repartition(3), [], []
    root = re.sub(r"^file:/+", "/", ensure_checkpoint_dir(spark))
    old = set(os.listdir(root))
    settled = jaccard_join.settled

    def watched(df, name, stays=False):
        if name == "sets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            there.append([x for x in os.listdir(root) if x not in old and re.match("sets-|prefixes-|shingle-counts-", x)])
        return settled(df, name, stays)

    monkeypatch.setattr(jaccard_join, "settled", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jaccard_join.linked_components(docs, 4, 85, sketch_bits=16).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(texts_of(docs), 4, 85)
    assert len(plans) > 1
    assert not [p for p in plans if re.search(r"Join.*doc_id", p)]
    assert there == [[] for _ in plans]
