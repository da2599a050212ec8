from __future__ import annotations

from collections import Counter

from tremor.llm import exact_dedup as ed


def test_index_merges_partial_groups(spark):
    """No aggregation stands before the index: copies of several tasks reach it apart and come out as one group."""
    copies = [(i, f"text {i % 5}") for i in range(40)] + [(None, "text 0")]
    rows = ed.digests(spark.createDataFrame(copies, "doc_id long, text string").repartition(4))
    groups = ed.groups(rows)
    assert "Aggregate" not in groups._jdf.queryExecution().executedPlan().toString()
    assert ed.partials(rows).count() > groups.count() == 5
    assert {r.keep_id: r.group_size for r in groups.collect()} == {i: n for i, n in Counter(i % 5 for i in range(40)).items()} | {0: 9}


def test_partial_groups_are_sent_on_when_many(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(ed, "HELD_GROUPS", 3)
    batch = pd.DataFrame({"digest": [b"a", b"b", b"a"], "n_points": [3, 1, 4], "doc_id": [1, 2, 0], "missing": [False, False, True]})
    sent = list(ed._combine(iter([batch, batch.assign(digest=[b"c", b"d", b"a"]), batch])))
    assert len(sent) == 2 and pd.concat(sent)["size"].sum() == 9
    merged = pd.concat(ed._index_shard(iter(sent))).set_index("digest")
    assert merged.loc[b"a", "group_size"] == 5 and pd.isna(merged.loc[b"a", "keep_id"])
