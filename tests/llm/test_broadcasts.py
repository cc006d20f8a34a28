"""What is exploded, or small as a file alone, isn't sent whole through the driver."""

import pytest

import corpus_pipeline
from logloom.llm import common, neardup


@pytest.fixture
def plans(monkeypatch):
    """Name and first physical plan of each table that is written."""
    seen, write = [], common.written

    def written(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(common, "written", written)
    return seen


def test_bands_and_their_members_are_joined_where_they_are(spark, plans):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:k] + [f"x{n}"] + words[k:]) for n, k in enumerate([5, 60, 115, 30])] + ["quite another text of a few words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = neardup.near_duplicates(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.component_id for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6}
    told = dict(plans)
    assert {"bands", "members", "open", "labels"} <= told.keys()
    for name in ("bands", "members", "open", "labels"):
        assert "SortMergeJoin" in told[name] and "BroadcastHashJoin" not in told[name], name
    assert "SortMergeJoin" in plan  # documents meet their components


def test_near_duplicates_of_the_pipeline_stay_where_they_are(spark, plans):
    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(i, " ".join(words[:k] + [f"x{i}"] + words[k:])) for i, k in enumerate([5, 60, 115])] + [(3, "other words"), (None, "other words")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 3, None]
    told = dict(plans)
    assert all("BroadcastHashJoin" not in told[name] for name in ("bands", "members", "open", "labels"))
