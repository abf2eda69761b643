"""Rounds on few rows do not go through every partition of every exchange."""

import brute
import pytest
from test_ngram_join import _family

from laminae.llm import ngram_join

PARTITIONS = 64


@pytest.fixture
def held(spark):
    """Many partitions that Spark does not merge, as with a table that is dealt over many."""
    want = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_small_rounds_take_few_tasks(held):
    rows = _family(1)
    docs = held.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held.sparkContext.setJobGroup("small-rounds", "near duplicates")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85).collect()}
    tracker = held.sparkContext.statusTracker()
    held.sparkContext.setJobGroup("", "")
    stages = {s for job in tracker.getJobIdsForGroup("small-rounds") for s in tracker.getJobInfo(job).stageIds}
    wide = sum(i.numTasks >= PARTITIONS for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks)
    assert got == brute.near(rows, 4, 85)
    assert wide <= 25


@pytest.mark.parametrize("size", [7, 100_000])
def test_parts_do_not_change_links(spark, monkeypatch, size):
    monkeypatch.setattr(ngram_join, "PART_POSTINGS", size)
    rows = _family(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85).collect()}
    assert got == brute.near(rows, 4, 85)
