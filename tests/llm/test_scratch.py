"""Intermediate tables are deleted with their scope; kept ones and outer ones stay."""

from __future__ import annotations

import os

import pytest

from metricspark.llm import ngram_join
from metricspark.llm.tables import scratch, stored


def there(df):
    return os.path.isdir(df.stored_at.removeprefix("file:"))


def test_scopes(spark):
    with scratch() as outer:
        a = stored(spark.range(3).toDF("x"))
        with scratch() as inner:
            b, c = stored(a), stored(a)
            kept = inner.keep(stored(b.union(c)))
            inner.drop(b)
            assert not there(b) and there(c)
        assert there(a) and not there(c) and there(kept) and kept.count() == 6
        last = outer.keep(stored(kept))
    assert not there(a) and not there(kept) and sorted(r.x for r in last.collect()) == [0, 0, 1, 1, 2, 2]
    with pytest.raises(ZeroDivisionError), scratch():
        d = stored(last)
        1 / 0
    assert not there(d) and there(stored(last))


def test_join_leaves_one_table(spark, edge_docs):
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        stored(spark.range(1))
        folder = spark.sparkContext.getCheckpointDir()
    path = folder.removeprefix("file:")
    before = set(os.listdir(path))
    ngram_join.ngram_components(edge_docs)
    assert len([x for x in set(os.listdir(path)) - before if x.startswith("llm-")]) == 1
