"""Versions of a table under several writers, and under one that breaks off."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from trackloom.operators import runs as R


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root, schema = str(tmp_path / "table"), "writer long, n long"

    def write(writer):
        for n in range(4):
            row = spark.createDataFrame([(writer, n)], schema)
            R.update(spark, root, lambda rows, row=row: row if rows is None else rows.unionByName(row), tries=60)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    assert sorted((r.writer, r.n) for r in R.latest(spark, root).collect()) == [(w, n) for w in range(3) for n in range(4)]
    assert R.newest(spark, root) == 11
    assert {n for n in os.listdir(root) if n.startswith("version=")} == {f"version={k}" for k in range(12)}
    assert os.listdir(f"{root}/.aside") == [] or all(n.endswith(".crc") for n in os.listdir(f"{root}/.aside"))
    assert all("_SUCCESS" in os.listdir(f"{root}/version={k}") and not any(os.path.isdir(f"{root}/version={k}/{n}") for n in os.listdir(f"{root}/version={k}")) for k in range(12))


def test_conflicts_and_broken_writes(spark, tmp_path):
    root, rows = str(tmp_path / "table"), spark.range(5)
    assert R.newest(spark, root) is None
    assert R.commit(rows, root, None) == 0
    assert R.commit(rows.where("id < 3"), root, 0) == 1
    for stale in (None, 0):
        with pytest.raises(R.Conflict):
            R.commit(rows, root, stale)
    with pytest.raises(Exception, match="broken"):
        R.commit(spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")), root, 1)
    # a version begun by a writer without the last step: no marker, so it is passed over
    os.makedirs(f"{root}/version=7")
    assert R.newest(spark, root) == 1 and R.latest(spark, root).count() == 3
    assert R.update(spark, root, lambda t: t.where("id > 0")) == 8
    assert sorted(r.id for r in R.latest(spark, root).collect()) == [1, 2]
