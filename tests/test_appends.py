"""Keys that survive appends, and a summary that follows its loads."""

import pytest

from strata.operators.clean import clean
from strata.plans import queries as Q
from strata.sources.appends import AppendedTable, SummaryStore
from strata.sources.cohort import patients_raw


@pytest.mark.parametrize("parts", [1, 9])
def test_second_load_keeps_every_old_key(spark, sf_small, tmp_path, parts):
    raw = patients_raw(spark, sf_small).withColumnRenamed("id", "patient")
    table = AppendedTable(spark, f"{tmp_path}/t")
    keys = lambda: {r["patient"]: r["id"] for r in table.read().select("patient", "id").collect()}
    for load in range(3):
        before = keys() if load else {}
        assert table.append(raw.where(f"patient % 3 = {load}").repartition(parts)) == load + 1
        now = keys()
        assert before.items() <= now.items() and sorted(now.values()) == list(range(1, len(now) + 1))
    table.append(raw.limit(0))
    table.append(raw.where("patient % 3 = 0"))  # the same rows again are rows of their own
    ids = [r["id"] for r in table.read().select("id").collect()]
    assert len(ids) == len(set(ids)) == max(ids)


def test_a_failed_load_is_written_over(spark, sf_small, tmp_path):
    raw = patients_raw(spark, sf_small).drop("id")
    table = AppendedTable(spark, f"{tmp_path}/t")
    table.append(raw.limit(10))
    raw.limit(5).write.parquet(f"{tmp_path}/t/rows/load=2")  # rows without their range
    assert table.read().count() == 10
    table.append(raw.limit(7))
    ids = sorted(r["id"] for r in table.read().select("id").collect())
    assert ids == list(range(1, 18))


def test_summary_after_loads_and_replacements(spark, sf_small, tmp_path):
    raw = patients_raw(spark, sf_small, edge=True)
    part = lambda n: clean(raw.where(f"id % 3 = {n}"))
    store = SummaryStore(spark, f"{tmp_path}/s")
    for n in range(3):
        store.fold(f"file{n}", part(n))
    assert store.summary().collect() == Q.executive_summary(clean(raw)).collect()
    store.fold("file1", clean(raw.where("id % 3 = 1 and id % 2 = 0")))
    assert store.summary().collect() == Q.executive_summary(clean(raw.where("id % 3 <> 1 or id % 2 = 0"))).collect()
    store.fold("file1", part(1).limit(0))
    assert store.summary().collect() == Q.executive_summary(clean(raw.where("id % 3 <> 1"))).collect()
