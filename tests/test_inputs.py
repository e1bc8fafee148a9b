"""Inputs are bound by name, and what is missing is an error."""

import pytest

from vitalspark.operators.numbering import dense_index
from vitalspark.sources import read_table
from vitalspark.sources.event_log import read_events


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    path = tmp_path / "daily_sleep.csv"
    path.write_text("Id,SleepDay,TotalTimeInBed,TotalMinutesAsleep,TotalSleepRecords\n7,1/2/2020 12:00:00 AM,90,60,1\n")
    row = read_table(spark, "daily_sleep", str(path)).head()
    assert (row["TotalMinutesAsleep"], row["TotalTimeInBed"], row["TotalSleepRecords"]) == (60, 90, 1)


def test_csv_missing_column_raises(spark, tmp_path):
    path = tmp_path / "daily_sleep.csv"
    path.write_text("Id,TotalTimeInBed\n7,90\n")
    with pytest.raises(ValueError, match="missing columns"):
        read_table(spark, "daily_sleep", str(path))


def test_event_log_with_other_names_raises(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "who").write.parquet(str(tmp_path / "events.parquet"))
    with pytest.raises(ValueError, match="missing columns"):
        read_events(spark, str(tmp_path))


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_dense_index_without_exchange_reuse(spark, reuse, adaptive):
    settings = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = dense_index(spark.range(200_000).selectExpr("id * 3 as Id"))
        assert out.where("Id_Consecutive != Id div 3 + 1 or Id_Consecutive is null").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
