import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rankloom.operators import joins, sampling
from rankloom.sources import logs, sinks
from rankloom.sources.schema import LABEL_COLUMNS, LOG_COLUMNS

OPTIONS = {"header": True, "nullValue": "NULL", "timestampNTZFormat": logs.TIMESTAMP_FORMAT}


@pytest.fixture()
def csv(log, tmp_path):
    path = str(tmp_path / "log")
    log.write.options(**OPTIONS).csv(path)
    return path


def test_train_scan_round_trip(spark, log, csv):
    back = logs.read_log(spark, csv)
    assert back.columns == LOG_COLUMNS and back.schema == log.schema
    assert back.exceptAll(log).isEmpty() and log.exceptAll(back).isEmpty()


def test_null_token_becomes_null(spark, csv):
    text = spark.read.text(csv).first()[0] + spark.read.text(csv).tail(1)[0][0]
    assert "NULL" in text
    assert not logs.read_log(spark, csv).where("comp1_rate is null").isEmpty()


def test_pruned_scan_parses_only_its_columns(spark, csv):
    df = logs.read_log(spark, csv, columns=["srch_id", "click_bool"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<srch_id:bigint,click_bool:int>" in plan


def test_test_log_has_no_labels(spark, log, tmp_path):
    path = str(tmp_path / "t")
    logs.drop_labels(log).write.options(**OPTIONS).csv(path)
    assert not set(LABEL_COLUMNS) & set(logs.read_log(spark, path, labels=False).columns)


def test_sample_is_whole_searches_of_exact_size(log):
    got = sampling.sample_searches(log, 0.25, 3)
    ids = [r[0] for r in got.select("srch_id").distinct().collect()]
    assert len(ids) == int(60 * 0.25)
    assert got.count() == log.where(F.col("srch_id").isin(ids)).count()
    assert sampling.sample_searches(log, 1.0).count() == log.count()
    assert sampling.sample_searches(log, 1e-6).select("srch_id").distinct().count() == 1
    with pytest.raises(ValueError):
        sampling.sample_searches(log, 0.0)


def test_staged_sample_is_reused(log, tmp_path):
    first = logs.staged_sample(log, str(tmp_path), 0.2)
    again = logs.staged_sample(log.limit(0), str(tmp_path), 0.2)
    assert again.count() == first.count() > 0


def test_negative_dropout_rules(log):
    kept = sampling.drop_negatives(log, 0.9, 1)
    positive = "click_bool = 1 or booking_bool = 1"
    assert kept.where(positive).count() == log.where(positive).count()
    assert kept.select("srch_id").distinct().count() == 60
    assert kept.count() < log.count()
    assert sampling.drop_negatives(log, 0.0).count() == log.count()


def test_ranked_list_order_and_guards(log, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.write_ranked_list(log, "price_usd", path) == log.count()
    with pytest.raises(AnalysisException):
        sinks.write_ranked_list(log, "price_usd", path)
    got = [tuple(r) for r in sinks.ranked_list(log, "price_usd").collect()]
    pdf = log.select("srch_id", "prop_id", "price_usd").toPandas()
    want = pdf.sort_values(["srch_id", "price_usd", "prop_id"], ascending=[True, False, True])
    assert got == list(zip(want["srch_id"], want["prop_id"]))


def test_written_list_is_checked_across_files_and_within(spark, tmp_path):
    def listed(name, ids, parts):
        path = str(tmp_path / name)
        spark.createDataFrame([(i, 1) for i in ids], "srch_id long, prop_id long").coalesce(parts).write.csv(path, header=True)
        return path

    rising = spark.range(0, 5000, 1, 7).selectExpr("id div 3 as srch_id", "id as prop_id")
    good = str(tmp_path / "good")
    rising.write.csv(good, header=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several pieces a file
    try:
        assert sinks.check_ranked_list(spark, good, 5000) == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="5000 rows"):
        sinks.check_ranked_list(spark, good, 4999)
    with pytest.raises(ValueError, match="do not rise"):
        sinks.check_ranked_list(spark, listed("within", [1, 3, 2], 1), 3)
    with pytest.raises(ValueError, match="do not rise"):
        sinks.check_ranked_list(spark, listed("null", [1, None, 2], 1), 3)
    fall = str(tmp_path / "fall")
    rising.orderBy(F.desc("srch_id")).coalesce(4).write.csv(fall, header=True)
    with pytest.raises(ValueError, match="do not rise"):
        sinks.check_ranked_list(spark, fall, 5000)
    assert sinks.check_ranked_list(spark, listed("empty", [], 1), 0) == 0
    assert sinks.check_ranked_list(spark, listed("same", [4, 4, 4], 2), 3) == 3


def test_run_record(spark, tmp_path):
    record = {"weights": {"a": 0.5}, "folds": [1, 2], "name": "x", "none": None}
    sinks.write_run_record(spark, record, str(tmp_path / "r"))
    assert sinks.read_run_record(spark, str(tmp_path / "r")) == record


def test_duplicate_key_check(log):
    joins.assert_unique(log)
    with pytest.raises(ValueError):
        joins.assert_unique(log.unionByName(log))


def test_attach_labels_prefers_present_values(log):
    pred = log.select("srch_id", "prop_id", F.lit(7).alias("click_bool"))
    out = joins.attach_labels(pred, log)
    assert out.where("click_bool <> 7").isEmpty() and "is_domestic" in out.columns
