"""What a job leaves on disk while it runs."""

import glob
import os
import time
from types import SimpleNamespace

from rankloom.catalog import a_sources
from rankloom.session import cut_lineage, stage_buckets, stage_table

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles(spark):
    """Shuffle ids that still have files."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {os.path.basename(f).split("_")[1] for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*")}


def test_writes_leave_no_shuffle_files(spark):
    df = spark.range(1000).selectExpr("id as srch_id", "id % 7 as x").repartition(3, "x")
    for write in (cut_lineage, lambda d: stage_table(d, "t"), lambda d: stage_buckets(d, "b", ["srch_id"], 2)):
        before = shuffles(spark)
        written = write(df)
        for _ in range(50):
            new = shuffles(spark) - before
            if not new:
                break
            time.sleep(0.1)
        assert not new and written.count() == 1000
    assert spark.conf.get(SETTING, "false") == "false"


def test_a_shared_plan_can_be_computed_again(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as x").repartition(3, "x")
    kept = df.persist()
    assert kept.limit(1).count() == 1
    assert stage_table(kept, "t").count() == stage_table(kept.groupBy("x").count(), "t").selectExpr("sum(count)").first()[0] == 1000
    kept.unpersist()


def test_staged_csv_is_compressed_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(a_sources, "stage_folder", lambda s, name: str(tmp_path / name))
    path = a_sources._stage_csv(SimpleNamespace(spark=spark), "csv", spark.sql("select 1 a, cast(null as string) b"))
    files = glob.glob(f"{path}/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert spark.read.option("header", True).option("nullValue", "NULL").csv(path).collect()[0].asDict() == {"a": "1", "b": None}
