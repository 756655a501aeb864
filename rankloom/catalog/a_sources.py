"""Scans and sinks: every query writes the log somewhere and reads it back."""

from rankloom.catalog.base import hash_sql, query
from rankloom.sources import logs, sinks
from rankloom.sources.schema import LABEL_COLUMNS, LOG_COLUMNS, log_schema
from rankloom.session import frees_shuffles, stage_folder

_TYPES = {f.name: f.dataType.simpleString() for f in log_schema().fields}
_EXACT = [c for c in LOG_COLUMNS if _TYPES[c] != "double"]
_DOUBLES = [c for c in LOG_COLUMNS if _TYPES[c] == "double"]
#: Compressed, since the text is ten times the tables it comes from; a reader finds the method by the file name.
_CSV_OPTIONS = {
    "header": True, "nullValue": logs.NULL_TOKEN, "timestampNTZFormat": logs.TIMESTAMP_FORMAT, "compression": "gzip",
    "zlib.compress.level": "BEST_SPEED",
}


def _stage_csv(ctx, name, df):
    path = stage_folder(ctx.spark, name)
    with frees_shuffles(ctx.spark):
        df.write.mode("overwrite").options(**_CSV_OPTIONS).csv(path)
    return path


@query("A1_train_log_csv", "SELECT * FROM log", exact=" ".join(_EXACT), d6=" ".join(_DOUBLES))
def train_log(ctx):
    path = _stage_csv(ctx, "train_csv", ctx.log.select(*LOG_COLUMNS))
    return logs.read_log(ctx.spark, path)


@query(
    "A2_test_log_csv", "SELECT * FROM log",
    exact=" ".join(c for c in _EXACT if c not in LABEL_COLUMNS),
    d6=" ".join(c for c in _DOUBLES if c not in LABEL_COLUMNS),
)
def test_log(ctx):
    columns = [c for c in LOG_COLUMNS if c not in LABEL_COLUMNS]
    path = _stage_csv(ctx, "test_csv", ctx.log.select(*columns))
    return logs.read_log(ctx.spark, path, labels=False)


_BIAS_COLUMNS = (
    "srch_id prop_id visitor_location_country_id prop_country_id srch_children_count click_bool booking_bool"
)


@query("A3_pruned_scan", "SELECT * FROM log", exact=_BIAS_COLUMNS)
def pruned_scan(ctx):
    path = _stage_csv(ctx, "pruned_csv", ctx.log.select(*LOG_COLUMNS))
    return logs.read_log(ctx.spark, path, columns=_BIAS_COLUMNS.split())


@query("A4_prediction_parquet", "SELECT * FROM scored", exact="srch_id prop_id booking_bool click_bool", d6="s1 s2 s3 s4")
def prediction_parquet(ctx):
    path = stage_folder(ctx.spark, "predictions")
    sinks.write_predictions(
        ctx.scored.select("srch_id", "prop_id", "booking_bool", "click_bool", "s1", "s2", "s3", "s4"), path
    )
    return sinks.read_predictions(ctx.spark, path)


@query(
    "A5_staged_sample",
    f"""
, ids AS (SELECT srch_id, row_number() OVER (ORDER BY {hash_sql('42', 'srch_id')}, srch_id) AS r,
        count(*) OVER () AS n FROM (SELECT DISTINCT srch_id FROM log))
SELECT l.* FROM log l JOIN ids USING (srch_id) WHERE r <= greatest(1, CAST(floor(n * 0.15e0) AS BIGINT))""",
    exact="srch_id prop_id site_id position", d6="price_usd",
)
def staged_sample(ctx):
    return logs.staged_sample(ctx.log, stage_folder(ctx.spark, "samples"), 0.15, refresh=True)


@query(
    "A6_ranked_list",
    """SELECT srch_id, prop_id, CAST(row_number() OVER (PARTITION BY srch_id ORDER BY s1 DESC NULLS LAST, prop_id) AS INTEGER) AS place
       FROM scored""",
    exact="srch_id prop_id place",
)
def ranked_list(ctx):
    """The sink's order, read back as a place per search (checked by the query itself)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ordered = sinks.ranked_list(ctx.scored, "s1").withColumn("_line", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("srch_id").orderBy("_line"))
    return ordered.withColumn("place", place)


@query(
    "A7_ranked_list_guard",
    "SELECT count(*) AS n_rows, count(DISTINCT srch_id) AS n_searches FROM log", exact="n_rows n_searches",
)
def ranked_list_guard(ctx):
    from pyspark.sql import functions as F

    path = stage_folder(ctx.spark, "ranked_list")
    sinks.write_ranked_list(ctx.scored, "s1", path, overwrite=True)
    back = ctx.spark.read.csv(path, header=True, schema="srch_id long, prop_id long")
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("srch_id").alias("n_searches"))


@query(
    "A7_ranked_list_refusals",
    """
SELECT 'existing' AS trial, TRUE AS refused, count(*) AS n_rows FROM log UNION ALL
SELECT 'count', TRUE, count(*) + 1 FROM log UNION ALL SELECT 'order', count(DISTINCT srch_id) > 1, count(*) FROM log UNION ALL
SELECT 'none', FALSE, count(*) FROM log""",
    exact="trial refused n_rows",
)
def ranked_list_refusals(ctx):
    """What the guards refuse: to overwrite a list, a wrong number of rows, and ids that fall across files."""
    import uuid

    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    n = ctx.log.count()
    good, bad = (stage_folder(ctx.spark, f"list-{uuid.uuid4().hex}") for _ in range(2))
    sinks.write_ranked_list(ctx.scored, "s1", good)
    falling = ctx.scored.select("srch_id", "prop_id").orderBy(F.desc("srch_id"))
    falling.write.csv(bad, header=True)

    def refused(attempt) -> bool:
        try:
            attempt()
        except (AnalysisException, ValueError):
            return True
        return False

    trials = [
        ("existing", n, lambda: sinks.write_ranked_list(ctx.scored, "s1", good)),
        ("count", n + 1, lambda: sinks.check_ranked_list(ctx.spark, good, n + 1)),
        ("order", n, lambda: sinks.check_ranked_list(ctx.spark, bad, n)),
        ("none", n, lambda: sinks.check_ranked_list(ctx.spark, good, n)),
    ]
    return ctx.spark.createDataFrame(
        [(name, refused(attempt), rows) for name, rows, attempt in trials], "trial string, refused boolean, n_rows long"
    )


@query(
    "A8_run_record",
    "SELECT count(*) AS n_rows, avg(CAST(booking_bool AS DOUBLE)) AS booking_rate FROM log",
    exact="n_rows", d6="booking_rate",
)
def run_record(ctx):
    from rankloom.operators.profile import label_rates, log_overview

    counts, rates = log_overview(ctx.log).first(), label_rates(ctx.log).first()
    path = stage_folder(ctx.spark, "run_record")
    sinks.write_run_record(ctx.spark, {"rows": counts["n_rows"], "rates": rates.asDict()}, path)
    record = sinks.read_run_record(ctx.spark, path)
    return ctx.spark.createDataFrame(
        [(record["rows"], record["rates"]["booking_rate"])], "n_rows long, booking_rate double"
    )


@query(
    "A9_audit_table_csv",
    "SELECT random_bool, avg(CAST(click_bool AS DOUBLE)) AS click_rate, count(*) AS n_rows FROM log GROUP BY random_bool",
    exact="random_bool n_rows", d6="click_rate",
)
def audit_table(ctx):
    from rankloom.operators.profile import order_rates

    path = stage_folder(ctx.spark, "audit_csv")
    sinks.write_table_csv(order_rates(ctx.log), path)
    return ctx.spark.read.csv(
        path, header=True, schema="random_bool int, booking_rate double, click_rate double, n_rows long"
    )
