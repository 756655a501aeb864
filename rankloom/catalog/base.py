"""Registry of queries and the shared inputs they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.rows import window_bucket
from rankloom.functions.snap import snap, snap_sql
from rankloom.operators.sampling import with_folds
from rankloom.operators.skew import SEARCH, oversized_groups
from rankloom.session import stage_buckets, stage_table
from rankloom.sources.adapter import LOG_EXPRESSIONS, bucket_count, log_view, search_base

SCORES = ["s1", "s2", "s3", "s4"]
_staged: dict[tuple[str, str], DataFrame] = {}
_oversized: dict[tuple[str, str], DataFrame | None] = {}


class Context:
    """The tables of one scale factor, as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def log(self) -> DataFrame:
        """The search log over rows that are staged once per session in the shared folder, in buckets of searches."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _staged:
            base = stage_buckets(search_base(self.spark, self.sf_dir, self.buckets), "log", SEARCH, self.buckets)
            _oversized[key] = oversized_groups(base, SEARCH)
            if _oversized[key] is not None:
                # a bucket is one task: an oversized search is spread by range order instead
                base = stage_table(base.repartitionByRange("srch_id", "prop_id"), "log")
            _staged[key] = base
        return log_view(_staged[key])

    @cached_property
    def big(self) -> DataFrame | None:
        """Oversized searches of the log, looked up once per session and folder."""
        self.log
        return _oversized[(self.spark.sparkContext.applicationId, self.sf_dir)]

    @cached_property
    def buckets(self) -> int:
        """Buckets of searches in which the log lies; they grow with its rows."""
        return bucket_count(self.spark, self.sf_dir)

    def by_search(self, df: DataFrame) -> DataFrame:
        """Rows of the log that a lookup may have moved, put back into its buckets, so that a task's windows stay small.

        Where they lie so still, Spark leaves the step out. Oversized searches are left to the windows' other route.
        """
        return df if self.big is not None else df.repartition(self.buckets, *SEARCH)

    @cached_property
    def folds(self) -> DataFrame:
        """The log with its 5-fold column."""
        return with_folds(self.log, 5)

    @cached_property
    def scored(self) -> DataFrame:
        """The log with four stand-in model scores and the segment columns."""
        return self.log.withColumns({
            "s1": F.col("prop_location_score1"),
            "s2": -F.col("price_usd"),
            "s3": 2.0 * F.col("prop_starrating") + F.coalesce("prop_review_score", F.lit(0.0)),
            "s4": -F.col("position").cast("double"),
            "is_domestic": (F.col("visitor_location_country_id") == F.col("prop_country_id")).cast("int"),
            "is_family": (F.col("srch_children_count") > 0).cast("int"),
        })


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}

BUCKET_SQL = (
    "CASE WHEN srch_booking_window > -1 AND srch_booking_window <= 0 THEN 0e0 "
    "WHEN srch_booking_window <= -1 THEN NULL WHEN srch_booking_window <= 1 THEN 1e0 "
    "WHEN srch_booking_window <= 7 THEN 2e0 WHEN srch_booking_window <= 14 THEN 3e0 "
    "WHEN srch_booking_window <= 30 THEN 4e0 WHEN srch_booking_window <= 90 THEN 5e0 "
    "WHEN srch_booking_window <= 365 THEN 6e0 WHEN srch_booking_window <= 9999 THEN 7e0 END"
)


def hash_sql(prefix: str, *ids: str) -> str:
    text = f"'{prefix}:'||" + "||':'||".join(f"CAST({i} AS VARCHAR)" for i in ids)
    return f"CAST('0x'||substring(md5({text}),1,8) AS BIGINT)"


def _prefix() -> str:
    columns = ",\n  ".join(f"{sql} AS {name}" for name, sql in LOG_EXPRESSIONS.items())
    return f"""WITH impressions AS (
  SELECT l_orderkey AS srch_id, l_partkey AS prop_id, min(l_linenumber) AS position,
    max(l_extendedprice) AS price_raw, max(l_discount) AS disc, max(l_tax) AS tax, max(l_quantity) AS qty,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS booking_bool,
    max(CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END) AS click_bool
  FROM lineitem GROUP BY l_orderkey, l_partkey),
log AS (SELECT {columns}
  FROM impressions JOIN orders ON srch_id = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON prop_id = p_partkey),
scored AS (SELECT *, prop_location_score1 AS s1, -price_usd AS s2,
    2e0 * prop_starrating + coalesce(prop_review_score, 0e0) AS s3, CAST(-position AS DOUBLE) AS s4,
    CASE WHEN visitor_location_country_id = prop_country_id THEN 1 ELSE 0 END AS is_domestic,
    CASE WHEN srch_children_count > 0 THEN 1 ELSE 0 END AS is_family,
    5 * booking_bool + greatest(click_bool - booking_bool, 0) AS rel,
    greatest(click_bool - booking_bool, 0) AS click_only,
    {BUCKET_SQL} AS booking_window_bucket,
    CAST({hash_sql('fold42', 'srch_id')} % 5 AS INTEGER) AS fold,
    CAST({hash_sql('fold42', 'srch_id')} % 10 AS INTEGER) AS fold10
  FROM log)
"""


PREFIX = _prefix()


def query(name: str, sql: str | None = None, exact: str = "", d6: str = "", d4: str = ""):
    """Register ``fn(ctx)``.

    ``exact``, ``d6`` and ``d4`` list the output columns: as they are, or snapped
    to 6 or 4 digits. The same list shapes both engines' results. ``sql`` may use
    the CTEs ``log`` and ``scored`` and may open with further CTEs (``, x AS (..)
    SELECT ..``).
    """
    plain, six, four = exact.split(), d6.split(), d4.split()

    def shape(df: DataFrame) -> DataFrame:
        if not (plain or six or four):
            return df
        return df.select(
            *plain, *[snap(c, 6).alias(c) for c in six], *[snap(c, 4).alias(c) for c in four]
        )

    def full_sql() -> str | None:
        if sql is None:
            return None
        body = sql.strip()
        if not body.startswith(","):
            ctes, final = "", body
        else:
            ctes, final = body.rsplit("\nSELECT", 1)[0], "SELECT" + body.rsplit("\nSELECT", 1)[1]
        quoted = lambda c: f'"{c}"'
        cols = [quoted(c) for c in plain]
        cols += [f"{snap_sql(quoted(c), d)} AS {quoted(c)}" for d, names in ((6, six), (4, four)) for c in names]
        return f"{PREFIX}{ctes}\nSELECT {', '.join(cols) or '*'} FROM ({final}) q"

    def register(fn: Callable[[Context], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(lambda spark, sf_dir: shape(fn(Context(spark, sf_dir))), full_sql())
        return fn

    return register


__all__ = ["Context", "REGISTRY", "SCORES", "hash_sql", "query", "window_bucket"]
