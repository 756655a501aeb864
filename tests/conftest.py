"""Shared session and a small synthetic search log drawn from hashes."""

import hashlib
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankloom.session import build_session  # noqa: E402
from rankloom.sources.schema import LOG_COLUMNS, log_schema  # noqa: E402

N_SEARCHES = 60


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def draw(*parts) -> float:
    digest = hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    return int(digest[:8], 16) / 2 ** 32


def pick(options, *parts):
    return options[int(draw(*parts) * len(options))]


def synthetic_log() -> pd.DataFrame:
    rows = []
    for s in range(N_SEARCHES):
        dest = s % 6
        hotels = sorted(range(8), key=lambda h: draw("order", s, h))[: 6 + int(draw("size", s) * 3)]
        booked = pick(hotels, "which", s) if draw("booked", s) < 0.6 else None
        for place, h in enumerate(hotels, start=1):
            prop = 100 + dest * 8 + h
            book = int(h == booked)
            click = int(book or draw("click", s, h) < 0.15)
            row = {
                "srch_id": 5000 + s, "prop_id": prop, "srch_destination_id": 1000 + dest,
                "date_time": pd.Timestamp("2013-01-01") + pd.Timedelta(hours=13 * s),
                "site_id": 1 + s % 3, "visitor_location_country_id": pick([10, 20, 30], "vc", s),
                "prop_country_id": [10, 20, 30][dest % 3], "position": place,
                "prop_starrating": pick([0, 2, 3, 4, 5], "star", prop),
                "prop_brand_bool": pick([0, 1], "brand", prop), "promotion_flag": pick([0, 1], "promo", s, h),
                "srch_length_of_stay": pick([1, 2, 3, 5], "stay", s),
                "srch_booking_window": pick([0, 1, 5, 20, 60, 200], "window", s),
                "srch_adults_count": pick([1, 2], "adults", s), "srch_children_count": pick([0, 1, 2], "kids", s),
                "srch_room_count": 1, "srch_saturday_night_bool": pick([0, 1], "sat", s),
                "random_bool": int((s // 6) % 2 == 0), "click_bool": click, "booking_bool": book,
                "price_usd": round(40 + 300 * draw("price", s, h), 2),
                "prop_location_score1": pick([1.1, 2.3, 3.5, 4.7], "loc1", prop),
                "prop_location_score2": pick([None, 0.05, 0.2, 0.4], "loc2", prop, s % 4),
                "prop_log_historical_price": 4 + draw("hist", prop),
                "prop_review_score": pick([None, 3.0, 4.0, 4.5], "review", prop),
                "visitor_hist_starrating": pick([None, 3.0, 4.0], "vhs", s),
                "visitor_hist_adr_usd": pick([None, 90.0, 150.0], "vha", s),
                "srch_query_affinity_score": pick([None, -20.0, -30.0], "aff", s, h),
                "orig_destination_distance": pick([None, 120.0, 900.0], "dist", s),
                "gross_bookings_usd": 100.0 if book else None,
            }
            for i in range(1, 9):
                row[f"comp{i}_rate"] = pick([None, -1.0, 0.0, 1.0], "rate", i, s, h)
                row[f"comp{i}_inv"] = pick([None, 0.0, 1.0], "inv", i, s, h)
                row[f"comp{i}_rate_percent_diff"] = pick([None, 5.0, 12.0], "diff", i, s, h)
            rows.append(row)
    return pd.DataFrame(rows)[LOG_COLUMNS]


def to_spark(spark, pdf: pd.DataFrame):
    clean = pdf.astype(object).where(pdf.notna(), None)
    schema = log_schema()
    rows = []
    for record in clean.to_dict("records"):
        row = []
        for field in schema.fields:
            value = record[field.name]
            if value is not None:
                kind = field.dataType.simpleString()
                value = float(value) if kind == "double" else value.to_pydatetime() if "timestamp" in kind else int(value)
            row.append(value)
        rows.append(tuple(row))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def log_pdf():
    return synthetic_log()


@pytest.fixture(scope="session")
def log(spark, log_pdf):
    return to_spark(spark, log_pdf).checkpoint() if spark.sparkContext.getCheckpointDir() else to_spark(spark, log_pdf).cache()


def flip_labels(pdf: pd.DataFrame, mask) -> pd.DataFrame:
    """Swap click labels on the masked rows; a booking stays a click."""
    out = pdf.copy()
    out.loc[mask, "click_bool"] = 1 - out.loc[mask, "click_bool"]
    out.loc[mask, "booking_bool"] = out.loc[mask, "click_bool"]
    return out


def rows_of(df, *order):
    return df.toPandas().sort_values(list(order or ("srch_id", "prop_id"))).reset_index(drop=True)


class SmallGroups:
    """Context in which every group above ``limit`` rows takes the oversized route."""

    def __init__(self, spark, limit):
        self.spark, self.limit = spark, limit

    def __enter__(self):
        self.spark.conf.set("spark.rankloom.maxGroupRows", str(self.limit))

    def __exit__(self, *exc):
        self.spark.conf.unset("spark.rankloom.maxGroupRows")
