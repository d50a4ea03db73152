"""Column lists and types of the search log (one row per search x candidate property).

Fixed values: the names, storage types and meaningful-zero list below must equal
those of the original search-log format so that existing files and results line up.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names and storage types shared by train and test ---------
BASE_TYPES: dict[str, T.DataType] = {
    "srch_id": T.LongType(),
    "site_id": T.ByteType(),
    "visitor_location_country_id": T.IntegerType(),
    "prop_country_id": T.IntegerType(),
    "prop_id": T.LongType(),
    "prop_starrating": T.ByteType(),
    "srch_destination_id": T.IntegerType(),
    "srch_length_of_stay": T.ShortType(),
    "srch_booking_window": T.IntegerType(),
    "srch_adults_count": T.ByteType(),
    "srch_children_count": T.ByteType(),
    "srch_room_count": T.ByteType(),
    "visitor_hist_starrating": T.FloatType(),
    "visitor_hist_adr_usd": T.FloatType(),
    "prop_review_score": T.FloatType(),
    "prop_location_score1": T.FloatType(),
    "prop_location_score2": T.FloatType(),
    "prop_log_historical_price": T.FloatType(),
    "price_usd": T.FloatType(),
    "srch_query_affinity_score": T.FloatType(),
    "orig_destination_distance": T.FloatType(),
    "prop_brand_bool": T.ByteType(),
    "promotion_flag": T.ByteType(),
    "srch_saturday_night_bool": T.ByteType(),
    "random_bool": T.ByteType(),
}
# competitor blocks 1..8: rate (-1/0/1), inventory flag (0/1), percent difference
COMPETITORS = 8
for _i in range(1, COMPETITORS + 1):
    BASE_TYPES[f"comp{_i}_rate"] = T.ByteType()
    BASE_TYPES[f"comp{_i}_inv"] = T.ByteType()
    BASE_TYPES[f"comp{_i}_rate_percent_diff"] = T.FloatType()

# --- fixed values: columns present only in the training log ------------------------
TRAIN_ONLY_TYPES: dict[str, T.DataType] = {
    "position": T.IntegerType(),
    "click_bool": T.ByteType(),
    "booking_bool": T.ByteType(),
    "gross_bookings_usd": T.FloatType(),
}

# --- fixed values: the text column parsed as a timestamp ---------------------------
DATE_COLUMNS = ["date_time"]

# --- fixed values: columns whose zero carries a meaning (unknown / none / not sold) -
SIGNIFICANT_ZERO_COLUMNS = [
    "prop_starrating",
    "prop_review_score",
    "prop_log_historical_price",
    "random_bool",
    "prop_brand_bool",
    "promotion_flag",
    "click_bool",
    "booking_bool",
]

# --- fixed values: identifiers, target and leak columns kept out of model features -
GROUP_COL = "srch_id"
ITEM_COL = "prop_id"
TARGET_COL = "booking_bool"
LEAK_COLUMNS = ["click_bool", "position", "gross_bookings_usd"]
NON_FEATURE_COLUMNS = [GROUP_COL, ITEM_COL, *LEAK_COLUMNS, TARGET_COL]

# --- fixed values: property identifiers excluded from property aggregates ---------
PROPERTY_PREFIX = "prop"
PROPERTY_ID_COLUMNS = ["prop_id", "prop_country_id"]


def dtype_map(is_train: bool = True) -> dict[str, T.DataType]:
    types = dict(BASE_TYPES)
    if is_train:
        types.update(TRAIN_ONLY_TYPES)
    return types


def property_columns(columns: list[str]) -> list[str]:
    """Columns describing the property (prefix ``prop``), minus its identifiers."""
    return [c for c in columns if c.startswith(PROPERTY_PREFIX) and c not in PROPERTY_ID_COLUMNS]
