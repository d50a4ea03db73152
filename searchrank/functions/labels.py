"""Label expressions.

Fixed values: the relevance grades and the category texts below must equal the
original ones so that ratings and reports line up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: relevance grades -------------------------------------------------
BOOKED_GRADE = 5
CLICKED_GRADE = 1
NO_INTERACTION_GRADE = 0

# --- fixed values: click / booking categories (click, booking) -> text -------------
CLICK_BOOKING_CATEGORIES = [
    (0, 0, "No Click, No Booking"),
    (1, 0, "Click, No Booking"),
    (0, 1, "No Click, Booking (Error/Direct)"),
    (1, 1, "Click and Booking"),
]
UNKNOWN_CATEGORY = "Unknown"

# --- fixed values: sort-method labels by random_bool ------------------------------
RANDOM_SORT_LABEL = "Random Sort"
DEFAULT_SORT_LABEL = "Default Sort"


def graded_label(click: str = "click_bool", booking: str = "booking_bool") -> Column:
    """5 if booked, else 1 if clicked, else 0 (booking wins)."""
    return (F.when(F.col(booking) == 1, F.lit(BOOKED_GRADE))
            .when(F.col(click) == 1, F.lit(CLICKED_GRADE))
            .otherwise(F.lit(NO_INTERACTION_GRADE)))


def click_booking_category(click: str = "click_bool", booking: str = "booking_bool") -> Column:
    expr = None
    for c, b, text in CLICK_BOOKING_CATEGORIES:
        cond = (F.col(click) == c) & (F.col(booking) == b)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr.otherwise(F.lit(UNKNOWN_CATEGORY))


def sort_type_label(col: str = "random_bool") -> Column:
    return F.when(F.col(col) == 1, F.lit(RANDOM_SORT_LABEL)).otherwise(F.lit(DEFAULT_SORT_LABEL))
