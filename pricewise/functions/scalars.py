"""Scalar column functions (section 2.10 of the survey): labels, bands, formats, safe arithmetic.

Every function returns a ``Column`` built from built-in expressions, so it stays inside
whole-stage codegen.  Thresholds that the app hard-codes are parameters here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# Trend classes and their change thresholds (percent).
TREND_RISING_FAST = "Increasing Rapidly"
TREND_RISING = "Increasing"
TREND_FALLING_FAST = "Decreasing Rapidly"
TREND_FALLING = "Decreasing"
TREND_STABLE = "Stable"
# Display labels of the app's template filters.
ACCURACY_GRADES = ("Excellent", "Good", "Fair", "Poor", "Pending")      # > 90, > 80, > 70, else, missing
BADGE_CLASSES = ("bg-success", "bg-warning", "bg-danger", "bg-secondary")   # > 80, > 70, else, missing
CONFIDENCE_CLASSES = ("confidence-high", "confidence-medium", "confidence-low")   # >= 80, >= 60, else
PRICE_CLASSES = ("price-high", "price-medium", "price-low")             # > 50, > 30, else (per kg)
TREND_LABELS = ("Rising", "Falling", "Stable")


def date_parts(c) -> dict[str, Column]:
    """year, month, day, weekday (Monday=0), day of year, ISO week, quarter."""
    d = col(c)
    return {
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d), "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d), "quarter": F.quarter(d),
    }


def season(month) -> Column:
    """Month -> 0 summer (Mar-May), 1 kharif (Jun-Sep), 2 late kharif (Oct-Nov), 3 winter."""
    m = col(month)
    return (F.when(m.between(3, 5), 0).when(m.between(6, 9), 1)
            .when(m.between(10, 11), 2).otherwise(3))


def format_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(col(c), fmt)


def accuracy_pct(predicted, actual) -> Column:
    """(1 - |p - a| / a) * 100, two decimals; 0 when a is 0/null or either side unparseable."""
    p = col(predicted).try_cast("double") if not isinstance(predicted, (int, float)) else F.lit(float(predicted))
    a = col(actual).try_cast("double") if not isinstance(actual, (int, float)) else F.lit(float(actual))
    acc = (F.lit(1.0) - F.try_divide(F.abs(p - a), a)) * 100
    return F.coalesce(F.round(acc, 2), F.lit(0.0))


def accuracy_value(predicted, actual) -> Column:
    """100 - |p - a| / a * 100 when both are present and non-zero, else null."""
    p, a = col(predicted), col(actual)
    ok = p.isNotNull() & a.isNotNull() & (p != 0) & (a != 0)
    return F.when(ok, F.lit(100.0) - F.abs(p - a) / a * 100)


def accuracy_text(predicted, actual) -> Column:
    """Accuracy with one decimal and a percent sign; '' when missing."""
    v = accuracy_value(predicted, actual)
    # format_string renders null as "null", so guard it
    return F.when(v.isNotNull(), F.format_string("%.1f%%", v)).otherwise(F.lit(""))


def price_difference(predicted, actual) -> Column:
    return F.abs(col(predicted) - col(actual))


def accuracy_grade(accuracy) -> Column:
    """>90 Excellent, >80 Good, >70 Fair, else Poor; null -> Pending."""
    a = col(accuracy)
    g = ACCURACY_GRADES
    return (F.when(a.isNull(), g[4]).when(a > 90, g[0]).when(a > 80, g[1])
            .when(a > 70, g[2]).otherwise(g[3]))


def accuracy_band(accuracy, high: float = 80, mid: float = 70,
                  labels=BADGE_CLASSES[:3], missing: str = BADGE_CLASSES[3]) -> Column:
    """Badge class: > high success, > mid warning, else danger; missing accuracy -> secondary."""
    a = col(accuracy)
    return (F.when(a.isNull(), missing).when(a > high, labels[0]).when(a > mid, labels[1])
            .otherwise(labels[2]))


def accuracy_color(accuracy, high: float = 90, mid: float = 75, labels=("green", "amber", "red")) -> Column:
    """The detail view's scale: the accuracy shown with one decimal, >= 90 / >= 75."""
    a = F.round(col(accuracy), 1)
    return F.when(a.isNull(), F.lit(None)).when(a >= high, labels[0]).when(a >= mid, labels[1]).otherwise(labels[2])


def confidence_band(confidence, high: float = 80, mid: float = 60,
                    labels=CONFIDENCE_CLASSES) -> Column:
    """>= high / >= mid / else; a missing or unparseable value gives ''."""
    c = col(confidence).cast("string").try_cast("double")
    return (F.when(c.isNull(), "").when(c >= high, labels[0]).when(c >= mid, labels[1])
            .otherwise(labels[2]))


def price_band(price, high: float = 50, mid: float = 30, labels=PRICE_CLASSES) -> Column:
    """> high / > mid / else (per-kg scale by default; the per-quintal page uses 3000 / 1500);
    a missing or unparseable value gives ''."""
    p = col(price).cast("string").try_cast("double")
    return F.when(p.isNull(), "").when(p > high, labels[0]).when(p > mid, labels[1]).otherwise(labels[2])


def impact_direction(impact) -> Column:
    return F.when(col(impact) > 0, "up").otherwise("down")


def _or_kept(number: Column, value: Column, keep_text: bool) -> Column:
    """The computed number, else the value itself.  A column has one type: with ``keep_text`` it is text, and text that
    is no number stays as it is; without, the value is numeric and stays a double."""
    return F.coalesce(number.cast("string"), value.cast("string")) if keep_text else F.coalesce(number, value.try_cast("double"))


def safe_subtract(value, arg, keep_text: bool = False) -> Column:
    """value - arg; an unparseable side leaves value unchanged (``keep_text`` for a column of text)."""
    v, a = col(value).cast("string").try_cast("double"), col(arg).cast("string").try_cast("double")
    return _or_kept(v - a, col(value), keep_text)


def safe_multiply(value, arg, keep_text: bool = False) -> Column:
    """value * arg; an unparseable side leaves value unchanged (``keep_text`` for a column of text)."""
    v, a = col(value).cast("string").try_cast("double"), col(arg).cast("string").try_cast("double")
    return _or_kept(v * a, col(value), keep_text)


def safe_divide(value, arg) -> Column:
    """value / arg; 0 on division by zero or bad input."""
    v, a = col(value).try_cast("double"), col(arg).try_cast("double")
    return F.coalesce(F.try_divide(v, a), F.lit(0.0))


def safe_abs(value, keep_text: bool = False) -> Column:
    """|value|; unparseable text is left unchanged (``keep_text`` for a column of text)."""
    return _or_kept(F.abs(col(value).cast("string").try_cast("double")), col(value), keep_text)


def format_price(value, symbol: str = "₹") -> Column:
    """Symbol + two decimals when numeric, the raw text otherwise."""
    v = col(value)
    num = v.cast("string").try_cast("double")
    return F.when(num.isNotNull(), F.concat(F.lit(symbol), F.format_string("%.2f", num))).otherwise(v.cast("string"))


def format_price_lakh(value) -> Column:
    """Indian digit grouping with up to three decimals, zeros at the end left out (12,34,567.89)."""
    v = F.round(col(value).cast("double"), 3)
    text = F.format_string("%.3f", F.abs(v))
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"(\d)(?=(\d\d)+\d$)", "$1,")
    part = F.regexp_replace(F.substring_index(text, ".", -1), "0+$", "")
    return F.when(v.isNotNull(), F.concat(F.when(v < 0, "-").otherwise(""), whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise("")))


def truncate_text(value, n: int) -> Column:
    """At most n characters; longer text ends with an ellipsis that counts toward n."""
    v = col(value)
    return F.when(F.length(v) > n, F.concat(F.substring(v, 1, n - 1), F.lit("…"))).otherwise(v)


def clip(value, lo, hi) -> Column:
    lo_c = F.lit(lo) if isinstance(lo, (int, float)) else col(lo)
    hi_c = F.lit(hi) if isinstance(hi, (int, float)) else col(hi)
    return F.greatest(F.least(col(value), hi_c), lo_c)


def json_to_map(text) -> Column:
    return F.from_json(col(text), "map<string,string>")


def map_to_json(m) -> Column:
    return F.to_json(col(m))


def trend_label(trend) -> Column:
    t = col(trend)
    return (F.when(t.contains("Increasing"), TREND_LABELS[0]).when(t.contains("Decreasing"), TREND_LABELS[1])
            .otherwise(TREND_LABELS[2]))


def trend_class(change_pct) -> Column:
    """Percent change -> trend class (>5, >2, <-5, <-2, else Stable)."""
    c = col(change_pct)
    return (F.when(c > 5, TREND_RISING_FAST).when(c > 2, TREND_RISING)
            .when(c < -5, TREND_FALLING_FAST).when(c < -2, TREND_FALLING).otherwise(TREND_STABLE))


def default_value(c, default) -> Column:
    """Python ``x or d``: null, empty text, zero and false all give the default."""
    v = col(c)
    d = F.lit(default)
    if isinstance(default, str):
        return F.coalesce(F.nullif(v.cast("string"), F.lit("")), d)
    return F.coalesce(F.nullif(v, F.lit(0)), d)
