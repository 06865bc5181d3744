"""Predicates (section 2.3): every function returns a boolean ``Column``.

Literal text is matched literally: ``contains`` is used instead of ``like``/``ilike`` so
that ``%`` and ``_`` in user input are not wildcards.  Parameters that mean "no filter"
(None, '', 'All Markets') return ``lit(True)``; Catalyst folds it away.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

NO_FILTER = (None, "", "All Markets")


def _true() -> Column:
    return F.lit(True)


def contains(c, text) -> Column:
    """Case-insensitive substring match."""
    if text in NO_FILTER:
        return _true()
    return F.lower(col(c)).contains(str(text).lower())


def iexact(c, text) -> Column:
    if text in NO_FILTER:
        return _true()
    return F.lower(col(c)) == str(text).lower()


def exact(c, value) -> Column:
    if value in NO_FILTER:
        return _true()
    return col(c) == F.lit(value)


def match(c, text, how: str = "contains") -> Column:
    """One switch for the three market-matching styles."""
    return {"contains": contains, "iexact": iexact, "exact": exact}[how](c, text)


def parse_date(text):
    """Driver-side parse of a filter argument; unparseable text means no bound."""
    if text in (None, ""):
        return None
    if isinstance(text, dt.date):
        return text
    try:
        return dt.date.fromisoformat(str(text).strip()[:10])
    except ValueError:
        return None


def date_range(c, start=None, end=None) -> Column:
    """Inclusive on both ends, each optional; bad text is ignored."""
    s, e = parse_date(start), parse_date(end)
    p = _true()
    if s is not None:
        p = p & (col(c) >= F.lit(s))
    if e is not None:
        p = p & (col(c) <= F.lit(e))
    return p


RELATIVE_DAYS = {"week": 7, "month": 30, "quarter": 90}


def relative_range(c, name: str, as_of) -> Column:
    """week / month / quarter = on or after as_of minus 7 / 30 / 90 days; anything else: all."""
    n = RELATIVE_DAYS.get(name)
    if n is None:
        return _true()
    a = F.lit(as_of) if isinstance(as_of, (dt.date, str)) else as_of
    return col(c) >= F.date_sub(a, n)


def confidence(c, name: str, high: float = 80, mid: float = 60) -> Column:
    v = col(c)
    if name == "high":
        return v >= high
    if name == "medium":
        return (v >= mid) & (v < high)
    if name == "low":
        return v < mid
    return _true()


def status(c, name: str) -> Column:
    """verified = value present; pending = missing."""
    if name == "verified":
        return col(c).isNotNull()
    if name == "pending":
        return col(c).isNull()
    return _true()


def flags(name: str) -> Column:
    """active / inactive / staff / superuser over the users' boolean columns."""
    return {
        "active": F.col("is_active"),
        "inactive": ~F.col("is_active"),
        "staff": F.col("is_staff"),
        "superuser": F.col("is_superuser"),
    }.get(name, _true())


def search_any(cols, text) -> Column:
    """OR of case-insensitive contains over several columns (null columns do not match)."""
    if text in NO_FILTER:
        return _true()
    return reduce(lambda a, b: a | b, [F.coalesce(contains(c, text), F.lit(False)) for c in cols])


def search_terms(cols, text) -> Column:
    """Every whitespace-separated term must hit some column."""
    terms = [t for t in str(text or "").split() if t]
    if not terms:
        return _true()
    return reduce(lambda a, b: a & b, [search_any(cols, t) for t in terms])


def facets(selected: dict) -> Column:
    """Equality per facet column; date-typed values compare as dates."""
    p = _true()
    for c, v in selected.items():
        if v in NO_FILTER:
            continue
        p = p & (F.col(c) == F.lit(v))
    return p
