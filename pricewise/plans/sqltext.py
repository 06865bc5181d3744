"""Helpers for writing DuckDB oracle text that matches Spark's semantics."""


def sround(expr: str, d: int) -> str:
    """Spark's ``round`` on a double: half-up on the shortest decimal text of the value."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,20)), {d}) AS DOUBLE)"


def trend_case(change: str) -> str:
    return (f"CASE WHEN {change} > 5 THEN 'Increasing Rapidly' WHEN {change} > 2 THEN 'Increasing' "
            f"WHEN {change} < -5 THEN 'Decreasing Rapidly' WHEN {change} < -2 THEN 'Decreasing' ELSE 'Stable' END")


AS_OF_PRICES = "(SELECT max(date) FROM prices)"
AS_OF_PREDICTIONS = "(SELECT max(forecast_date) FROM predictions)"


def mean(expr: str, over: str = "") -> str:
    """Exact mean (mirrors series.price_sum and series.exact_mean): four whole sums, one fixed chain of operations."""
    up, down, x = "2147483648::DOUBLE", "67108864::DOUBLE", f"({expr})"
    rest = f"(({x} - floor({x})) * {down})"
    parts = (f"floor({x} / {up})", f"floor({x}) - floor({x} / {up}) * {up}", f"floor({rest})", f"floor(({rest} - floor({rest})) * {down})")
    top, whole, part, fine = (f"CAST(CAST(sum(CAST({p} AS BIGINT)) {over} AS BIGINT) AS DOUBLE)" for p in parts)
    return f"(CASE WHEN count({x}) {over} > 0 THEN (({top} * {up} + {whole}) + ({part} + {fine} / {down}) / {down}) / count({x}) {over} END)"


def window_mean(col: str, frame: str) -> str:
    """Exact mean of ``col`` over a window ``frame`` text such as 'w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW'."""
    return mean(col, f"OVER ({frame})")
