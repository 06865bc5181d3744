"""pricewise: market price analytics on Spark.

Daily commodity prices per market are loaded, validated and upserted, filtered,
searched and summarised; per-series lag/rolling/calendar features feed Spark ML
regressors; every market is forecast in one job, trends are classified and turned
into advice per audience, and forecasts are scored against observed prices.

Everything is a ``DataFrame -> DataFrame`` (or ``-> Column``) function built from
DataFrame, Spark SQL and Spark ML operations.
"""

__version__ = "0.1.0"
