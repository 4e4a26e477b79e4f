"""tickloom: market-series analytics as Spark DataFrame transformations."""
