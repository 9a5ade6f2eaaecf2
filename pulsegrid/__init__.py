"""Label-series analytics on Spark: a metric query language compiled to DataFrame plans."""
