"""Clinical time-series analytics on Spark: hourly panels, temporal features, scores, labels, protocols, evaluation."""
