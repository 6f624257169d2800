"""Match analytics on Spark: point-in-time features, ratings, count models, scoring."""
