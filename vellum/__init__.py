"""A Spark-first engine for corpora of structured manuscripts."""
