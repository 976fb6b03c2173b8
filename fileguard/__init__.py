"""File-activity threat analytics on Spark: every operator is ``DataFrame (+ parameters) -> DataFrame`` and lazy."""
