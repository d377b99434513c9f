"""Spark-first analytics for similarity graphs over sequence intervals."""
