"""postlake: a Spark-first analytics engine for short social text."""
