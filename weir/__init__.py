"""weir: a Spark-first analytics engine for detection, motion and recording timelines."""
