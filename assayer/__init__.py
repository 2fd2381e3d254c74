"""assayer: a Spark-first engine for scoring model predictions and preparing training text."""
