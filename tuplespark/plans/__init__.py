"""End-to-end plans (evaluate, predict, annotate, training data) and the
registry of named queries used by ``__spark_entry__``."""
