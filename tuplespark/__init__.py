"""tuplespark: relation-tuple extraction and scoring as Spark DataFrame jobs.

Every public operator takes and returns DataFrames (or Columns) and is built
from Catalyst built-ins; Python only enters through the plug-in hooks in
``operators.generate`` (the text generator) and the optional tokenizer,
lemmatizer and sentence-splitter plug-ins.
"""

from tuplespark.session import get_spark, scratch_path  # noqa: F401

__all__ = ["get_spark", "scratch_path"]
