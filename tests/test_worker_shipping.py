"""Python-side operators work when the driver is started outside the repo."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from tuplespark.operators.generate import first_words_generator, generate
prefix = "Extract a list of open relation triples from the following sentence: "
df = spark.createDataFrame([(prefix + "a b c d",), (prefix + "x y",)], "prompt string")
out = sorted((r.output or "") for r in generate(df, "prompt", first_words_generator).collect())
print("RESULT", out)
spark.stop()
"""


def test_generator_runs_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="tuplespark-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert "RESULT ['', 'a ,, b ,, c d']" in res.stdout, res.stderr[-2000:]
