from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession

spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.checkpoint.dir", sys.argv[3]).getOrCreate())
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
sys.modules["__spark_entry__"] = entry
spec.loader.exec_module(entry)
for name in ("op2_toxicity", "op3_lm", "op10_pieces", "op11_topk", "op13_runs"):
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
print("pipeline", entry.queries()["pipeline"](spark, sys.argv[2]).count() > 0)
"""


def test_workers_need_no_copy_of_the_package(spark, odd, folder, tmp_path):
    """Driver code started from a foreign folder: its Python workers cannot import the package."""
    vectors = [(i, [0.1 * i, -0.2, 0.3]) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(ROOT), folder, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900
    )
    n = odd.count()
    lines = [line for line in run.stdout.splitlines() if line.startswith(("op", "pipeline"))]
    assert lines == [f"op2_toxicity {n}", f"op3_lm {n}", f"op10_pieces {n}", "op11_topk 10", f"op13_runs {n}", "pipeline True"], run.stderr[-3000:]
