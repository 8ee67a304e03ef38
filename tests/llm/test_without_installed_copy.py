"""The registered queries in a session whose workers cannot import this package."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, "{root}")
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.checkpoint.dir", "{tmp}/scratch").getOrCreate()
)

def imports(batches):
    for batch in batches:
        try:
            import faultline
            raise AssertionError("the workers see the package")
        except ModuleNotFoundError:
            yield batch

spark.range(4).mapInArrow(imports, "id long").collect()
import __spark_entry__ as entry
for name in {names}:
    rows = entry.queries()[name](spark, "{data}").collect()
    print(name, len(rows))
    assert rows
"""


def test_models_travel_with_their_code(tmp_path):
    names = ["op3_quality_rules", "op5_personal_data", "op8_language_id", "op10_quality_classifier", "op7_token_files", "op13_filter_audit", "pipeline"]
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT, tmp=tmp_path, names=names, data="/root/testdata/sf0.001"))
    environment = {"PATH": "/usr/local/bin:/usr/bin:/bin", "HOME": str(tmp_path)}
    import os

    kept = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PWD")} | environment | {"PATH": os.environ["PATH"]}
    said = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=600, cwd=tmp_path, env=kept)
    assert said.returncode == 0, said.stderr[-3000:]
