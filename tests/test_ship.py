"""Tasks find the package when the job starts from another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
from casebook.plans import q_models, q_text
from casebook.ml import scoring
from casebook.session import get_spark
from casebook.sources.tables import case_view
spark = get_spark("local[2]", shuffle_partitions=2)
sf = "/root/testdata/sf0.001"
assert q_text.language_detect(spark, sf).count() > 0
assert scoring.los_scores(q_models.LOS_FOREST, case_view(spark, sf), ["Patient_ID"]).count() > 0
print("DONE")
"""


def test_tasks_import_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("DONE"), out.stderr[-2000:]
