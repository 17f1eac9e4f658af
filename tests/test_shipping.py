"""Task-side Python must find the package even when the driver runs outside the repo (as a
cluster driver would): the scorer ships it with addPyFile."""
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import numpy as np
from riskloom.session import get_spark
from riskloom.plans.models import Dims, parity_params
from riskloom.plans.score import score_batch
spark = get_spark("local[2]", 2)
d = Dims(feature_dim=6, field_size=2, emb_dim=2, deep_layers=(3,))
df = spark.createDataFrame([(1, [0, 3], [1.0, 0.5]), (2, [1, 4], [0.2, 1.0])],
                           "k long, xi array<int>, xv array<float>")
rows = score_batch(df, "deepfm", parity_params("deepfm", d), d, "k").collect()
assert len(rows) == 2 and all(0.0 < r["score"] < 1.0 for r in rows)
print("SHIPPED_OK")
"""


def test_scoring_from_outside_the_repo():
    cwd = tempfile.mkdtemp(prefix="riskloom-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "SHIPPED_OK" in out.stdout, out.stderr[-2000:]


def test_threads_that_train_side_by_side_ship_once():
    """Spark refuses a second file of the same name, so only one of the threads may add it."""
    import threading
    import time
    from types import SimpleNamespace

    from riskloom.session import ship_package
    added, errors, start = [], [], threading.Barrier(4)

    def add(path):
        time.sleep(0.2)  # a busy driver
        if added:
            raise ValueError(f"File {os.path.basename(path)} was already registered")
        added.append(path)

    spark = SimpleNamespace(sparkContext=SimpleNamespace(applicationId=f"app-{time.time()}", addPyFile=add))

    def train():
        start.wait()
        try:
            ship_package(spark)
            assert added  # nobody goes on before the package is there
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=train) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(added) == 1
