"""The Python UDF work must not need the package on the executors' import path: run a
p-value query from a process started outside the repository."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from strata.session import local_session
import __spark_entry__ as E
spark = local_session(cores=2, shuffle_partitions=2, driver_memory="2g")
row = E.queries()["chi_square_family_test"](spark, "/root/testdata/sf0.001").collect()[0]
assert 0.0 <= row["p_value"] <= 1.0, row
print("P_OK", row["p_value"])
spark.stop()
"""


def test_pvalue_udf_runs_without_package_on_workers():
    cwd = tempfile.mkdtemp(prefix="strata-test-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "P_OK" in out.stdout, out.stderr[-3000:]
