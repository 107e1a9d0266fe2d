import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import os
from milepost.session import *
spark = local_session("root", "1", "1g", partitions=1)
path = fresh_path(spark, "a")
assert path.startswith(session_root(spark))
spark.range(3).write.parquet(path)
assert os.path.isdir(session_root(spark))
remove_session_root(spark)
assert not os.path.exists(session_root(spark))
spark.range(3).write.parquet(fresh_path(spark, "b"))
print("FOLDER", session_root(spark))
"""


def test_the_root_of_a_session_goes_with_it():
    run = subprocess.run([sys.executable, "-c", PROGRAM], cwd=ROOT, capture_output=True, text=True,
                         timeout=180)
    folder = run.stdout.rpartition("FOLDER")[2].strip()
    assert folder and not os.path.exists(folder), run.stderr[-2000:]
