import os
import subprocess
import sys

from bytelane import session
from bytelane.streaming import runner as RN

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scratch_is_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", [])
    df = session.written(spark.range(5), "x")
    RN.scratch(spark, "never-written")
    assert df.count() == 5 and len(session._SCRATCH) == 2
    folder = session._SCRATCH[0].removeprefix("file:")
    assert os.path.isdir(folder)
    assert session.remove_scratch(spark) == 1
    assert not os.path.exists(folder) and session._SCRATCH == []


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from bytelane.session import local_session
spark = local_session(2, 2)
q = e.queries()["patches"]
print("ROWS", q(spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"BYTELANE_DRIVER_MEMORY": "2g"}, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
