"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 190"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_imports_without_the_subpackage():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tidemark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "flagship_trade_metrics" in e.queries() and not any(k.startswith("op1") for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
