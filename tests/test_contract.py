"""The driver's contract, and that the core stands without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract

REPO = Path(contract.__file__).resolve().parent


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "finding_id" and df.count() > 0


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_core_imports_alone(tmp_path):
    shutil.copytree(REPO / "proofline", tmp_path / "proofline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr[-800:]
