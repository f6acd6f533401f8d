"""The driver's entry can be imported before there is a session."""

import subprocess
import sys
from pathlib import Path


def test_import_without_a_session():
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
