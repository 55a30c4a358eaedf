"""The registry can be read before any session exists, and names one query for each operator."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_import_without_session():
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    names = done.stdout.split("NAMES")[1].split("SQL")[0].split()
    assert {f"op{n}" for n in range(1, 11)} <= {m[0] for m in map(re.compile(r"op\d+").match, names) if m} and "pipeline" in names
