"""The entry module lists its queries without a session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_are_listed_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
                                                 "print(len(q), sorted(set(s) - set(q)))"],
                          cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.strip().endswith(" []"), said.stderr[-500:]
