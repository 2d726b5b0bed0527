"""The entry without the optional subpackage: everything else still imports and runs."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {copy!r})
import __spark_entry__ as entry
names = set(entry.queries())
assert entry.__file__.startswith({copy!r})
assert not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in names) and "pipeline" not in names, names
assert set(entry.oracle_sql()) <= names and len(names) > 60
from bench import local_session
spark = local_session("2")
assert entry.queries()["fit_categories"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_entry_runs_without_the_optional_folders(tmp_path):
    copy = str(tmp_path / "copy")
    skipped = {"llm", ".git", "__pycache__", ".pytest_cache"}
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in skipped])
    assert os.path.exists(f"{copy}/sluicegate/session.py") and not os.path.exists(f"{copy}/sluicegate/llm")
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(copy=copy)], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
