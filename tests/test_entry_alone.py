"""The library without the training-data folders."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listed(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return [set(line.split()) for line in run.stdout.splitlines()]


def test_import_without_training_data(tmp_path):
    """Without ``llm``, and without the pipeline file too, the entry still lists all other queries."""
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.txt")
    shutil.copytree(REPO, tmp_path / "copy", ignore=skip)
    queries, oracles = listed(tmp_path / "copy")
    assert "result_summary" in queries and oracles <= queries
    assert not any(q.startswith("op") and q[2].isdigit() for q in queries) and "pipeline" not in queries
    shutil.copytree(REPO, tmp_path / "second", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    assert listed(tmp_path / "second") == [queries, oracles]
