"""The library works without the training-data operators, their tests gone or not, and with corpus_pipeline.py still there."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["codeatlas/llm"], ["codeatlas/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_imports(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *map(os.path.basename, gone)))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    count, pipeline, numbered, oracles = run.stdout.split()
    assert int(count) > 200 and pipeline == "False" and numbered == str("codeatlas/llm" not in gone) and oracles == "True", run.stderr
