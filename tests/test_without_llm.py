"""The rest works without the training-data operators and the pipeline, with either or both gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LOOK = """
import __spark_entry__ as e
names = e.queries()
assert "collective_by_team" in names and not [n for n in names if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in names
assert set(e.oracle_sql()) <= set(names)
import bench
"""


@pytest.mark.parametrize("gone", [("pitchlake/llm", "tests/llm"), ("pitchlake/llm", "tests/llm", "corpus_pipeline.py")])
def test_deleted(tmp_path, gone):
    for name in ("pitchlake", "tests", "__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
