"""The rest works when the training-data subpackage is gone, with the pipeline's file or without it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q = e.queries(); assert 'mr_word_count' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    copy = tmp_path / "copy"
    gone = ["__pycache__", ".git", "llm"] + ["corpus_pipeline.py"] * (not pipeline)
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*gone))
    assert not (copy / "lodestream/llm").exists() and not (copy / "tests/llm").exists()
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True, env=env, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_queries.py::test_names", "--collect-only"], cwd=copy, check=True, env=env, timeout=120, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_queries.py::test_names"], cwd=copy, check=True, env=env, timeout=120, stdout=subprocess.DEVNULL)


def test_an_empty_folder_is_no_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("__pycache__", ".git", "llm"))
    (copy / "lodestream/llm/__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "lodestream").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lodestream.llm" not in p.read_text()
