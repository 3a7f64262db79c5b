"""The engine stands without the text operators, and without the libraries that only these need."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LOOK = """
import sys
for name in {missing!r}:
    sys.modules[name] = None
import __spark_entry__ as e
names = e.queries()
assert "best_hits" in names and set(e.oracle_sql()) <= set(names), names
assert not [n for n in names if n.startswith("op") and n[2:3].isdigit() or n == "pipeline"], names
"""


def without_text_operators(to: Path) -> Path:
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "llm", "corpus_pipeline.py"))
    return to


def looked(folder: Path, missing: list[str]) -> str:
    run = subprocess.run([sys.executable, "-c", LOOK.format(missing=missing)], cwd=folder, capture_output=True, text=True, timeout=120)
    return run.stderr if run.returncode else ""


def test_without_the_folders(tmp_path):
    assert not looked(without_text_operators(tmp_path / "repo"), [])


def test_pytest_without_the_folders(tmp_path):
    folder = without_text_operators(tmp_path / "repo")
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_queries.py", "tests/test_trees.py", "-k", "test_entry or tree or histogram or merged"], cwd=folder, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stdout + run.stderr


@pytest.mark.parametrize("name", ["tiktoken", "xxhash", "corpus_pipeline"])
def test_without_a_library(name):
    if not (ROOT / "corpus_pipeline.py").exists():
        pytest.skip("the text operators are not there")
    assert not looked(ROOT, [name])
