import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


def names(folder):
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(e.queries())[-1])"], cwd=folder, capture_output=True, text=True)
    return run.returncode, run.stdout.split(), run.stderr


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(REPO / "grainmill", tmp_path / "grainmill", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_entry_without_the_optional_part(copy):
    from grainmill.plans import registry

    shutil.rmtree(copy / "grainmill" / "llm", ignore_errors=True)
    assert names(copy)[:2] == (0, [str(len(registry.queries())), str(len(registry.oracle_sql())), sorted(registry.queries())[-1]])


def test_a_broken_optional_part_is_an_error(copy):
    folder = copy / "grainmill" / "llm"
    shutil.rmtree(folder, ignore_errors=True)
    folder.mkdir()
    (folder / "__init__.py").write_text("")
    (folder / "common.py").write_text("")
    (folder / "queries.py").write_text("import a_module_that_is_not_there")
    code, _, said = names(copy)
    assert code and "a_module_that_is_not_there" in said
