import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as E

TOP = Path(E.__file__).resolve().parent


def names(folder, path: str | None = None) -> list[str]:
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": path} if path else {})
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("path", [None, str(TOP)])
@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_queries_without_the_corpus_operators(tmp_path, gone, path):
    shutil.copytree(TOP, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__", ".pytest_cache"))
    assert not (tmp_path / "repo/strandloom/llm").exists() and not (tmp_path / "repo/tests/llm").exists()
    got = names(tmp_path / "repo", path)
    assert "seed_hits" in got and not any(n.startswith("op") or n == "pipeline" for n in got)


def test_errors_inside_an_optional_module_are_not_hidden(tmp_path, monkeypatch):
    (tmp_path / "broken_part.py").write_text("import a_module_that_nobody_has\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError, match="nobody_has"):
        E._optional("broken_part")
    assert E._optional("no_such_module") is None and E._optional("no_such.module") is None
