"""The registry can be read before any session exists, and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_registry_without_session():
    assert "DD07_cross_source_dedup" in names(ROOT)


def test_registry_without_optional_parts(tmp_path):
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "caseloom", tmp_path / "caseloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    found = names(tmp_path)
    assert "DD07_cross_source_dedup" in found and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "caseloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "caseloom").parts:
            assert "llm" not in path.read_text(), path
