"""The rest works where the llm folders and the pipeline are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "siltflow", tmp_path / "siltflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'route_build_latest' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for path in (ROOT / "siltflow").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_entry_imports_without_what_llm_needs(tmp_path):
    """Where a package that only the optional operators need is missing, the engine's queries stay."""
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'route_build_latest' in q and not any(n.startswith('op1') for n in q) and len(e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
