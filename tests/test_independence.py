"""The core neither imports the training-data subpackage nor needs it."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_no_import_of_llm():
    for path in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names]
            assert not [n for n in names if n.startswith("lodestone.llm")], path


def test_entry_without_llm():
    code = "import sys; sys.modules['lodestone.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[0] == 'p' and n[1].isdigit()]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
