"""The trajectory engine stands without the text operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_text_operators():
    for path in (ROOT / "trackloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "trackloom").parts:
            assert "llm" not in path.read_text(), path


def test_entry_without_the_text_operators():
    code = "import sys; sys.modules['trackloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'analyze' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_needs_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=ROOT, check=True, timeout=120)
