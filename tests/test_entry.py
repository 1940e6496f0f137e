"""The entry point without its optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("absent", ["tallyweave.llm", "zstandard", "corpus_pipeline"])
def test_other_queries_are_there_without(absent):
    code = f"""
import sys, warnings
warnings.simplefilter("ignore")
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == {absent!r} or name.startswith({absent!r} + "."):
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = e.queries()
assert len(names) > 200 and set(e.oracle_sql()) < set(names)
assert "pipeline" not in names
assert any(n.startswith("op1_") for n in names) == {absent == "corpus_pipeline" and (Path(ROOT) / "tallyweave" / "llm").exists()}
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
