"""The entry file without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("framelex.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "candidates" in e.queries() and "candidates" in e.oracle_sql()
assert not any(q.startswith("op") or q == "pipeline" for q in e.queries() if q not in ("os_prepare", "os_lookup_misses"))
"""


def test_entry_imports_without_the_optional_operators():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)
