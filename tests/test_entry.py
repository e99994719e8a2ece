"""The entry module works with and without the corpus operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WITHOUT = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['riskframe', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
known = e.queries()
assert len(known) > 100 and 'pipeline' not in known and not any(n.startswith('op1') for n in known)
assert set(e.oracle_sql()) <= set(known)
"""

BROKEN = """
import sys, types
sys.modules['riskframe.llm.simhash'] = None  # an operator that can't be imported is an error, not an absence
try:
    import __spark_entry__
except ImportError:
    sys.exit(0)
import importlib.util
sys.exit(0 if importlib.util.find_spec('corpus_pipeline') is None else 1)
"""


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)


def test_entry_without_corpus_operators():
    done = run(WITHOUT)
    assert done.returncode == 0, done.stderr


def test_broken_operators_are_not_hidden():
    done = run(BROKEN)
    assert done.returncode == 0, done.stdout + done.stderr
