"""The driver contract, with and without the corpus operators."""

import subprocess
import sys

from .conftest import ROOT

HIDE = """
import importlib.abc, sys
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('vicinity.llm'):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
names = e.queries()
assert 'knn_l2' in names and 'pipeline' not in names and not any(n.startswith('op') and n[2].isdigit() for n in names)
assert set(e.oracle_sql()) <= set(names)
"""


def test_without_corpus_operators():
    subprocess.run([sys.executable, "-c", HIDE], cwd=ROOT, check=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
