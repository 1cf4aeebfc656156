import subprocess
import sys

import __spark_entry__ as entry

from sessiondeck import registry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_queries_have_names_of_their_own():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_without_the_llm_folder():
    code = "import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith(('sessiondeck.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert e.queries() and not [q for q in e.queries() if q.startswith('op')]\n"
    subprocess.run([sys.executable, "-c", code], check=True)
