"""The entry points with and without the text subpackage."""

import subprocess
import sys

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("pitchlake.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "standings" in e.queries() and not any(n.startswith("op") for n in e.queries() if n[2:3].isdigit())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_without_the_text_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], check=True)


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.catalog.QUERIES) > 50
