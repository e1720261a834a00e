"""The entry module works with and without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import importlib.util as u
find = u.find_spec
u.find_spec = lambda name, *a: None if name.startswith(("tallymark.llm", "corpus_pipeline")) else find(name, *a)
import __spark_entry__ as entry
names = entry.queries()
assert "flagship_poisson_holdout" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert set(entry.oracle_sql()) <= set(names)
"""


def test_entry_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "tallymark")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "tallymark.llm" not in f.read(), name
