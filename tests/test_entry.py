"""The entry points with and without the parts that may be left out."""

import subprocess
import sys

import pytest

BLOCKED = """
import importlib.abc, sys

class Without(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if any(name == x or name.startswith(x + ".") for x in {blocked!r}):
            raise ModuleNotFoundError("No module named " + repr(name), name=name)

sys.meta_path.insert(0, Without())
import __spark_entry__ as e
known, checks = e.queries(), e.oracle_sql()
assert "w1_wait_pareto" in known and "w1_wait_pareto" in checks and set(checks) <= set(known)
own = [n for n in known if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
print(len(own), "fleetlens.llm" in sys.modules)
"""


@pytest.mark.parametrize("blocked", [["fleetlens.llm"], ["fleetlens.llm", "corpus_pipeline"]])
def test_queries_without_the_training_data(blocked):
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(blocked=blocked)], capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["0", "False"]


@pytest.mark.parametrize("blocked", [["fleetlens.operators"], ["pyspark"]])
def test_other_missing_modules_are_errors(blocked):
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(blocked=blocked)], capture_output=True, text=True)
    assert out.returncode and "ModuleNotFoundError" in out.stderr
