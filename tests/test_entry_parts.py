"""The entry point without its optional parts: left out, or lacking a package."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT
from tillroll.plans import catalog

_ASK = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {missing!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
print(sorted(e.queries()))
print(sorted(e.oracle_sql()))
"""


def _asked(folder, missing=()):
    ran = subprocess.run(
        [sys.executable, "-c", _ASK.format(missing=tuple(missing))],
        cwd=folder,
        env={**os.environ, "PYTHONPATH": str(folder)},
        capture_output=True,
        text=True,
        timeout=120,
    )
    assert ran.returncode == 0, ran.stderr
    return [set(eval(line)) for line in ran.stdout.splitlines()]


@pytest.fixture(scope="module")
def retail():
    return set(catalog.queries())


def _copy(to, pipeline):
    shutil.copytree(f"{ROOT}/tillroll", f"{to}/tillroll", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", to)
    if pipeline:  # imports what is not there, as the left-out file would
        with open(f"{to}/corpus_pipeline.py", "w") as f:
            f.write("from tillroll.llm import bpe\n\nrun = bpe.bpe_digests\n")


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_folders(tmp_path, retail, pipeline):
    _copy(tmp_path, pipeline)
    queries, oracles = _asked(tmp_path)
    assert queries == retail
    assert oracles <= retail


@pytest.mark.parametrize("package", ["ahocorasick", "public_tokenizers", "tokenizers"])
def test_without_a_package(retail, package):
    queries, oracles = _asked(ROOT, [package])
    assert retail <= queries
    assert {k for k in oracles if not k.startswith("op")} <= retail
