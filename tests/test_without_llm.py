"""The library stands without the training-data subpackage."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_library_and_its_tests_stand_without_the_subpackage(tmp_path):
    """A copy without ``llm``, ``tests/llm`` and the pipeline: the entry imports, and the other tests pass."""
    skip = shutil.ignore_patterns("llm", "__pycache__")
    for folder in ("lumiframe", "tests"):
        shutil.copytree(os.path.join(TOP, folder), tmp_path / folder, ignore=skip)
    shutil.copy(os.path.join(TOP, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q17_idct_block' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"LUMIFRAME_COPY": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
    if "LUMIFRAME_COPY" not in os.environ:
        done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-x", "-q", "-m", "not slow", "-p", "no:cacheprovider", "--ignore", "tests/test_without_llm.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1800)
        assert done.returncode == 0, done.stdout[-3000:]


def test_only_the_absence_of_the_subpackage_is_passed_over(tmp_path):
    """A module of it that lacks a third package is an error, not an absence."""
    shutil.copytree(os.path.join(TOP, "lumiframe"), tmp_path / "lumiframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(TOP, "__spark_entry__.py"), tmp_path)
    own = tmp_path / "lumiframe" / "llm"
    own.mkdir()
    (own / "__init__.py").write_text("")
    (own / "queries.py").write_text("import no_such_package_anywhere\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode and "no_such_package_anywhere" in got.stderr


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(TOP, "lumiframe")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert not re.search(r"\bllm\b", text.read()), f
