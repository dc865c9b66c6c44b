"""The driver's entry, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _listed(folder, hidden=()):
    """Numbers of register queries and of others that the entry lists in a fresh interpreter, where the hidden modules can't be imported."""
    code = f"import sys; sys.modules.update(dict.fromkeys({list(hidden)})); " + (
        "import __spark_entry__ as e; q = e.queries(); o = [k for k in q if k.startswith('op') or k == 'pipeline']; print(len(q) - len(o), len(o), set(e.oracle_sql()) <= set(q))"
    )
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_without_the_training_data_subpackage(tmp_path, pipeline_too):
    shutil.copytree(ROOT / "groupforge", tmp_path / "groupforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if not pipeline_too and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    register, others, sql = _listed(tmp_path)
    assert int(register) > 70 and (others, sql) == ("0", "True")


@pytest.mark.parametrize("library", ["sentencepiece", "tiktoken", "ahocorasick"])
def test_without_a_library_of_the_subpackage(library):
    register, _, sql = _listed(ROOT, [library])
    assert int(register) > 70 and sql == "True"


def test_nothing_else_imports_it():
    for p in (ROOT / "groupforge").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "groupforge.llm" not in p.read_text(), p
