"""What the driver imports, with and without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q; print(len(q), 'trend_test' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"


def loaded(folder):
    done = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    count, core, text = done.stdout.split()
    return int(count), core == "True", text == "True"


@pytest.mark.parametrize("pipeline", [True, False])
def test_core_queries_load_without_the_text_operators(tmp_path, pipeline):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "isotrend"), tmp_path / "isotrend", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if pipeline:
        # Left behind when only the folders go; what it imports is not there.
        (tmp_path / "corpus_pipeline.py").write_text("from isotrend.llm import quality\n")
    count, core, text = loaded(tmp_path)
    assert count >= 74 and core and not text


def test_an_error_inside_the_text_operators_is_seen(tmp_path):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "isotrend"), tmp_path / "isotrend", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "isotrend" / "llm").mkdir()
    (tmp_path / "isotrend" / "llm" / "__init__.py").write_text("")
    (tmp_path / "isotrend" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    with pytest.raises(AssertionError, match="no_such_module_anywhere"):
        loaded(tmp_path)
