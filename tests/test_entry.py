import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns[0] == "empresa_id"


def test_the_library_stands_without_the_training_data_operators(tmp_path):
    """Without that subpackage and the pipeline, the entry module has the library's queries, and no other module asks for them."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "leadflow", tmp_path / "leadflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import pkgutil, importlib, leadflow, __spark_entry__ as e; [importlib.import_module(m.name) for m in pkgutil.walk_packages(leadflow.__path__, 'leadflow.')]; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    queries, sql, numbered = map(int, done.stdout.split())
    assert queries > 50 and sql > 50 and numbered == 0
