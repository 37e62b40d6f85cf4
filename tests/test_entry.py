"""The entry points with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_optional_folders(tmp_path):
    bare = tmp_path / "repo"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "corpus_pipeline.py"))
    for with_pipeline in (False, True):  # a pipeline that is left behind has nothing to run on
        if with_pipeline:
            (bare / "corpus_pipeline.py").write_text("import foldkeep.llm.queries\n")
        said = "import __spark_entry__ as e; q = e.queries(); assert 'get_lww' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", said], cwd=bare, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(bare)})
