"""The entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_without_the_subpackage(tmp_path):
    """Without ``findsieve/llm``, with ``corpus_pipeline.py`` there or not, the other queries are as they were."""
    ignore = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md")
    for name, drop in (("with", False), ("without", True)):
        copy = tmp_path / name
        shutil.copytree(ROOT, copy, ignore=ignore)
        if drop:
            os.remove(copy / "corpus_pipeline.py") if os.path.exists(copy / "corpus_pipeline.py") else None
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'verdict' in q and 'verdict' in o; assert not [k for k in q if k.startswith('op') and k[2].isdigit() or k == 'pipeline']"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
