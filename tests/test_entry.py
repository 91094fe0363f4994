"""The driver's entry without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_llm_folder(tmp_path):
    for name in ("rangeledger", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'sector_summary' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1_')]; assert set(s) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
