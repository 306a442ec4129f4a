import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["series", "ts1", "ts2"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    """The rest works when the llm folders and the pipeline are gone."""
    (tmp_path / "tidemark").mkdir()
    for p in (ROOT / "tidemark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tidemark" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); assert 'bins_by_width_1h' in q and not any(n.startswith(('op', 'pipeline')) for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
