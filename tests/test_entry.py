import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from shelfmark.plans import registry
from tests.oracle import assert_matches

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "shelfmark", tmp_path / "shelfmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(registry.QUERIES)


def test_nothing_outside_imports_the_corpus_operators():
    for p in (ROOT / "shelfmark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "shelfmark.llm" not in p.read_text(), p


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert_matches(df, registry.ORACLES[name], SF)
    else:
        assert df.count() > 0
