import pathlib
import re

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_core_never_imports_the_subpackage():
    for p in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", p.read_text(), re.M), p


def test_every_sql_has_its_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_flagship(spark):
    assert entry.entry(spark).columns == ["kmer", "cnt"]
