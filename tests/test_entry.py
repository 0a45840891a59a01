import re
from pathlib import Path

import __spark_entry__ as entry


def test_names_and_sql():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) >= 50
    assert all(callable(f) for f in known.values())


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_nothing_else_imports_the_training_data_subpackage():
    root = Path(entry.__file__).parent / "corvane"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+\S*llm", p.read_text(), re.M), p
