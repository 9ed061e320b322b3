import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_nothing_outside_imports_the_training_data_part():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path


def test_flagship(spark):
    assert entry.entry(spark).columns == ["table_name", "ref_month", "n_references", "n_missing", "n_deleted", "n_late"]
