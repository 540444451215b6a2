"""The driver's contract."""

import __spark_entry__ as entry


def test_sql_only_for_queries_that_exist():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_does_not_import_the_text_subpackage():
    import pathlib

    import fernweave

    root = pathlib.Path(fernweave.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "fernweave.llm" not in path.read_text()
