import pytest
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry())
def test_query_matches_sql(spark, duck, same, name):
    query, sql = registry()[name]
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        same(query(spark, SF), duck, sql)


def test_entry_works_and_has_all_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
