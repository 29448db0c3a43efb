"""The registry: every query runs; those with a twin give its rows."""

import math
from pathlib import Path

import duckdb
import pytest

from pagewright.plans import image_queries, layout_queries, registry, text_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bool, str)):
        return value
    return round(float(value), 8) if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio") else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, tables, name):
    found = registry.QUERIES[name](spark, DATA)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    asked = tables.execute(registry.ORACLES[name])
    assert got == rows_of([c[0] for c in asked.description], asked.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).first().evaluated == 87
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


def test_only_the_training_part_may_be_missing(tmp_path):
    """Without it the rest is there; a library that it needs isn't allowed to make it vanish."""
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.path[:0] = [{root!r}]; sys.modules[{name!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(root=str(root), name=name)], capture_output=True, text=True, cwd=tmp_path)
    assert run("pagewright.llm").stdout.split() == [str(len(registry.QUERIES)), "False"]
    if (root / "pagewright/llm").exists():
        assert run("public_tokenizers").returncode != 0


def test_no_machine_local_folder_on_a_cluster(spark, tmp_path):
    from pagewright.session import shared_dir

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("__", "."): v for k, v in conf.items()}

    assert shared_dir(Session(spark__checkpoint__dir="hdfs://x", spark__master="yarn")) == "hdfs://x"
    for master in ("local", "local[4]"):
        assert shared_dir(Session(spark__master=master)).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", ""):
        with pytest.raises(RuntimeError):
            shared_dir(Session(spark__master=master))
