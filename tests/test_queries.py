"""Every query of the engine's operators that SQL can express, against that SQL; the others run and keep their columns."""

import pytest

from quillmere.plans.queries import ORACLES, QUERIES
from tests.compare import DATA, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == sql_rows(ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_office_files_are_made_a_slice_at_a_time():
    import pyarrow as pa

    from quillmere.plans import queries

    whole = pa.RecordBatch.from_pydict({"conv_id": list(range(1000)), "turn": [0] * 1000, "text": [f"t{n}" for n in range(1000)]})
    asked = []
    made = queries._made([whole, whole.slice(0, 0)], lambda t: (asked.append(t), t.encode())[1])
    first = next(made)
    assert len(asked) == first.num_rows == queries._FILES
    rows = [first, *made]
    assert max(b.num_rows for b in rows) == queries._FILES
    assert [x for b in rows for x in zip(*(c.to_pylist() for c in b.columns))] == [(n, 0, f"t{n}".encode()) for n in range(1000)]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_registry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
