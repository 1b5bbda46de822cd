"""Licence scans against SQL and worked units."""

import duckdb
from tidewatch.llm import licences, queries

from tests.check import canonical
from tests.llm.helpers import SF, frame


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = con.execute(licences.scan_sql()).df(), queries.op5_license_scans(spark, SF).toPandas()
    assert canonical(got) == canonical(want) and len(got)


def test_units_and_odd_rows(spark):
    mit = licences.TEMPLATES[17][1]
    cut = mit.find(" ", 200)
    rows = [(1, ' '.join(f'word{i}' for i in range(99)) + f"\n\n{mit[:cut]}\n{mit[cut + 1:]}\n\nend"), (2, None), (3, ""), (4, "licensed UNDER cc-by nc 4.0!"), (4, "licensed UNDER cc-by nc 4.0!"),
            (5, "the license " * 20_000), (None, "SPDX-License-Identifier: MIT"), (6, "licensed under the"), (7, "x" * 50_000)]
    got = sorted(((r.doc_id, r.unit, r.position, r.licence, r.dice) for r in licences.scan(frame(spark, [(i, t, "", 0, 0, "") for i, t in rows])).collect()), key=str)
    assert got == sorted([(1, "paragraph", 1, "MIT", 1.0), (4, "line", 0, "CC-BY-NC-4.0", 1.0), (4, "line", 0, "CC-BY-NC-4.0", 1.0), (None, "line", 0, "MIT", 1.0)], key=str)
    assert licences.scan(frame(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    plan = licences.scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "Exchange" not in plan
