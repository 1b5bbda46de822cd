"""A spread of registered queries against their SQL on the smallest data; ``tests/check.py`` runs them all."""

import os

import pytest

from tests.check import compare, duck
from tidewatch.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHOSEN = ["features", "a1_weighted_rollup", "a7_repaired_thresholds", "w2_ewma", "w14_memory_fill", "s5_matrix_json",
          "a14_episodes", "d2_psi_all_features", "b4_ewma_z", "m2_roc_auc", "i6_horizon_flags", "st5_debounce",
          "st1_stream_rollup", "st45_stream_alarm_state"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    line, ok = compare(spark, duck(SF), name, catalog.queries()[name], catalog.oracles()[name], SF)
    assert ok, line


def test_every_oracle_has_a_query():
    assert set(catalog.oracles()) <= set(catalog.queries())
