"""Queries where a symbol has so many splits that their product leaves the range of a double."""

import os

import duckdb
import pytest

from barloom.plans import catalogue

from test_queries import TABLES, rows_of

#: Queries by the finding that named them.
NAMES = [
    "c4_asof_window",
    "b12_observations",
    "e5_sampled_arrays",
    "e5_training_rows",
    "e5_window_arrays",
    "f5_averages",
    "a34_tabular_cache",
    "f17_standardize",
    "f22_causal",
    "f7_feature_rows",
    "f16_scales",
    "f16_sliced_scales",
    "f18_scale_calibration",
    "f19_decompose",
    "f20_patches",
    "g11_ridge",
    "g1_all_rules",
    "g1_rules",
    "e6_relative",
    "f8_relative_sequence",
]


@pytest.fixture(scope="module")
def split_folder(data, tmp_path_factory):
    """Every order is a split: some 1,800 a region, so that early closes are zero and early volumes infinite."""
    place = str(tmp_path_factory.mktemp("splits"))
    con = duckdb.connect()
    for name in TABLES:
        if name != "orders":
            os.symlink(f"{data}/{name}.parquet", f"{place}/{name}.parquet")
    con.execute(f"copy (select o.* replace ((o_orderkey + i * 1000000) * 501 as o_orderkey) from '{data}/orders.parquet' o, range(6) r(i)) to '{place}/orders.parquet' (format parquet)")
    return place


@pytest.fixture(scope="module")
def duck_splits(split_folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{split_folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_many_splits(spark, split_folder, duck_splits, name):
    df = catalogue.queries()[name](spark, split_folder)
    want = duck_splits.sql(catalogue.oracle_sql()[name])
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), want.columns)
