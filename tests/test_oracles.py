"""Registered queries against their SQL. ``SIFT_ALL=1`` runs every key instead of a choice."""

import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
CHOICE = (
    "source_tokens class_profile cognitive smell_009_feature_envy dead_003_unused_import sec_002_sql_injection "
    "dup_001_clone dup_001_clone_methods findings_dedup quality_gate summary_rollup write_csv maintainability "
    "method_profile name_008_exception_suffix smell_016_null_return sec_001_hardcoded_secret_documents sec_012_hardcoded_ip "
    "sec_007_ldap_injection sec_008_path_traversal content_hash scan_sources source_mended source_parts met_004_low_comments_layout "
    "met_005_low_mi_methods"
).split()
KEYS = sorted(entry.queries()) if os.environ.get("SIFT_ALL") else CHOICE

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("key", KEYS)
def test_query_equals_its_sql(spark, con, key):
    df = entry.queries()[key](spark, SF_DIR)
    answer = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(answer.fetchall(), names)


def test_every_query_has_sql():
    """Those of the training-data part are tested against plain Python where SQL can't say the same."""
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(key == "pipeline" or key.startswith("op") for key in without)
