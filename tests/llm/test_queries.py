"""The registered queries on the given tables, and their SQL."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry_mod
from conftest import SF001
from fleetlens.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    ok, message = compare(entry_mod.queries()[name](spark, SF001), duck(SF001), entry_mod.oracle_sql()[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_of_the_contract(spark, name):
    want = {
        "op2": "doc_id keep_id group_size kept text_sha256", "op3": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op6": "page_id payload_bytes payload_digest record_type refers_to", "op7": "page_id url text n_chars",
        "op12": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
        "op13": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op8": "doc_id n_bytes n_removed n_spans kept_sha256", "op10": "doc_id fingerprint component_id",
    }.get(name.split("_")[0])
    if want:
        df = QUERIES[name](spark, SF001)
        assert df.columns == want.split()
        table = "pages" if name.startswith(("op6", "op7")) else "documents"
        assert df.count() == spark.read.parquet(f"{SF001}/{table}.parquet").count()
