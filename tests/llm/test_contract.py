"""Every query of the subpackage: columns of its contract, one row per document."""

import pytest

import __spark_entry__ as entry
from airsignal.llm import queries as Q
from scripts.check_oracle import rows
from tests.conftest import SF

COLUMNS = {
    "op1_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_winnowing": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_quality": ["doc_id", "held_out", "score", "predicted"],
    "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_mixing": ["doc_id", "tokens", "domain", "posterior", "rate"],
}


def test_registered():
    assert set(Q.queries()) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {int(n[2:].split("_")[0]) for n in Q.queries()} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    df = Q.queries()[name](spark, SF)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    assert df.count() == n


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    s, o = Q.queries()[name](spark, SF).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns) and rows(s) == rows(o)
