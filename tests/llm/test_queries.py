"""The registered queries give their contract's columns and rows over whole tables."""

import os

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
COLUMNS = {
    "op1_decontamination": "doc_id item_id coverage",
    "op2_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_attention_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_html_extract": "page_id url text n_chars",
    "op7_quality_classifier": "doc_id held_out score predicted",
    "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_source_mix": "doc_id size source_size target taken",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}
ROWS = {"op3_chat_format": None, "op1_decontamination": None, "op6_html_extract": "pages"}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    df = entry.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    n = df.count()
    table = ROWS.get(name, "documents")
    assert n > 0 and (table is None or n == spark.read.parquet(f"{SF}/{table}.parquet").count())


def test_chat_format_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    rows = con.execute(entry.oracle_sql()["op3_chat_format"]).fetchall()
    names = [c[0] for c in con.description]
    got = entry.queries()["op3_chat_format"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_pipeline_is_registered():
    import corpus_pipeline

    assert "pipeline" in entry.queries() and [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "mixing sources to target weights"]
