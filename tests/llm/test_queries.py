import pytest

import __spark_entry__ as entry
from mosaiq.llm import queries

from ..conftest import SF
from ..oracle import compare

CONTRACT = {
    1: "doc_id n_words n_removed kept_sha256",
    2: "page_id host path rule verdict",
    3: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    4: "doc_id n_bytes n_removed n_spans kept_sha256",
    5: "doc_id n_shingles component_id kept",
    6: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    7: "doc_id piece start length ids_crc32 sequence_id offset",
    8: "doc_id n_assign n_access n_hex base_sha256 spans",
    9: "doc_id held_out score predicted",
    10: "doc_id size source_size target taken",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = CONTRACT[int(name[2:].split("_")[0])].split()
    assert df.columns[: len(columns)] == columns
    if name in queries.oracle_sql():
        assert compare(df, queries.oracle_sql()[name], SF) == ""
    else:
        assert df.count() >= spark.read.parquet(f"{SF}/documents.parquet").count()


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
