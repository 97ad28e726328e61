"""A spread of registered queries against their SQL on the smallest tables."""
import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SPREAD = [
    "t01_section_headers", "v05_clean_stream", "v08_id_stream", "w02_section_and_category", "x04_metadata_samples",
    "r04_word_contexts", "r14_finished_examples", "m04_split_marginals", "g05_rank_by_kl", "e04_class_report",
    "c01_comparison_sets", "k02_spread_of_models", "l11_prepared_labelled_set", "s03_assembled_documents",
]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, con, name):
    message = oracle.compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert message == "" or message.startswith("empty result"), message


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["sf", "accuracy", "macro_f1", "weighted_f1"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["t08_sectioned_notes", "v08_id_stream", "x05_round_robin", "g05_rank_by_kl", "r01_dictionary_scan"])
def test_query_equals_sql_beyond_all_bounds(spark, con, monkeypatch, name):
    """The branches for large tables: nothing is broadcast, few rows a task."""
    from notelens.operators import scale

    name = next(q for q in entry.queries() if q.startswith(name.split("_")[0] + "_"))
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(scale, "ROWS_PER_TASK", 5000)
    monkeypatch.setattr(scale, "HOT_SHARE", 0.01)
    assert oracle.compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name]) == ""
