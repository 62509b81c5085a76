import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import of_spark, of_sql, with_documents

from mixlens.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, data, name):
    assert of_spark(catalog.QUERIES[name](spark, data)) == of_sql(catalog.ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_format_regex_check_of_values_before_text(spark, data, tmp_path):
    folder = with_documents(data, tmp_path, text="CASE WHEN doc_id % 3 = 0 THEN '42 xx' WHEN doc_id % 3 = 1 THEN '\"a\": 1} {\"b\": 2' ELSE '42' END")
    assert of_spark(catalog.QUERIES["format_regex_check"](spark, folder)) == of_sql(catalog.ORACLES["format_regex_check"], folder)


def test_validation_full_from_a_hundred_thousand_ids_on(spark, data, tmp_path):
    folder = with_documents(data, tmp_path, doc_id="doc_id + 99990")
    assert of_spark(catalog.QUERIES["validation_full"](spark, folder)) == of_sql(catalog.ORACLES["validation_full"], folder)
