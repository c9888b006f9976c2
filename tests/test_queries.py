"""Registered queries against their SQL on the smallest tables.

By default the composites and one query per kind of input; ``QUERY_TESTS=all`` takes every query, as
``tests/compare.py`` does on larger tables.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


CHOSEN = """
s04_read_questions s07_write_answers s08_cached_table s10_read_lexical_index s12_read_vector_index s14_skip_corrupt
t07_analyze_documents t09_analyze_queries t12_title_from_url g03_chunk_words_pad a03_build_vocab a07_lexical_stats
j02_lexical_search_pad l06_random_sample e08_search_with_titles v04_lloyd_step v07_knn_exact v08_ivf_search_codes
v09_rotation a12_assign_positions e09_search_texts e05_build_run a15_compare_runs e07_evaluate_and_compare
""".split()
# Without those of optional subpackages, which have tests of their own.
OWN = [name for module in entry.OWN_MODULES for name in module.REGISTRY]
NAMES = OWN if os.environ.get("QUERY_TESTS") == "all" else CHOSEN


def test_every_query_has_its_sql():
    assert set(OWN) <= set(entry.queries()) and set(OWN) <= set(entry.oracle_sql()) and set(CHOSEN) <= set(OWN)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    assert difference(df, con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score"] and df.count() > 0
