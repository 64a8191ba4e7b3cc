"""Registered queries against their SQL at the smallest scale. The slow whole
jobs are left to `python -m tests.compare`, which runs all of them."""
import pytest

import __spark_entry__ as entry
from tests.compare import compare
from tests.conftest import SF

FAST = (
    "leave_fee_month", "date_text_parse", "record_date", "cell_cast", "html_to_text", "thread_cut", "header_fold", "header_variants", "record_values",
    "row_validate", "sheet_layout", "sheet_rank", "header_keys", "key_conflicts", "unique_keys", "leave_merge", "content_dedupe", "mail_decode", "mail_parts",
    "xlsx_cells", "docx_blocks", "derived_closure", "record_intent", "intent_filter", "record_gate", "dedupe_leave", "dedupe_people", "source_score",
    "facts", "merged_scalars", "signature_order", "reply_parse", "reply_shape", "form_columns", "fuzzy_headers", "records_to_cells", "stream_dedupe",
)


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, con, name):
    state, n, _, note = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok", note
    assert n > 0


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 130


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["employee_id", "name", "leave_date", "fee_month"]
    assert df.count() > 0
