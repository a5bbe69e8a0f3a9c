from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.test_entry import duck, rows  # noqa: F401
from tiesmith.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
COLUMNS = {
    "p1_found": ["sentence_id_a", "sentence_id_b"], "p2_found": ["doc_id", "kind", "content"], "p3_found": ["entity_id_a", "entity_id_b"], "p4_found": ["target_title", "mark"],
    "p5_found": ["span_id", "ref_id"], "p6_found": ["doc_id", "start_char", "end_char"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, str(DATA))
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    got = df.toPandas()
    assert len(got) == len(got.drop_duplicates()) if name in COLUMNS else len(got) >= 0
    if name in queries.oracle_sql():
        assert rows(got) == rows(duck.execute(queries.oracle_sql()[name]).df())
