"""Points of texts that have none, against the SQL of the queries."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brindle.functions import text as X
from brindle.plans import catalogue

from .compare import TABLES, duck_rows, spark_rows
from .test_text import many

TEXTS = [None, "", " \n", ".", "...", "，", "；；；；", " . , ", "　。　", "...a", "a.,;", ". .;a", "；a。b", "one. two, three.", "a b"]


@pytest.fixture
def odd(tmp_path, data):
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(Path(data) / f"{t}.parquet")
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": "src0", "n_chars": len(t or "")} for i, t in enumerate(TEXTS)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["bulletize", "reply_texts"])
def test_texts_without_points_equal_sql(spark, odd, name):
    query, sql = catalogue.ALL[name]
    assert spark_rows(query(spark, odd)) == duck_rows(sql, odd)


def test_a_text_is_its_own_point_only_where_asked(spark):
    assert many(spark, X.points("text"), ["...", " ", "a.b"]) == [[], [], ["a", "b"]]
    assert many(spark, X.bulletize("text"), ["...", " ", "a.b"]) == [["..."], [""], ["a", "b"]]
