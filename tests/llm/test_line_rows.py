"""The line threshold counts distinct ids in the query and the pipeline, as the query's SQL does."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402
from tidemark.llm import queries  # noqa: E402

LINE = "one and the same long line of text"
OTHER = "another long line of three documents"


@pytest.fixture(scope="module")
def rows_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rows"))
    rows = [(1, LINE), (1, LINE), (2, f"{LINE}\nend"), (3, OTHER), (4, OTHER), (5, OTHER), (5, OTHER)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("more", [[], [(None, LINE), (None, LINE), (None, None), (7, None), (7, ""), (8, f"{OTHER}\n\n{OTHER} \n")]])
def test_query_equals_sql_on_repeated_and_null_ids(spark, tmp_path, more):
    rows = [(1, LINE), (1, LINE), (1, LINE), (2, f"{LINE}\nend"), (3, OTHER), (4, OTHER), (5, OTHER), (5, OTHER), *more]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.OP10_SQL})").fetchall()
    got = queries.op10_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want)) and len(got) == len(rows)


def test_pipeline_keeps_lines_of_two_documents(spark, rows_dir):
    got = cp.lines(spark, spark.read.parquet(f"{rows_dir}/documents.parquet"), rows_dir).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, LINE), (1, LINE), (2, f"{LINE}\nend"), (3, ""), (4, ""), (5, OTHER), (5, OTHER)]
