"""The queries that have SQL against it in DuckDB: on the smallest tables, and on small tables of copies, nulls and short rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kelpforge.llm.registry import ORACLE_SQL, QUERIES

TABLES = ("documents", "embeddings", "pages")


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Chains of near copies, equal and opposite vectors, pages that share payloads; ids out of order."""
    d = tmp_path_factory.mktemp("copies")
    words = [f"Wörd{i}" for i in range(60)]
    texts = [None, "", " \t ", "One two", "oNE TWO", "ONE TWO", *(" ".join(words[k : k + 50]) for k in (0, 3, 6, 9)), " ".join(words[:50]).upper(), "a b c d e a b c d e a b c d e f", "x" * 300]
    ids = [(7 * i) % len(texts) for i in range(len(texts))]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": [None, "en"] * (len(texts) // 2) + ["und"] * (len(texts) % 2)}), d / "documents.parquet")
    v = np.random.default_rng(3).normal(size=(12, 32))
    v[1], v[2], v[3], v[4] = v[0] * 2, v[0] + 0.1 * v[5], v[0] - 0.1 * v[5], -v[0]
    vectors = [*map(list, v), None, [0.0] * 32, [float("nan")] * 32, [None, *[1.0] * 31]]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64())[::-1], "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([i % 3 or None for i in range(len(vectors))], pa.int32())}), d / "embeddings.parquet")
    html = [None, "", "short", "short", "é" * 50, "é" * 50, "é" * 49 + "a", "b" * 100, "b" * 100, "b" * 100]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64())[::-1], "url": [f"http://h{i % 3}.example.org/" for i in range(len(html))], "html": html}), d / "pages.parquet")
    return str(d)


@pytest.mark.parametrize("name", ORACLE_SQL)
@pytest.mark.parametrize("where", ["small", "copies"])
def test_sql(spark, copies, name, where):
    d = copies if where == "copies" else "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
        found = con.execute(ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        want = found.fetchall()
    df = QUERIES[name](spark, d)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want, key=repr)
