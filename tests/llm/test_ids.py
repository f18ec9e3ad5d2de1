"""Null ids, ids that repeat and columns whose names clash: what a row's text gives does not depend on them."""

import hashlib
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kelpforge.llm.registry import QUERIES

NAMES = {int(n[2:].split("_")[0]): n for n in QUERIES}
TEXTS = [None, "", "same text of more than five words here", "same text of more than five words here", "mail x@y.example.org now", "mail x@y.example.org now", "another one entirely, with words", "tail"]
IDS = [None, None, 3, 3, 3, None, 7, -2]
#: What each query says of a text alone.
BY_TEXT = {
    1: lambda t: {"size": len(t) + 1, "text_crc32": zlib.crc32(t)}, 2: lambda t: {"n_bytes": len(t), "payload_bytes": 576}, 4: lambda t: {}, 5: lambda t: {"n_email": t.count(b"@"), "n_ip": 0}, 7: lambda t: {}, 8: lambda t: {"size": len(t.split())},
    9: lambda t: {"decoded_sha256": hashlib.sha256(t).hexdigest()}, 10: lambda t: {"n_shingles": max(1, len(t.split()) - 4) if t.split() else 0}, 12: lambda t: {},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("ids")
    n = len(TEXTS)
    extra = {c: pa.array(["z"] * n) for c in ("_id", "_text", "_lang", "_size", "ids", "_class", "_n", "_begin", "_length", "shard", "start", "features", "score")}
    pq.write_table(pa.table({"doc_id": pa.array(IDS, pa.int64()), "text": TEXTS, "lang": ["en"] * n, "source": ["a", None] * (n // 2), "n_chars": pa.array([None if t is None else len(t) for t in TEXTS], pa.int64()), **extra}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([3, 7, 7, None], pa.int64()), "quality": pa.array([1, 0, 0, 1], pa.int32()), "toxic": pa.array([0] * 4, pa.int32()), "text": ["clash"] * 4, "_id": [1.5] * 4}), d / "labels.parquet")
    html = [None, "short", "y" * 200, "y" * 200, "y" * 200]
    pq.write_table(pa.table({"page_id": pa.array([1, 2, 3, 4, 4], pa.int64()), "url": ["http://a.example/"] * 5, "html": html, "_digest": ["z"] * 5, "payload_digest": ["z"] * 5, "path": [1] * 5, "_id": ["q"] * 5}), d / "pages.parquet")
    return str(d)


@pytest.mark.parametrize("n", BY_TEXT)
def test_documents(spark, folder, n):
    got = [r.asDict() for r in QUERIES[NAMES[n]](spark, folder).collect()]
    if n == 7:
        assert len(got) == len(IDS)
        return
    whole = [r for r in got if r.get("start", 0) == 0 or n == 4]
    assert Counter(r["doc_id"] for r in whole) in (Counter(IDS), Counter(-1 if i is None else i for i in IDS))  # files of ids have no nulls
    want = Counter()
    for i, t in zip(IDS, TEXTS, strict=True):
        want[(i, *BY_TEXT[n]((t or "").encode()).values())] += 1
    keys = list(BY_TEXT[n](b""))
    if keys:
        assert Counter((r["doc_id"], *(r[k] for k in keys)) for r in got) == want
    if n == 10:
        linked = {r["component_id"] for r in got if r["n_shingles"] == 4}
        assert len(linked) == 1


def test_pages(spark, folder):
    got = [r.asDict() for r in QUERIES[NAMES[6]](spark, folder).collect()]
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter([(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3)])
