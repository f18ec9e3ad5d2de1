"""The pipeline, stage by stage, against plain Python on what the stage before it kept."""

import base64
import hashlib
import re
import struct
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_mixing import WORD
from test_queries import SMALL, awkward, components, empty, personal  # noqa: F401  the fixtures

from kelpforge.llm import quality


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Repeated and null ids with equal, near and different texts; columns named as the operators name theirs."""
    d = tmp_path_factory.mktemp("repeated")
    base = [f"word{i}" for i in range(60)]
    texts = [(7, base), (7, base), (7, base[::-1]), (None, base), (None, [*base[:-1], "end"]), (None, base[::-1]), (3, [*base, "more"]), (9, None), (None, None), (9, [])]
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in texts], pa.int64()), "text": pa.array([None if t is None else " ".join(t) for _, t in texts], pa.string()), "lang": ["en"] * n, "source": pa.array([None, "a"] * (n // 2)), "n_chars": pa.array([1] * n, pa.int64()),
                             **{c: ["x"] * n for c in ("_mark", "_tie", "_id", "_size", "_text", "_row", "_part", "component_id", "n_shingles", "score", "keep", "shard")}}), d / "documents.parquet")
    pq.write_table(pq.read_schema(f"{SMALL}/labels.parquet").empty_table(), d / "labels.parquet")
    return str(d)


@pytest.fixture(params=["small", "awkward", "repeated"])
def there(request):
    return SMALL if request.param == "small" else request.getfixturevalue(request.param)


def listed(df):
    return Counter(tuple(r) for r in df.collect())


def shingled(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, there, tmp_path, monkeypatch):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{there}/documents.parquet")
    columns, models = docs.columns, []
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: models.append(real(*a, **k)) or models[-1])

    def next_(docs, name):
        out = stages[name](spark, docs, there)
        if name != "byte-level BPE":
            assert out.columns == columns
            out.write.parquet(path := str(tmp_path / name))
            out = spark.read.parquet(path)
        return out, [r.asDict() for r in out.collect()]

    rows = [r.asDict() for r in docs.collect()]
    good, kept = next_(docs, "quality classifier")
    if models[0] is None:
        assert listed(good) == listed(docs)
    else:
        scores = [models[0].scores(quality.dampened(quality.text_counts(r["text"] or "")[None, :]), quality.meta_view([quality.meta_places(r["lang"], r["source"], r["n_chars"])]))[2][0] for r in rows]
        assert Counter(map(str, kept)) == Counter(str(r) for r, s in zip(rows, scores, strict=True) if s >= 0.5)

    one, left = next_(good, "n-gram Jaccard join")
    sets = [shingled(r["text"]) for r in kept]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * (k := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - k)]
    root = components(len(sets), links)
    lowest = {}
    for i, r in enumerate(kept):
        lowest.setdefault(root[i], []).append((r["doc_id"] is None, r["doc_id"] or 0))
    assert Counter(r["doc_id"] for r in left) == Counter(None if min(x)[0] else min(x)[1] for x in lowest.values())
    assert not [1 for i, a in enumerate(left) for b in left[:i] if a["text"] and a["text"] == b["text"] and shingled(a["text"])] and not Counter(map(str, left)) - Counter(map(str, kept))

    clean, masked = next_(one, "personal data")
    before = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).digest()): r for r in left}
    assert len(masked) == len(left) == len(before) or there != SMALL
    assert not [m for r in masked for m in personal(r["text"] or "")]
    plain = Counter(r["text"] for r in left if "[" not in (r["text"] or "") and not re.search(r"[0-9@+]|://", r["text"] or ""))
    assert not plain - Counter(r["text"] for r in masked)  # what has no anchor is left alone
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in masked)

    mix, mixed = next_(clean, "mixing to target weights")
    words = sum(len(WORD.findall(r["text"] or "")) for r in masked)
    taken = sum(len(WORD.findall(r["text"])) for r in mixed)
    assert abs(taken - 1.5 * words) <= max(0.03 * words, 40)
    texts = {}
    for r in masked:
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert all(r["text"] and any(r["text"] in t for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in mixed)

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in mixed:
        ids = enc.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    _, got = next_(mix, "byte-level BPE")
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == Counter(want)


def test_empty_tables(spark, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).collect() == []
