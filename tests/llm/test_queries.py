"""The first ten queries against brute force: on the smallest tables, on tables with awkward rows, and all of them on empty ones."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kelpforge.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
NAMES = {int(n[2:].split("_")[0]): n for n in QUERIES}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    """Null, empty, blank, very long and repeated texts, ties, null sources, and extra columns whose names clash."""
    d = tmp_path_factory.mktemp("awkward")
    words = [f"w{i % 997}é" for i in range(60_000)]
    texts = [None, "", "   ", "one two", "one two", "One TWO", " ".join(words), " ".join(words[:-3]) + " tail end", "a b c d e f g h", "a b c d e f g h", "a b c d e f g x",
             "mail me: x.y+z@sub-a.example.org, +1 (555) 123-4567 or 10.0.0.256 10.1.2.3 card 4111 1111 1111 1111.", "\u0085  nbsp wide  two   three\n\n\nfour", "<|endoftext|> 𝔘𝔫𝔦 😀 'll we've 12345 ...", "x" * 5000]
    texts += ["copy of a copied passage with enough words to be counted here"] * 12
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None, *["en"] * (n - 1)]), "source": pa.array([None if i % 5 == 0 else f"s{i % 4}" for i in range(n)]),
                             "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()), "_id": pa.array(range(n)), "_size": pa.array(["z"] * n), "size": pa.array([1.5] * n), "component_id": pa.array([7] * n)}), d / "documents.parquet")
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 64)).astype(np.float32)
    v[1] = v[0] * 3
    v[2] = v[0] + 0.05 * v[3]
    rows = [list(map(float, x)) for x in v] + [None, [0.0] * 64, [float("nan")] * 64, [None, *[1.0] * 63], [float("inf")] * 64] + [list(map(float, v[5]))] * 6
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([None] * len(rows), pa.int32())}), d / "embeddings.parquet")
    html = [None, "", "short", "short", "é" * 60, "é" * 60, "b" * 100, "b" * 100, "b" * 100, "c" * 99, "c" * 99, "<p>" + "y" * 200_000]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": pa.array([None, "", *[f"http://h{i % 2}.example.org/{i}" for i in range(len(html) - 2)]]), "html": pa.array(html, pa.string())}), d / "pages.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([3, 6, 8, 11, 15, 16], pa.int64()), "quality": pa.array([0, 1, 0, 1, 1, None], pa.int32()), "toxic": pa.array([0] * 6, pa.int32())}), d / "labels.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in Path(SMALL).glob("*.parquet"):
        pq.write_table(pq.read_schema(f).empty_table(), d / f.name)
    return str(d)


def rows(spark, n, d, key="doc_id"):
    return sorted((r.asDict() for r in QUERIES[NAMES[n]](spark, d).collect()), key=lambda r: r[key])


def table(d, name="documents"):
    return sorted(pq.read_table(f"{d}/{name}.parquet").to_pylist(), key=lambda r: next(iter(r.values())))


@pytest.fixture(params=["small", "awkward"])
def there(request):
    return SMALL if request.param == "small" else request.getfixturevalue("awkward")


@pytest.mark.parametrize("n", range(1, 14))
def test_empty(spark, empty, n):
    assert QUERIES[NAMES[n]](spark, empty).collect() == []


def test_op1(spark, there):
    got, docs = rows(spark, 1, there), table(there)
    raw = [(x["text"] or "").encode() for x in docs]
    assert [(r["doc_id"], r["size"], r["text_crc32"]) for r in got] == [(x["doc_id"], len(b) + 1, zlib.crc32(b)) for x, b in zip(docs, raw, strict=True)]
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    most = max(r["size"] for r in got)
    assert all(abs(size[s] - sum(size.values()) / 8) <= most for s in range(8)) and {r["law"] for r in got} == {"bytes"}


def test_op2(spark, there):
    got, docs, seen = rows(spark, 2, there), table(there), {}
    assert len(got) == len(docs)
    for r, x in zip(got, docs, strict=True):
        raw = (x["text"] or "").encode()
        whole = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert seen.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
        tensor = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        means = ",".join(f"{m:.3f}" for m in tensor.reshape(-1, 3).mean(axis=0))
        assert r["feature"] == f"{r['height']}x{r['width']}:{means}:{hashlib.sha256(r['rgb']).hexdigest()[:16]}"


def components(n, links):
    up = list(range(n))
    for _ in range(n):
        before = list(up)
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
        if up == before:
            return up
    return up


def test_op3(spark, there):
    got, vectors = rows(spark, 3, there, "vec_id"), table(there, "embeddings")
    v = [np.array([np.nan if c is None else c for c in x["embedding"]] if x["embedding"] else [np.nan], float) for x in vectors]
    ok = [bool(np.isfinite(x).all() and x.any()) for x in v]
    unit = [x / np.sqrt(x @ x) if o else x for x, o in zip(v, ok, strict=True)]
    links = [(i, j) for i in range(len(v)) for j in range(i) if ok[i] and ok[j] and len(v[i]) == len(v[j]) and unit[i] @ unit[j] >= 0.95]
    n, root = Counter(x for p in links for x in p), components(len(v), links)
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [(i, n[i], root[i], root[i] == i) for i in range(len(v))]


def test_op4(spark, there):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for x in table(there):
        ids = t.encode(x["text"] or "", add_special_tokens=False).ids + [2]
        want.append((x["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, 4, there)] == want


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in found]


def test_op5(spark, there):
    for r, x in zip(rows(spark, 5, there), table(there), strict=True):
        base = personal(x["text"] or "")
        count = Counter(b.split(":")[0] for b in base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [count[k] for k in ("email", "ip", "card", "phone")], x["text"]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}


def test_op6(spark, there):
    first, want = {}, []
    for x in table(there, "pages"):
        raw = (x["html"] or "").encode()
        to = first.setdefault(raw, x["page_id"]) if len(raw) >= 100 else x["page_id"]
        revisit = to != x["page_id"]
        want.append((x["page_id"], len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(spark, 6, there, "page_id")] == want


def test_op7_keeps_every_row_and_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(spark, 7, d)}
    assert sorted(got) == [x["doc_id"] for x in table(d)]
    known = [x for x in table(d, "labels") if x["doc_id"] in got]
    right = [got[x["doc_id"]]["keep"] == bool(x["quality"]) for x in known]
    assert sum(right) / len(right) > 0.85


def test_op7_awkward(spark, awkward):
    assert len(rows(spark, 7, awkward)) == len(table(awkward))


def test_op8(spark, there):
    got, docs = rows(spark, 8, there), table(there)
    size, total = [len(WORD.findall(x["text"] or "")) for x in docs], Counter()
    for x, n in zip(docs, size, strict=True):
        total[x["source"]] += n
    sources = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(size), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * total[s]]
        for s in over or open_.copy():
            target[s] = 2.0 * total[s] if over else weight[s] * level
            left -= target[s]
            open_.discard(s)
    taken, biggest = Counter(), max(size)
    for r, x, n in zip(got, docs, size, strict=True):
        s = x["source"]
        assert (r["size"], r["source_size"]) == (n, total[s]) and r["target"] == pytest.approx(target[s], rel=1e-9) and 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
    assert biggest and all(abs(taken[s] - target[s]) <= max(260, 0.02 * target[s]) for s in sources)
    assert got == rows(spark, 8, there)


def test_op9(spark, there):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r, x in zip(rows(spark, 9, there), table(there), strict=True):
        text = x["text"] or ""
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op10(spark, there):
    docs, sets = table(there), []
    for x in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x["text"] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids = [x["doc_id"] for x in docs]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * (k := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - k)]
    root = components(len(sets), links)
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(spark, 10, there)] == [(ids[i], len(s), ids[root[i]]) for i, s in enumerate(sets)]
