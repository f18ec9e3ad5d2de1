"""op11 against plain counting: on given tables, on awkward texts, and with tiny dictionaries, tiles and rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from kelpforge.llm import collocations as c

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least=30, top=2000, covered=80):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in good.items():
            for k in range(2, len(p)):
                dropped |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= covered * good[p[i : i + k]]}
        found = []
        for p, a in good.items():
            if p not in dropped:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r[x] for x in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], "doc_id long, lang string, text string, _lang string, _n int, _word string")


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_given_tables(spark, d):
    want = plain([(r["lang"], r["text"]) for r in pq.read_table(f"/root/testdata/{d}/documents.parquet", columns=["lang", "text"]).to_pylist()])
    assert want and found(c.op11_collocations(spark, f"/root/testdata/{d}")) == want


def awkward():
    rng = np.random.default_rng(2)
    words = ["the", "The", "of", "Éa", "éa", "x'y", " ", "<a>", "z" * 40, "w"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", ";:", "!?", "\n", "\r\n", "\x0b", "\x0c"]
    made = ["".join(words[i] + ends[j] for i, j in zip(rng.zipf(1.5, k) % len(words), rng.integers(0, len(ends), k), strict=True)) for k in (0, 1, 2, 400, 900, 3000)]
    return [(None, None), ("en", None), ("en", ""), ("en", " \t "), ("en", "a b c d e " * 50), ("de", "a b c d e " * 50), (None, "a b a b a b. " * 40), ("und", "b a b " * 3), ("en", "same same same same same " * 30), ("", "in no language, in no language, " * 20), *[(g, t) for g in ("en", None) for t in made]]


def test_awkward(spark):
    rows = awkward()
    assert found(c.collocations(frame(spark, rows))) == plain(rows)
    few = c.Mining(least=3, top=7, covered=50)
    assert found(c.collocations(frame(spark, rows), few)) == plain(rows, 3, 7, 50)


def test_bands_small_tiles_and_long_texts(spark):
    """Dictionaries in several bands, texts longer than a run, rows of few ids, and counts given out early."""
    rows = awkward()
    small = c.Mining(least=2, entries=700, run_bytes=700, row_ids=5, words_held=3, pairs_at_once=50, pairs_held=8, tile=2, direct=3)
    assert found(c.collocations(frame(spark, rows).coalesce(1), small)) == plain(rows, 2)
    assert found(c.collocations(frame(spark, rows), c.Mining(least=20, entries=4))) == plain(rows, 20)


def test_empty(spark):
    assert found(c.collocations(frame(spark, []))) == []
    assert found(c.collocations(frame(spark, [("en", None), ("en", "one two three")]))) == []


def test_counts_of_pairs():
    rng = np.random.default_rng(1)
    for m, n in ((1, 10), (300, 50_000), (300_000, 20_000), (3_000_000, 20_000)):
        a, b = (np.minimum(rng.zipf(1.3, n) - 1, m - 1) for _ in range(2))
        k, got = c.merged(*c.count_pairs(a, b, m))
        assert dict(zip(k.tolist(), got.tolist(), strict=True)) == Counter((a * m + b).tolist())


def test_words_that_share_a_hash(monkeypatch):
    """Both are given out, so that they are found and hashed anew."""
    find = c.find_words
    monkeypatch.setattr(c, "find_words", lambda flat, seed: (*find(flat, seed)[:2], np.zeros(3, np.uint64), *find(flat, seed)[3:]))
    tokens = c._Tokens(0)
    tokens.run([b"one two one"], ["en"])
    got = tokens.words().to_pylist()
    assert len({r["_h"] for r in got}) == 1 and {r["_word"] for r in got} == {"one", "two"} and sum(r["_n"] for r in got) == 3
