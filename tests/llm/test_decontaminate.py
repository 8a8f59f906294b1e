"""Benchmark decontamination against brute force."""

import hashlib
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from echotide.llm import decontaminate as D  # noqa: E402
from echotide.llm.common import table  # noqa: E402

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def split(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer((text or "").translate(AZ))]


def brute(docs, items, size=10):
    """(n_words, n_hit, items, spans) of each text."""
    windows = {}
    for item, text in items:
        w = [x[0] for x in split(text)]
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for text in docs:
        w = split(text)
        words, hit, found = [x[0] for x in w], set(), set()
        spans = []
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
                    spans.append((w[i][1], w[i + n - 1][2]))
        merged = []
        for s, e in sorted(spans):
            if merged and s < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        out.append((len(w), len(hit), sorted(str(i) for i in found - {None}), merged))
    return out


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    some = ["one", "Two", "ÜBER", "日本", "x1", "7", "o'clock", "é-è", "THE"]
    say = lambda n: " ".join(rng.choice(some, n))
    items = [(1, say(30)), (2, say(10)), (2, say(11)), (3, "one two"), (4, None), (5, "... !"), (None, say(14)), (7, say(25)), (8, say(25)), (9, "solo")]
    items += [(10, items[0][1]), (11, items[0][1] + " " + say(5))]
    texts = [None, "", "  ", "ONE, two", "one-two", "onetwo", "solo" * 3, "Solo.", items[0][1], items[0][1].upper(), "a " + items[6][1] + " b " + items[7][1], items[1][1] + items[1][1]]
    texts += [f"{say(int(rng.integers(1, 40)))} {items[int(rng.integers(6, 9))][1]} {say(3)}" for _ in range(40)]
    texts += [" ".join([say(300), items[0][1], say(2000)] * 3), "w" * 5000 + " " + items[2][1]]
    return texts, items


def make(spark, texts, items):
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, t, 1, 2, 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, leak int, body int, row int, LEAK_ int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def result(df, leak):
    return sorted(((r["text"] or "", r["doc_id"] or -1, r[leak]["n_words"], r[leak]["n_hit"], r[leak]["items"], [(s["start"], s["end"]) for s in r[leak]["spans"]]) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [10, 3])
def test_both_ways_by_brute_force(spark, odd, size, monkeypatch):
    """With the windows broadcast, and with a filter and a join; parts of texts much shorter than texts."""
    texts, items = odd
    docs, bench = make(spark, texts, items)
    want = sorted(((t or "", (i // 2 if i % 7 else None) or -1, *b) for i, (t, b) in enumerate(zip(texts, brute(texts, items, size)))), key=str)
    assert sum(w[3] > 0 for w in want) > 30
    for most, bits in ((1 << 20, 20), (10, 20), (10, 8)):
        got = D.annotate(docs, bench, "found", size=size, most_bytes=most, filter_bits=bits)
        assert got.columns == [*docs.columns, "found"] and result(got, "found") == want
    joined = "".join(t or "" for t in texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len((t or "").encode()) for t in texts])))
    found = D.Items.of([i for i, _ in items], [(t or "").encode() for _, t in items], size)
    whole = D.occurrences(np.frombuffer(joined, np.uint8), offsets, found)
    for part in (1, 64, 999):
        counts, hits = D.occurrences(np.frombuffer(joined, np.uint8), offsets, found, part)
        assert counts.tolist() == whole[0].tolist()
        assert {tuple(x) for x in np.stack(list(hits.values())).T.tolist()} == {tuple(x) for x in np.stack(list(whole[1].values())).T.tolist()}


def test_equal_hashes_are_verified(odd, monkeypatch):
    """Hashes that say nothing change no result."""
    texts, items = odd
    monkeypatch.setattr(D, "_mixed", lambda x: x & np.uint64(3))
    found = D.Items.of([i and str(i) for i, _ in items], [(t or "").encode() for _, t in items])
    for text, want in zip(texts[:30], brute(texts[:30], items)):
        data = np.frombuffer((text or "").encode(), np.uint8)
        (leak,) = D._leaks(data, np.array([0, len(data)]), found)
        assert (leak["n_words"], leak["n_hit"], leak["items"], [(s["start"], s["end"]) for s in leak["spans"]]) == want


def test_cut_and_drop(spark, odd):
    texts, items = odd
    docs, bench = make(spark, texts, items)
    want = []
    for t, (_, _, _, spans) in zip(texts, brute(texts, items)):
        for s, e in reversed(spans):
            t = t[:s] + "#" + t[e:]
        want.append(t)
    got = D.cut_spans(docs, bench, "#")
    assert got.columns == docs.columns and sorted((r["text"] for r in got.collect()), key=str) == sorted(want, key=str)
    assert sorted((r["text"] for r in D.drop_documents(docs, bench).collect()), key=str) == sorted((t for t, b in zip(texts, brute(texts, items)) if not b[1]), key=str)
    for empty in (docs.limit(0), docs):
        assert D.annotate(empty, bench.limit(0), "found", most_bytes=-1 if empty is docs else 0).where("found.n_hit > 0" if empty is docs else "true").count() == 0

    with pytest.raises(ValueError, match="already"):
        D.annotate(docs, bench)


def test_query(spark, sf_dir):
    from echotide.llm.queries import QUERIES

    docs, items = ([tuple(r) for r in table(spark, sf_dir, n).select(i, "text").collect()] for n, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = {i: (n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for (i, _), (n, h, x, _) in zip(docs, brute([t for _, t in docs], items))}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_decontaminate"](spark, sf_dir).collect()}
    assert got == want and any(w[4] for w in want.values())
