"""The audit of filters against brute force."""

import re
from itertools import permutations

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from echotide.llm import filter_audit as A  # noqa: E402
from echotide.llm.common import table  # noqa: E402


def fails(docs):
    """Letters that each row (doc_id, part, text) fails."""
    out = []
    for i, _, text in docs:
        text = text or ""
        w = [x for x in re.split("[ \t-\r]+", text) if x]
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        out.append(bad + "E" * any((t or "") == text and None not in (i, j) and j < i for j, _, t in docs))
    return out


def brute(docs, labels, names="ABCDE"):
    """All rows of the audit, one filter after another over the documents themselves."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    bad, out = fails(docs), {}
    for part in {p or "" for _, p, _ in docs}:
        mine = [(i, b) for (i, p, _), b in zip(docs, bad) if (p or "") == part]
        for order in permutations(names):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone, stay = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                out[part, "".join(order), step] = [len(stay), len(gone), sum(f in b for _, b in mine) - len(gone), sum(b == f for _, b in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                left = stay
    for (part, order, step), row in out.items():
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


ROWS = [
    (1, "en", None), (2, None, ""), (3, "", " \t"), (4, "en", "a b " * 120), (5, "en", " ".join(map(str, range(200)))), (6, "de", " ".join(map(str, range(200)))), (6, "fr", " ".join(map(str, range(200)))),
    (4, "en", "a b " * 120), (4, "de", "a b " * 120), (None, "en", "a b " * 120), (None, "en", "x"), (7, "en", "x"), (8, "en", "X"), (9, "de", "É日本 " * 100 + " ".join(f"w{i}" for i in range(150)) + " 5%"), (10, "de", "ABC " * 10 + "d" * 2000),
    (11, "fr", "a\x1cb\x85c\xa0d e" * 150), (12, "fr", "a\x0bb\x0cc\rd " * 60),
]
LABELS = [(1, 1, 0), (4, 1, None), (4, 0, 1), (7, None, 1), (99, 1, 1), (None, 1, 1), (5, 1, 0), (6, 0, 1)]


def make(spark, rows=ROWS):
    docs = spark.createDataFrame([(i, p, t, 1, 2, 3, 4, 5) for i, p, t in rows], "doc_id long, lang string, text string, part int, fails int, digest int, first int, n int")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_by_brute_force(spark):
    docs, labels = make(spark)
    want = brute(ROWS, LABELS)
    assert got(A.audit(A.labelled(A.failures(docs), labels), "ABCDE")) == want and len(want) == 600 * 4
    assert {f for b in fails(ROWS) for f in b} == set("ABCDE")
    assert A.audit(A.labelled(A.failures(docs.limit(0)), labels.limit(0)), "ABCDE").count() == 0
    assert len(got(A.audit(A.labelled(A.failures(docs), labels.limit(0)), "ABCDE"))) == len(want)


def test_other_filters(spark):
    """Filters of one's own, fewer of them; names must differ."""
    docs, labels = make(spark)
    rows = A.labelled(A.failures(docs, {"X": F.length("text") > 100}), labels)
    assert A.edges(rows, "XE").count() == 4 * 4 and A.audit(rows, "XE").count() == 4 * 2 * 2
    with pytest.raises(ValueError):
        A.orders("AAB")
    with pytest.raises(ValueError):
        A.orders("ABCDEFGH")
    assert len(A.orders("ABCDE")) == 600 and len({(s, f) for _, _, s, f in A.orders("ABCDE")}) == 80


def test_query(spark, sf_dir):
    from echotide.llm.queries import QUERIES

    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "lang", "text").collect()]
    labels = [tuple(r) for r in table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").collect()]
    assert got(QUERIES["op12_filter_audit"](spark, sf_dir)) == brute(docs, labels)
