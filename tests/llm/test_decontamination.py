"""Benchmark windows in documents: brute force, blocks, odd rows, removal."""

import hashlib
import re

import pytest

from weft.llm import decontamination as dc

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, item_id string, _hits int"


def brute(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def cases():
    long = " ".join(f"w{i}" for i in range(14))
    items = [(1, long), (2, long.upper() + " tail"), (10, "Short item"), (None, "nameless one"), (5, None), (6, ""), (7, "..."), (3, "été 12 straße"), (3, "été 12 straße"), (8, " ".join(["same"] * 12))]
    docs = [(0, None), (1, ""), (2, "-- !"), (3, f"before {long} after"), (4, long.replace(" ", ", ")), (5, "a SHORT  item, short-item"), (6, "nameless one"), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (8, "Été 12 Straße été 12 straße"), (9, "x " * 50_000 + long), (3, "repeated row"), (None, long), (11, "same " * 30), (12, "İ" + long)]
    return docs, items


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [dc.BLOCK, 4])
def test_hits_equal_brute_force(spark, cases, block, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", block)
    docs, items = cases
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], KIND)
    b = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    assert rows(dc.hits_of_documents(d, b)) == brute(docs, items)


def test_hits_of_the_given_documents(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(dc.hits_of_documents(d, b))
    assert got == brute([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.select("item_id", "text").collect()])
    assert 0 < sum(r[5] for r in got) < len(got)


def test_empty_tables(spark, cases):
    d, b = spark.createDataFrame(cases[0], "doc_id long, text string"), spark.createDataFrame(cases[1], "item_id long, text string")
    assert not dc.hits_of_documents(d.limit(0), b).collect()
    assert not any(r.contaminated for r in dc.hits_of_documents(d, b.limit(0)).collect())


def test_spans_and_documents_are_removed(spark, cases):
    docs, items = cases
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], KIND)
    b = spark.createDataFrame(items, "item_id long, text string")
    clean = dc.decontaminated(d, b)
    assert clean.columns == ["doc_id", "text", "item_id"]
    left = {(r.doc_id, r.text) for r in clean.collect()}
    assert {(3, "before after"), (3, "repeated row"), (5, "a "), (0, None), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (11, "")} <= left
    assert not any(r.contaminated for r in dc.hits_of_documents(clean, b).collect())
    kept = [r.doc_id for r in dc.decontaminated(d, b, "documents").collect()]
    assert sorted(kept) == [0, 1, 2, 3, 7]
    with pytest.raises(ValueError, match="spans or documents"):
        dc.decontaminated(d, b, "lines")
