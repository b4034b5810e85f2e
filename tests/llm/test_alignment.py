"""Alignment of two tokenizers against whole texts encoded by the libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from weft.llm import alignment

SF = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "  two  spaces ", "tab\t and\r\n lines \n\n x", "é ﬁ Ａ 😀𠀀 ⅧⅨ", "word " * 3000, "x" * 20_000, "don't <|endoftext|> <s> <0x41> we'LL 12³¼", "İstanbul Σας", "mark ▁x", "a b 　 c\x1c d \x00 e f", "日本語のテキスト です", "á ́b", "!!! ??? ..."]


def brute(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(FILES[0])
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    of = alignment.byte_of_char()
    cases = []
    for doc, text in docs:
        a, b, want = ta.encode(" " + (text or ""), add_special_tokens=False).ids, tb.encode(text or ""), (" " + (text or "")).encode()
        da = [bytes(of[c] for c in ta.id_to_token(i)) for i in a]
        db = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(da) != want or b"".join(db) != want:
            cases.append((doc, [], [], [], []))
            continue
        ea, eb = [sum(map(len, da[: i + 1])) for i in range(len(a))] if len(a) < 400 else ends(da), ends(db)
        shared = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for e in shared:
            i2, j2 = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        cases.append((doc, a, b, groups, [(x[-1], y[-1]) for x, y in groups]))
    n = Counter(p for c in cases for p in c[4])
    most = Counter()
    for (_, y), k in n.items():
        most[y] = max(most[y], k)
    out = []
    for doc, a, b, groups, pairs in cases:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(pairs), sum(n[p] == most[p[1]] for p in pairs), sum(n[p] for p in pairs), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST, 0])
def test_alignment_of_odd_texts(spark, broadcast):
    docs = [*enumerate(ODD), (4, "a"), (None, "a word and a word")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, pair int, _row string")
    assert rows(alignment.alignment_of_documents(df, *FILES, broadcast)) == brute(docs)


def test_alignment_of_the_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows(alignment.alignment_of_documents(df, *FILES))
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert all(r[1] for r in got)


def test_empty_table_and_common_ends(spark):
    assert not alignment.alignment_of_documents(spark.createDataFrame([], "doc_id long, text string"), *FILES).collect()
    assert alignment.common_ends([1, 2, 4], [2, 4]) == ([2, 4], [2, 3], [1, 2])


def test_ranks_give_the_same_ids(spark):
    with open(FILES[0]) as f, open(FILES[1], "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    assert aligner.ranks is not None
    assert [aligner.ranks.encode_ordinary(t) for t in texts] == [aligner.a.encode(t, add_special_tokens=False).ids for t in texts]
