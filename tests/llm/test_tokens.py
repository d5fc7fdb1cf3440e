import random

import pytest

from capsidora.llm import tokens

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k"
PARTS = ["a", "the", " ", "\n", "ing", "é", "ß", "😀", "0", "12", "!", "'s", "‍", "世界", "\t", "xx", "<|endoftext|>", "﻿", "A", "tion"]


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(f"{VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_and_round_trip(plain, monkeypatch):
    bpe = tokens.ByteBpe(tokens.read_ranks(f"{VOCABULARY}.tiktoken"))
    rnd = random.Random(2)
    texts = ["", " ", "a" * 3000, "ab" * 1500, *("".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 60))) for _ in range(1500))]
    for t in texts:
        assert bpe.encode(t) == plain(t) and "".join(bpe.decode(bpe.encode(t))) == t
    monkeypatch.setattr(tokens, "MOST_STATES", 200)
    monkeypatch.setattr(tokens, "MOST_WORDS", 50)
    monkeypatch.setattr(tokens, "STRETCH", 16)
    for t in texts[:300]:
        assert bpe.encode(t) == plain(t)
    long = "".join(rnd.choice("abcdefgh") for _ in range(20000))
    assert bpe.encode(long) == plain(long)
    assert "".join(bpe.decode([bpe.transducer.ranks[b"\xf0"], bpe.transducer.ranks[b"a"]])) == "�a"


def test_tables(spark, plain):
    rows = [(1, "Capsid 12, über"), (2, ""), (3, None), (4, " \n"), (4, " \n"), (None, "x"), (6, "word " * 50000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'y' as ids", "0 as d")
    got = tokens.byte_bpe_ids(df)
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == sorted((i or 0, plain(t or "")) for i, t in rows)
    back = {r.doc_id: r.text for r in tokens.byte_bpe_text(got).collect()}
    assert back[1] == rows[0][1] and back[3] == "" and back[6] == rows[6][1]
    assert tokens.byte_bpe_ids(df.limit(0)).count() == 0
