import random

import numpy as np
import pytest

from tabseg.llm.tokens import VOCABULARIES, Encoder, decode_corpus, encode_corpus, token_offsets, token_sizes

tiktoken = pytest.importorskip("tiktoken")
#: Fixed value: the pre-tokenisation pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def pair():
    e = Encoder(VOCABULARIES)
    return e, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=e.ranks, special_tokens={})


def check(pair, texts):
    e, ref = pair
    ids, counts = e.encode(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ref.encode_ordinary(t or ""), repr(t)[:200]
    assert e.sizes(texts).tolist() == counts.tolist()
    assert b"".join(next(k for k, v in [(ref.decode_single_token_bytes(int(x)), 0)]) for x in ids[: at[1]]) == (texts[0] or "").encode()


def test_random_texts(pair):
    rng = random.Random(1)
    alphabet = ["'", "s", "t", "re", "ll", "'d", " ", "  ", "\n", "\t", "a", "B", "9", "é", "漢", " ", "　", "!", "?", "\x00", "😀", "́", " ", "\x85", "\x1c", "½", "<|endoftext|>", "﻿"]
    check(pair, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)])


def test_long_empty_and_null(pair):
    check(pair, ["x" * 300_000 + " y's " + "ab1 " * 50_000, "", None, " ", "\n\n", "'s", "a's", "A'S"])


def test_cache_is_bounded(pair, monkeypatch):
    import tabseg.llm.tokens as m

    monkeypatch.setattr(m, "CACHE", 10)
    check(pair, [f"word{i} other{i}" for i in range(300)])


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect())
    assert got == [(1, [15496, 995]), (2, []), (3, []), (3, [])]
    assert sorted((r["doc_id"], r["tokens"]) for r in token_sizes(df, ["doc_id"]).collect()) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert encode_corpus(df.limit(0)).count() == 0


def test_round_trip_and_offsets(spark):
    texts = ["Hello  world's ½ 漢字 😀\n\n x", "", None, "a" * 500 + " b", "tab\tline\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = encode_corpus(df)
    back = {r["doc_id"]: r["text"] for r in decode_corpus(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    sizes, e = {r["doc_id"]: r["ids"] for r in ids.collect()}, Encoder(VOCABULARIES)
    for r in token_offsets(df).collect():
        text, at, own = texts[r["doc_id"]] or "", r["starts"], sizes[r["doc_id"]]
        assert len(at) == len(own) and at == sorted(at)
        for i, start in enumerate(at):  # the ids from a piece's start to the next one are the piece
            if not i or at[i - 1] != start:
                stop = next((x for x in at[i:] if x != start), len(text))
                assert e.decode(own[i : i + at.count(start)]) == text[start:stop]
