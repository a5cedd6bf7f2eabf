import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallywind.llm import bpe
from tallywind.llm.bpe import BYTE_BPE_50K, Encoder, Vocabulary, count_tokens, encode_corpus

pytestmark = pytest.mark.skipif(not Path(BYTE_BPE_50K).exists(), reason="no vocabulary files")

EDGE = ["", " ", "   a", "\n\n", "a\n b", "don'tx", "'s", " 's", "x''s", "I'll've", "'LL 're're", "\t\tx", " \t x", "x \n", "12ab é", "<|endoftext|>", "a" * 27, "'", "' ", "日本語 テスト", "👍🏽👍", "\xa0x", "\x1cx \x1f\x85a", "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace")]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE_50K)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ids(encoder, texts):
    flat, at = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_against_the_tokenizer(reference):
    rng = random.Random(1)
    encoder = Encoder(Vocabulary.load(BYTE_BPE_50K))
    texts = [*EDGE, *["".join(rng.choice("ab 's\n\t é1.'tlvrem日") for _ in range(rng.randint(0, 60))) for _ in range(5000)], "word " * 200_000]
    assert ids(encoder, texts) == reference(texts)
    assert ids(encoder, ["ab", "don't"]) == reference(["ab", "don't"])  # known words
    assert ids(encoder, []) == []


def test_blocks_do_not_matter(monkeypatch, reference):
    monkeypatch.setattr(bpe, "_CHUNK_CHARS", 50)
    monkeypatch.setattr(bpe, "_CACHE_WORDS", 20)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    encoder = Encoder(Vocabulary.load(BYTE_BPE_50K))
    for lo in range(0, 300, 40):
        assert ids(encoder, texts[lo : lo + 40]) == reference(texts[lo : lo + 40])


def test_corpus(spark, reference):
    data = [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (None, "x"), (4, "y" * 200_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("extra")).withColumn("out", F.lit(1))
    got = [(r.doc_id, r.ids) for r in encode_corpus(df).collect()]
    assert got == [(i, reference([t or ""])[0]) for i, t in data]
    assert [(r.doc_id, r.tokens) for r in count_tokens(df).collect()] == [(i, len(x)) for i, x in got]
    assert dict(encode_corpus(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert encode_corpus(df.limit(0)).count() == 0
