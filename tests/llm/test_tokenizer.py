"""The byte-pair encoder against a public library and by round trip."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import tokenizer

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer.DEFAULT_VOCABULARY, "rb") as file:
        return tokenizer.BytePairEncoder.from_lines(file.read())


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(tokenizer.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    made.encode_special_tokens = True
    return made


def texts():
    random.seed(5)
    letters = [chr(random.choice([random.randrange(32, 127), random.randrange(0x80, 0x3000), random.randrange(0x4E00, 0x9FFF), 0x1F680, 0x85, 0xA0, 0x200B, 0x301])) for _ in range(300)]
    made = ["".join(random.choice(letters) for _ in range(random.randrange(1, 50))) for _ in range(1500)]
    return [*made, " ", "\r\n\r\n  x", "<|endoftext|>", "a" * 4000, "=" * 3000, "ab" * 2000, "don't we'll I'M", "\x00\x1c\x1f"]


def test_ids_equal_the_library(encoder, library):
    for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert encoder.encode(text) == want.ids, text


def test_round_trip_and_count(encoder):
    for text in texts():
        ids = encoder.encode(text)
        assert encoder.decode(ids) == text
        assert encoder.count(text) == len(ids)


def test_compatible_pairs_are_what_the_merges_say(encoder):
    word = " internationalization"
    assert encoder._encode_piece(word) == tuple(encoder.merge(word.encode()))


def test_null_empty_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids_", F.lit(1))
    got = df.select("doc_id", tokenizer.token_ids(spark, F.col("text")).alias("ids"), tokenizer.token_count(spark, F.col("text")).alias("n")).collect()
    assert [(r.doc_id, r.ids, r.n) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, [], 0), (2, [], 0), (3, [15496, 995], 2), (3, [15496, 995], 2)]
    assert df.limit(0).select(tokenizer.token_ids(spark, F.col("text"))).collect() == []
