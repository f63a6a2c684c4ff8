import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thalweg.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  \t x", "a   b", "It's we'll they'RE 'S", "tabs\t\tand\x0b\x0c\x1c\x85\xa0spaces", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>  ",
    "<|endoftext", "naïve Ünïcödé ß 漢字かな 한국어 العربية עברית", "🙂👩‍👩‍👧 é ​﻿", "x" * 5000, "aaaaaaaa" * 300, " " * 3000 + "end", "0123456789" * 20 + "½Ⅷ², 3.14",
    "՘֋Ᲊ a՘b1⃁", "!!!???...---===" * 30, "lorem ipsum " * 12_000, "\x00\x01�",
]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(open(PATH, encoding="utf-8").read(), bpe.unlike_letters())


def test_every_token_spells_itself(coder):
    for label, token in list(coder.automaton.ids.items()):
        assert coder.automaton.encode(label) == (token,)


def test_random_words(coder, library):
    rng = random.Random(2)
    letters = "abcdeéß ñ'1 9.!\n\t" + chr(0x4E00) + chr(0x1F600)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30)))
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_code_point_splits_alike(coder, library):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(codes), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}" for c in codes[start : start + 4096])
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_against_the_library(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(i + 10_000, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (10_005, "twice")], "doc_id long, text string")
    given = docs.unionByName(odd).withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(0))
    digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    want = []
    for r in given.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.round_trip(given, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
