import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thalweg.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(open(PATH, encoding="utf-8").read(), bpe.unlike_letters())


def test_random_edits(coder, library, monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 4)
    rng = random.Random(11)
    letters = "abc de  fg\n\n\t'sé!漢🙂12 "
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(200)))
        tree = token_counts.Tree(*token_counts.measure(text, coder))
        for _ in range(12):
            start = rng.randrange(len(text) + 3)
            stop = start + rng.choice((0, 0, 1, 2, 5, 40))
            new = "".join(rng.choice(letters) for _ in range(rng.choice((0, 0, 1, 3, 30))))
            want = text[: min(start, len(text))] + new + text[min(stop, len(text)) :]
            text = token_counts.edit(text, tree, start, stop, new, coder, token_counts.Work())
            assert text == want and tree.chars == len(text)
            assert tree.tokens == len(library.encode(text, add_special_tokens=False).ids)


def test_an_edit_of_a_long_text_is_local(coder, library):
    text = "some words and more of them, again. " * 20_000
    tree = token_counts.Tree(*token_counts.measure(text, coder))
    work = token_counts.Work()
    text = token_counts.edit(text, tree, 300_000, 300_004, "changed", coder, work)
    assert tree.tokens == len(library.encode(text, add_special_tokens=False).ids)
    assert work.pretokens <= 4 * token_counts.LEAF


def test_against_the_library(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = [(10_001, None), (10_002, ""), (None, "no id"), (10_003, "twice"), (10_003, "twice"), (10_004, "x" * 150_000), (10_005, " " * 1000), (10_006, "a <|endoftext|> b")]
    given = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("edits", F.lit("clash")).withColumn("leaf_chars", F.lit(1))
    plain = given.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edits = plain.withColumn("edits", token_counts.review_edits(F.char_length("text"), F.coalesce("doc_id", F.lit(-1)))).collect()
    want = []
    for r in edits:
        text = r.text
        for e in r.edits:
            start, stop = min(e.start, len(text)), min(e.stop, len(text))
            text = text[:start] + e.text + text[stop:]
        n = [len(library.encode(t, add_special_tokens=False).ids) for t in (r.text, text)]
        want.append((r.doc_id, n[0], 4, n[1], len(text)))
    got = [tuple(r)[:5] for r in token_counts.edited_counts(given, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    index = token_counts.indexed(plain, PATH)
    kept = index.withColumn("edits", token_counts.review_edits(F.char_length("text"), F.coalesce("doc_id", F.lit(-1))))
    assert sorted((tuple(r)[:5] for r in token_counts.recounted(kept, PATH).collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert token_counts.edited_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
