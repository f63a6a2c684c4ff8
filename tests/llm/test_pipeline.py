import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontamination import held
from tests.llm.test_simhash import brute
from thalweg.llm import decontamination, secrets, toxicity


def test_stages_against_brute_force(spark, folder):
    docs = given = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "tokens":
            assert docs.columns == given.columns and docs.dtypes == given.dtypes
        steps[name] = {r.doc_id: r for r in docs.collect()}
        assert len(steps[name]) == docs.count()
    rejected = {r.doc_id for r in toxicity.toxicity(given, labels).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in given.collect()}
    assert set(steps["toxicity"]) == set(texts) - rejected
    kept = {i for i, _, c in brute([(i, texts[i]) for i in steps["toxicity"]]) if i == c}
    assert set(steps["near_duplicates"]) == kept
    tests = [decontamination.words_of(r.text) for r in items.collect()]
    leaking = {i for i in kept if any(held(decontamination.words_of(texts[i]), t) for t in tests)}
    assert leaking and set(steps["decontamination"]) == kept - leaking
    assert set(steps["secrets"]) == set(steps["decontamination"])
    for i, r in steps["secrets"].items():
        assert r.n_chars == len(r.text) and (r.text == texts[i] or secrets.MASK in r.text)
    left = spark.createDataFrame([(i, r.text) for i, r in steps["secrets"].items()], "doc_id long, text string")
    assert not any(r.n_assign or r.n_access or r.n_hex for r in secrets.scan(left).collect())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(steps["tokens"]) == set(steps["secrets"])
    for i, r in steps["tokens"].items():
        ids = library.encode(steps["secrets"][i].text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run_and_odd_rows(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "alone without an id", "en", "src0", 3), (90_001, "", "en", None, 0), (90_002, None, None, "src0", None)], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert None in got and len({90_001, 90_002} & got) <= 1
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture(scope="module", autouse=True)
def _stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
