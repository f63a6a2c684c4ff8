"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    bpe,
    decontamination,
    licenses,
    neighbours,
    oracles,
    pii,
    resampling,
    secrets,
    sharding,
    simhash,
    token_counts,
    toxicity,
    url_filters,
    whitening,
)
from .common import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op1_simhash")
def op1(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op2_secrets", oracles.secret_spans())
def op2(spark, folder):
    return secrets.scan(table(spark, folder, "documents"))


def vocabulary(name="byte_bpe_50k.json"):
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_bpe")
def op3(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary())


@query("op4_toxicity")
def op4(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_token_counts")
def op5(spark, folder):
    return token_counts.edited_counts(table(spark, folder, "documents"), vocabulary())


@query("op6_licenses", oracles.notices())
def op6(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query("op7_rendezvous", oracles.rendezvous())
def op7(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op8_decontamination")
def op8(spark, folder):
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_neighbours")
def op9(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query("op10_pii")
def op10(spark, folder):
    return pii.personal_data(table(spark, folder, "documents"))


@query("op11_url_filters", oracles.url_verdicts())
def op11(spark, folder):
    return url_filters.judge(table(spark, folder, "pages"))


@query("op12_resampling", oracles.resampled())
def op12(spark, folder):
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_whitening")
def op13(spark, folder):
    return whitening.whitened_rows(table(spark, folder, "embeddings"))
