"""The pipeline's rows against the stages done one by one in plain Python."""

import math

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from phenogrid.llm import byte_bpe, pii, toxicity
from tests_llm_plain import plain_hits, plain_kept


def plain_score(model, text):
    words = toxicity.words_of(text)
    value = 0.0
    for w in words:
        s = "^" * (model.order - 1) + w + "$"
        for i in range(len(s) - model.order + 1):
            g = s[i:i + model.order]
            value += model.grams.get(g, model.contexts.get(g[:-1], 0.0))
    z = model.slope * (value / len(words) if words else 0.0) + model.offset
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def redacted(text):
    out, at, free = "", 0, 0
    for kind, s, e, _ in pii.spans_of(text):
        if s >= free:
            out += text[at:s] + f"[{kind.upper()}]"
        at = free = max(free, e)
    return out + text[at:]


def test_rows(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    kept = {i: r["text"] for i, r in rows.items() if plain_score(model, r["text"]) < 0.5}
    kept = {i: kept[i] for i in plain_kept(list(kept.items()))}
    kept = {i: redacted(t) for i, t in kept.items() if not plain_hits(t, items)[1]}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "token_ids", "n_tokens", "decoded_text"]
    got = {r["doc_id"]: r for r in got.collect()}
    assert set(got) == set(kept) and 0 < len(kept) < len(rows)
    for i, t in kept.items():
        assert (got[i]["text"], got[i]["n_chars"], got[i]["lang"], got[i]["source"]) == (t, len(t), rows[i]["lang"], rows[i]["source"])
        assert got[i]["token_ids"] == plain.encode_ordinary(t) and got[i]["n_tokens"] == len(got[i]["token_ids"]) and got[i]["decoded_text"] == t


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_and_take_odd_rows(spark, sf, stage):
    name, apply = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(
        [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "clean words that nobody minds", "en", "s", 29), (None, "a row without an id", "en", "s", 19),
         (5, "w " * 100_000, "en", "s", 200_000)], "doc_id long, text string, lang string, source string, n_chars long")
    out = apply(spark, docs, sf)
    assert out.columns[:5] == docs.columns and (stage == 4 or out.columns == docs.columns)
    rows = {r["doc_id"] for r in out.collect()}
    assert {3, None, 5} <= rows and rows <= {1, 2, 3, None, 5}
    assert apply(spark, docs.limit(0), sf).collect() == []
