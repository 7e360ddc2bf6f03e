"""The pipeline against its operators in plain Python, and the registration of all queries."""

import hashlib
import math

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from feedloom.llm.common import store
from feedloom.llm.queries import vocabulary
from tests.llm.test_dedup import expected_components
from tests.llm.test_text_operators import base_measures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], SF), name))
    return out


def test_every_stage_does_its_work(stages):
    raw, good, single, near, mixed, tokens = stages
    assert all(s.columns == raw.columns for s in stages[:-1])
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in (raw, good))
    assert after.keys() <= before.keys() and all(not base_measures(t)[-1] for t in after.values())
    assert len(after) > 0.7 * len(before)

    best = {}
    for i, t in after.items():
        key = t.encode().lower()
        best[key] = max(i, best.get(key, -1))
    assert {r.doc_id for r in single.collect()} == set(best.values())

    rows = [(r.doc_id, r.text) for r in single.collect()]
    want = {i for i, (_, c) in expected_components(rows, 5).items() if i == c}
    kept = near.collect()
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)

    drawn = mixed.collect()
    assert {r.doc_id for r in drawn} == want
    sizes, share = {}, {}
    for r in kept:
        sizes[r.source] = sizes.get(r.source, 0) + math.ceil(len(r.text.encode()) / 4)
    for r in drawn:
        share[r.source] = share.get(r.source, 0) + math.ceil(len(r.text.encode()) / 4)
    assert all(share[s] >= sizes[s] for s in sizes)

    words = vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    encoded = tokens.collect()
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in drawn)
    texts = {r.doc_id: r.text for r in drawn}
    for r in encoded:
        assert list(r.tokens) == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.tokens)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, stages[-1].select("doc_id", "ids_sha256").collect()))


def test_stages_take_nulls_repeats_and_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i} of the text" for i in range(30)) + "."
    rows = [(None, None, None, None, None), (1, None, "en", None, None), (2, "", "en", "s", 0), (3, text, None, None, None), (3, text, None, None, None), (4, text.upper(), "en", "s", 1), (None, "own " + text + " end here", None, None, 3)]
    for frame, least in ((spark.createDataFrame(rows, schema), 1), (spark.createDataFrame([], schema), 0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, SF), name)
        assert docs.count() >= least


def test_all_operators_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_core_does_not_need_the_package(monkeypatch):
    """Without the package its queries are missing and everything else is there; an error inside it is not swallowed."""
    import builtins

    real = builtins.__import__

    def gone(name, *args, **kw):
        if name.startswith("feedloom.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", gone)
    assert "theme_summary" in entry.queries() and not any(n.startswith("op1_") for n in entry.queries())

    def broken(name, *args, **kw):
        if name.startswith("feedloom.llm"):
            raise ModuleNotFoundError("No module named 'tiktoken'", name="tiktoken")
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
