"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

import os

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    out = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    columns = stages["documents"].columns
    assert all(stages[n].columns == columns for n in ("quality", "language", "near_copies", "leaks"))


def test_rejected_documents_are_those_labelled_bad(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(stages["quality"])
    assert all(i in kept for i, q in labels.items() if q == 1)
    bad = [i for i, q in labels.items() if q == 0]
    # 200 documents teach little; what goes must be bad (test_ops holds accuracy on more)
    assert any(i not in kept for i in bad)
    assert texts(stages["language"]) == kept


def test_near_copies_keep_one_of_each_component(stages):
    from .test_ops import plain_components

    before = texts(stages["language"])
    want, _ = plain_components(list(before.items()))
    assert texts(stages["near_copies"]) == {i: before[i] for i in set(want.values())}


def test_junk_with_letters_has_no_language(spark, stages):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    clean = [tuple(r) for r in stages["quality"].select("doc_id", "text", "lang").collect()]
    digits = ["12 a 99 -- 4x7 ## 0k 3 %% 77 z 1", "#!@ 93 8 q 02 -+ 1 vx zq 7 kj 3 wq"] * 3
    letters = [" ".join("".join(rng.choice(list("qxzjkvw"), 4)) for _ in range(n)) for n in (5, 50, 500)]
    junk = [(1_000_000 + i, t, None) for i, t in enumerate(digits + letters)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = texts(corpus_pipeline.language_stage(spark, docs, SF))
    assert kept == {i: t for i, t, _ in clean}


def test_different_texts_of_one_id_stay(spark):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (7, a + " end"), (7, b), (8, c), (8, d), (8, d), (9, c + " end"), (9, e), (4, e), (3, d + " end"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_copies_stage(spark, docs, SF).select("doc_id", "text").collect()
    want = {(1, a), (7, b), (8, c), (4, e), (3, d + " end"), (None, a)}
    assert len(kept) == len(want) and {tuple(r) for r in kept} == want


def test_leaks_go_and_nothing_else(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages["near_copies"]), texts(stages["leaks"])
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    held = [" " + plain(t) + " " for t in items]
    leaks = {i for i, t in before.items() if any(h in " " + plain(t) + " " for h in held)}
    assert leaks.isdisjoint(after) and set(before) - leaks == set(after)


def test_packing_holds_every_token(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = stages["packing"].toPandas()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = texts(stages["leaks"])
    sizes = got.groupby("doc_id")["length"].sum()
    assert set(sizes.index) == set(docs)
    assert all(sizes[i] == len(whole.encode(docs[i], add_special_tokens=False).ids) + 1 for i in list(docs)[:60])
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *np.cumsum(x["length"])[:-1].tolist()] and x["length"].sum() <= 4096


def test_odd_documents_pass(spark):
    """Nulls, empty texts, repeated rows and columns with clashing names."""
    import corpus_pipeline

    rows = [(1, None, "en", 0.1, "p"), (2, "", "en", 0.2, "q"), (3, "plain words of a text here", None, 0.3, "r"), (3, "plain words of a text here", None, 0.3, "r"), (None, "plain words of a text here", "en", 0.5, "s"), (4, "x " * 20_000, "en", 0.5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.where("doc_id = 3").count() == 1 and docs.where("doc_id is null").count() == 1 and docs.where("doc_id = 1").count() == 0
    empty = spark.createDataFrame([], docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string").schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
