"""Every query of the package on the driver's smallest tables: against its DuckDB SQL, or plain Python."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkshards.llm import queries  # noqa: E402

from .test_ops import judged  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "benchmark", "labels"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return {i: (t, lang) for i, t, lang in duck.sql("select doc_id, text, lang from documents").fetchall()}


def canonical(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(repr([int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in rows.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    assert canonical(queries.QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(queries.ORACLE_SQL[name]).df())


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_op1_pack(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op1_pack(spark, SF).toPandas()
    want = Counter()
    for i, (t, _) in docs.items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, at in enumerate(range(0, len(ids), 4096)):
            want[i, p, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *np.cumsum(x["length"])[:-1].tolist()] and x["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 4096 + 1


def test_op3_urlfilter(spark, duck):
    urls = dict(duck.sql("select page_id, url from pages").fetchall())
    got = queries.op3_urlfilter(spark, SF).collect()
    assert Counter(r["page_id"] for r in got) == Counter(list(urls))
    for r in got:
        host, path, rule, verdict = judged(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ((verdict,) if verdict else ("allow", "block"))


def test_op4_decontaminate(spark, duck, docs):
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) + " "
    items = [(i, plain(t)) for i, t in duck.sql("select item_id, text from benchmark").fetchall()]
    want = {(d, i) for d, (t, _) in docs.items() for own in [plain(t)] for i, x in items if x in own}
    got = queries.op4_decontaminate(spark, SF).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in got} and all(r["score"] >= 0.7 - 1e-9 for r in got)


def test_op5_langid(spark, docs):
    got = queries.op5_langid(spark, SF).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: fold(i, 4) == 2 for i in docs} and len(got) == len(docs)
    known = [r for r in got if r["held_out"] and docs[r["doc_id"]][1]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]][1] for r in known) >= 0.95 * len(known)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op7_quality(spark, docs):
    got = queries.op7_quality(spark, SF).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: fold(i, 5) == 0 for i in docs} and len(got) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_op9_tokencounts(spark, docs):
    from sparkshards.llm import tokencounts

    encode = tokencounts.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encoding
    got = queries.op9_tokencounts(spark, SF).toPandas()
    sums = got.groupby("doc_id")["tokens"].sum()
    lines = got.groupby("doc_id").size()
    for i, (t, _) in docs.items():
        if t:
            assert sums[i] == len(encode.encode_ordinary(t)) and lines[i] == len(re.findall(r"[^\n]*\n|[^\n]+$", t))
