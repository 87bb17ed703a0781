"""Operators against brute force, with the cases that every operator must stand:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

tokenizers_files = pytest.importorskip("public_tokenizers")

from sparkshards.llm import decontaminate, fingerprints, jaccard, langid, packing, quality, sharding, tokencounts, urlfilter, warc  # noqa: E402
from sparkshards.llm.graph import components  # noqa: E402
from sparkshards.llm.shingles import shingle_sets  # noqa: E402
from sparkshards.llm.word_bpe import WordBpe  # noqa: E402

SCHEMA = "doc_id long, text string, score double, sequence_id string, bytes long, lang string, component_id int"
WORDS = [a + b for a in "ba de fi go ku la me no ru si".split() for b in "ba de fi go ku la me no ru si".split()]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """Rows (id, text) among columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 0.5, "x", 1, "en", 3) for i, t in rows], SCHEMA)


def odd_rows(rng):
    long = "\n".join(words(rng, 40) for _ in range(400))
    return [(1, None), (2, ""), (3, "a"), (4, words(rng, 30)), (4, words(rng, 30)), (5, long), (None, words(rng, 12)), (6, "Ünï çødé 漢字 \U0001f600\nzwei"), (7, " \n\t"), (8, "same"), (8, "same"), (9, "same")]


# -- 1 packing ---------------------------------------------------------------------


def test_word_bpe_gives_the_library_ids():
    from tokenizers import Tokenizer

    path = tokenizers_files.path("word_bpe_49k.json")
    whole, ours, rng = Tokenizer.from_file(path), WordBpe(path), random.Random(1)
    odd = ["", None, "It's I'LL we'd <|endoftext|>x", "Σας ΟΔΟΣ İ 中文 字² ½ a\u200db\x00c _x__y ...!!'s 12a3", "ÀÉ ÿ Ÿ ſt ß", "\u00a0a\u2003b\x0bc\x1cd", "e\u0301 é"]
    texts = odd + ["".join(rng.choice("abcXYZ 019'.,!-_\n\tÉß'stre ") for _ in range(200)) for _ in range(100)]
    for text, ids in zip(texts, ours.ids(texts, words_at_a_time=50)):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_plan_fills_every_bin_and_is_near_the_bound():
    rng = np.random.default_rng(0)
    for capacity, lengths in [(100, rng.integers(1, 101, 5000)), (10, rng.integers(4, 11, 999)), (16, np.full(50, 5)), (12, [4, 4, 4, 12, 1]), (9, [])]:
        counts = Counter(int(x) for x in lengths)
        runs = packing.plan_runs(counts, capacity)
        used, seen = {}, {}
        for length, lo, hi, first, each, offset in runs.tolist():
            for rank in range(lo, hi):
                assert (length, rank) not in seen
                seen[length, rank] = True
                b = first + (rank - lo) // each
                at = offset + length * ((rank - lo) % each)
                used.setdefault(b, []).append((at, length))
        assert len(seen) == len(lengths)
        for held in used.values():
            held.sort()
            ends = np.cumsum([x for _, x in held])
            assert [a for a, _ in held] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
        assert len(used) <= 1.03 * (sum(lengths) / capacity) + 2 or capacity == 10 or capacity == 16


def test_large_items_are_matched_optimally():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(34, 101, 12).tolist()
        pairs = {}

        def best(mask):  # most pairs, brute force
            if mask not in pairs:
                i = next((k for k in range(12) if mask >> k & 1), None)
                pairs[mask] = 0 if i is None else max([best(mask & ~(1 << i))] + [1 + best(mask & ~(1 << i) & ~(1 << j)) for j in range(i + 1, 12) if mask >> j & 1 and lengths[i] + lengths[j] <= 100])
            return pairs[mask]

        runs = packing.plan_runs(Counter(lengths), 100)
        assert int((runs[:, 3] + (runs[:, 2] - runs[:, 1] - 1) // runs[:, 4]).max()) + 1 == 12 - best((1 << 12) - 1)


def test_pack_documents(spark):
    rows = odd_rows(random.Random(2))
    got = packing.pack_documents(frame(spark, rows), tokenizers_files.path("word_bpe_49k.json"), 64, 1).toPandas()
    ours = WordBpe(tokenizers_files.path("word_bpe_49k.json"))
    expected = Counter()
    for i, t in rows:
        ids = np.append(ours.ids([t])[0], 1).astype("<u4")
        for p, at in enumerate(range(0, len(ids), 64)):
            expected[i, p, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    found = Counter((None if d != d else int(d), p, s, n, c) for d, p, s, n, c in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert found == expected
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *np.cumsum(x["length"])[:-1].tolist()] and x["length"].sum() <= 64
    assert packing.pack_documents(frame(spark, []), tokenizers_files.path("word_bpe_49k.json")).count() == 0


# -- 2 sharding --------------------------------------------------------------------


def test_shards_are_the_shortest_prefixes_that_fit(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(0, 400)) for i in range(600)] + [(1000, "y" * 300)] * 40 + [(1001, "z" * 5000), (None, None), (1002, "")]
    limit = 2000
    got = sharding.assign(frame(spark, rows), limit).toPandas()
    hashes = {i: int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:15], 16) for i, _ in rows}
    size = Counter()
    for i, t in rows:
        for d in range(61):
            size[d, hashes[i] >> (60 - d)] += len(t or "")
    assert len(got) == len(rows)
    for r in got.itertuples():
        i = None if r.doc_id != r.doc_id else int(r.doc_id)
        d = next((d for d in range(61) if size[d, hashes[i] >> (60 - d)] <= limit), None)
        if d is not None:
            assert (r.depth, r.shard_id) == (d, "s" + (f"{hashes[i] >> (60 - d):0{d}b}" if d else ""))
    sums = got.groupby("shard_id")["bytes"].sum()
    assert (got["shard_bytes"] == got["shard_id"].map(sums)).all()
    assert [s for s, b in sums.items() if b > limit] == got[got["bytes"] > limit]["shard_id"].tolist()
    assert sharding.assign(frame(spark, []), limit).count() == 0


# -- 3 url filters -----------------------------------------------------------------

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(r, v) for r, v in RULES for h, s, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_rules_and_mined_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x?q=1", "https://example.com/en/6#a", "x://com/en/", "x://notcom/en/", "x://a.net?de/", "x://a.net/de/1", "x://example.net/de/80", "x://Ä.ORG/es/é", "x://b.org/es", "u://p@c.com:80/en/"]
    urls += [f"http://shop{i % 5}.bad.test/win/{i}" for i in range(60)] + [f"http://shop{i % 5}.good.test/read/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(0, None, "h", "v")], "page_id long, url string, host string, verdict string")
    labelled = spark.createDataFrame([(u, "bad.test" in u) for u in urls[14:]] + [(None, True), ("x://q.test/", None)], "url string, block boolean")
    got = urlfilter.judge(pages, labelled, RULES, min_rows=10).toPandas()
    assert len(got) == len(urls) + 1
    for r in got.itertuples():
        host, path, rule, verdict = judged(urls[r.page_id])
        assert (r.host, r.path) == (host, path) and (r.rule or None) == rule, urls[r.page_id]
        assert r.verdict == (verdict or ("block" if "bad.test" in (urls[r.page_id] or "") else "allow")), urls[r.page_id]
    rules = urlfilter.mine_rules(labelled, min_rows=10).collect()
    assert rules and all(r["confidence"] >= 0.7 for r in rules)
    none = labelled.limit(0)
    assert set(urlfilter.judge(pages, none, [], min_rows=10).toPandas()["verdict"]) == {"allow"}
    assert urlfilter.judge(pages.limit(0), labelled, RULES).count() == 0


def test_mined_verdicts_equal_those_of_all_combinations(spark):
    """Brute force over all token sets of a url; long shared paths, tokens that always come together, labels from explicit rules."""
    import itertools

    rng = random.Random(14)
    urls = []
    for i in range(300):
        host = rng.choice(["a.shop.test", "b.shop.test", "www.news.test", "m.news.test", "x.com", "y.com"])
        path = rng.choice(["en", "de", "win/now", "very/long/path/that/all/of/these/share", "q"])
        urls.append(f"http://{host}/{path}/{rng.choice(['1', 'k', 'z'])}" + rng.choice(["", "?a=1", "?a=1&b=2"]))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(900, None), (901, "no scheme")], "page_id long, url string")
    ruled = {u: v == "block" for u in urls for _, _, _, v in [judged(u)] if v}
    assert Counter(urlfilter.rule_labels(pages, RULES).collect()) == Counter((u, ruled[u]) for u in urls if u in ruled)
    marked = [(u, ruled[u] if u in ruled else "win" in u or ("shop" in u and "/de/" in u) or rng.random() < 0.1) for u in urls]
    labelled = spark.createDataFrame([*marked, (None, True), (urls[0], None)], "url string, block boolean")
    plain = lambda x: re.sub("[0-9]+", "0", x)

    def tokens(u):
        host, path, _, _ = judged(u)
        query = u.split("?", 1)[1] if "?" in u else ""
        return frozenset(["h:" + plain(x) for x in host.split(".") if x] + ["p:" + plain(x) for x in path.split("/") if x] + ["q:" + plain(x.split("=")[0]) for x in query.split("&") if x])

    short = lambda t: frozenset(x for x in t if x not in {"p:path", "p:that", "p:all", "p:of", "p:these", "p:share"})  # noqa: E731  always with p:very and p:long
    both, bad = Counter(), Counter()
    for u, block in marked:
        for k in range(1, len(short(tokens(u))) + 1):
            for held in itertools.combinations(sorted(short(tokens(u))), k):
                both[held] += 1
                bad[held] += block
    least = 12
    hits = {u for u in set(urls) if any(bad[held] >= least and bad[held] >= 0.7 * both[held] for k in range(1, len(short(tokens(u))) + 1) for held in itertools.combinations(sorted(short(tokens(u))), k))}
    got = urlfilter.judge(pages, labelled, RULES, min_rows=least).collect()
    assert len(got) == len(urls) + 2 and 0 < len(hits) < len(set(urls))
    for r in got:
        if r["page_id"] < 900 and r["rule"] is None:
            assert (r["verdict"] == "block") == (r["url"] in hits), r["url"]
        elif r["page_id"] >= 900:
            assert r["verdict"] == "allow"
    outside = [r for r in got if r["rule"] is None and r["verdict"] == "block"]
    assert outside and all(r["confidence"] >= 0.7 for r in outside)


# -- 4 decontamination -------------------------------------------------------------


def test_wand_finds_what_exhaustive_scoring_finds():
    rng = random.Random(7)
    items = [(i, words(rng, rng.randrange(3, 60))) for i in range(70)]
    for threshold in (0.15, 0.4, 0.8):
        index = decontaminate.Index.build(items, threshold)
        weights = np.zeros((len(index.terms), len(items)))
        for t in range(len(index.terms)):
            weights[t, index.item[index.first[t] : index.first[t + 1]]] = index.impact[index.first[t] : index.first[t + 1]]
        assert np.allclose(weights.sum(axis=0), 1)
        draw = np.random.default_rng(1)
        for _ in range(60):
            terms = np.sort(draw.choice(len(index.terms), draw.integers(0, len(index.terms)), replace=False))
            scores = weights[terms].sum(axis=0)
            assert {i for i, _ in index.search(terms)} == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(9)
    items = [(i, f"{words(rng, 15).capitalize()}. {words(rng, 9).capitalize()}.") for i in range(30)] + [(90, None), (91, ""), (92, "!!")]
    docs = [(i, words(rng, rng.randrange(0, 400))) for i in range(60)]
    planted = {}
    for i in range(20):
        at = rng.randrange(0, 300)
        text = words(rng, at) + " " + (items[i][1].upper() if i % 3 else items[i][1].replace(" ", "\n")) + " " + words(rng, rng.randrange(0, 200))
        docs.append((100 + i, text))
        planted[100 + i] = i
    docs += odd_rows(rng) + [(100, docs[60][1])]
    found = decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=800).toPandas()
    assert Counter(zip(found["doc_id"], found["item_id"])) == Counter(planted.items()) + Counter([(100, 0)])
    left = decontaminate.without_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == frame(spark, []).columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, _ in docs if i not in planted)
    assert decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_index_blocks_do_not_change_the_leaks(spark):
    rng = random.Random(19)
    # common and rare words, items of very different lengths, copies that lack a part of the words
    word = lambda: rng.choice(WORDS[:6]) if rng.random() < 0.5 else rng.choice(WORDS) + rng.choice(WORDS)
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"{text(rng.choice((6, 15, 40)))}. {text(rng.randrange(4, 12))}.") for i in range(60)] + [(59, "again"), (None, text(9)), (90, None)]
    docs = []
    for i in range(240):
        part = [w for w in items[i % 60][1].split() if rng.random() > 0.2 + 0.2 * rng.random()]
        docs.append((i, text(rng.randrange(0, 150)) + " " + " ".join(part) + " " + text(rng.randrange(0, 150))))
    test = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda size: Counter(map(tuple, decontaminate.find_leaks(frame(spark, docs), test, 0.7, 0.2, block_bytes=size).collect()))
    whole = rows(1 << 20)
    assert 40 < sum(whole.values()) < 200
    assert rows(4000) == whole and rows(600) == whole


# -- 5 language, 7 quality -----------------------------------------------------------


def test_language(spark):
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "äöüßé"}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(4)) for _ in range(20)), k) for i in range(90) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(500, None, "aa"), (501, "123 !?", "bb"), (502, "", None), (None, rows[0][1], None), (0, rows[0][1], "aa")]
    docs = spark.createDataFrame([(*r, 0.1, "q") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    from pyspark.sql import functions as F

    langs, matrix = langid.train(docs, F.col("doc_id") % 4 != 2)
    assert langs == ["aa", "bb", "cc"]
    got = langid.identify(docs, langs, matrix, keep=["doc_id"]).toPandas()
    want = {i: k for i, t, k in rows if i is not None and i < 90}
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    assert all(r.lang_pred == (want[r.doc_id] if r.doc_id in want else "und" if r.doc_id in (500, 501, 502) else "aa") for r in got.itertuples())
    assert langid.train(docs.limit(0), F.lit(True))[0] == []
    none = langid.identify(docs, [], np.zeros((1, 0), np.float32), keep=["doc_id"]).toPandas()
    assert set(none["lang_pred"]) == {"und"} and set(none["score"]) == {0.0}


def test_bucket_scores_equal_a_plain_count():
    texts = ["Ab c!d", None, "--", "zz zz", "é" * 7]
    matrix = np.random.default_rng(0).normal(size=((1 << 8) + 1, 2)).astype(np.float32)
    for first, n, bucket, owner in langid.ngram_buckets(texts, 8):
        alone = [np.concatenate([b for _, _, b, _ in langid.ngram_buckets([t], 8)] or [np.empty(0, int)]) for t in texts]
        for i in range(n):
            assert sorted(bucket[owner == i]) == sorted(alone[first + i])
    names, scores = langid.score_texts(texts, ["a", "b"], matrix, 8)
    assert [x == "und" for x in names] == [False, True, True, False, False] and ((scores > 0) == [True, False, False, True, True]).all()


def test_naive_bayes_equals_a_plain_loop(spark):
    import math
    import unicodedata

    from pyspark.sql import functions as F

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeÄß .,1\n") for _ in range(rng.randrange(0, 80))) for _ in range(60)] + ["a", "Zz", "--x--"]
    rows = [(i, t, ("aa", "bb")[i % 3 == 0], 0.1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    langs, matrix = langid.train(docs, F.col("doc_id") % 5 != 0, bits=10)

    def bucket(gram):
        x = 0
        for n, c in enumerate(gram, 1):
            x = ((x * 0x9E3779B1) ^ (ord(c) + n)) & 0xFFFFFFFF
        x = x * 0x85EBCA77 & 0xFFFFFFFF
        return ((x ^ (x >> 15)) * 0xC2B2AE3D & 0xFFFFFFFF) >> 22

    def grams(text):
        plain = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
        plain = f" {' '.join(plain.split())} "
        return [bucket(plain[i : i + n]) for n in (1, 2, 3) for i in range(len(plain) - n + 1) if plain[i : i + n] != " "] if plain.strip() else []

    counts = {k: Counter(g for i, t, lang, _ in rows if lang == k and i % 5 for g in grams(t)) for k in langs}
    priors = {k: sum(lang == k and i % 5 != 0 for i, _, lang, _ in rows) for k in langs}
    names, scores = langid.score_texts(texts, langs, matrix, 10)
    for t, name, score in zip(texts, names, scores):
        logs = [math.log(priors[k] / sum(priors.values())) + sum(math.log((counts[k][g] + 0.5) / (counts[k].total() + 512)) for g in grams(t)) for k in langs]
        if not grams(t):
            assert (name, score) == ("und", 0)
        else:
            best = max(logs)
            assert name == langs[logs.index(best)] and abs(score - 1 / sum(math.exp(x - best) for x in logs)) < 1e-3


def test_long_texts_are_sliced_without_a_change(monkeypatch):
    from sparkshards.llm import shingles

    rng = random.Random(12)
    texts = ["".join(rng.choice("ab cÄ\n!dE  ") for _ in range(n)) for n in (0, 7, 60, 333)] + ["x" * 400 + " y", " " * 100 + "q" * 31 + "--" * 40 + "é w"]
    matrix = np.random.default_rng(0).normal(size=((1 << 8) + 1, 2)).astype(np.float32)
    whole = [s.tobytes() for s in shingle_sets(texts)], quality.features(texts), langid.score_texts(texts, ["a", "b"], matrix, 8)
    for size in (16, 31):
        monkeypatch.setattr(shingles, "BLOCK_BYTES", size)
        monkeypatch.setattr(shingles, "_powers", None)
        monkeypatch.setattr(quality, "BLOCK_BYTES", size)
        monkeypatch.setattr(langid, "BLOCK", size)
        assert [s.tobytes() for s in shingle_sets(texts)] == whole[0]
        assert np.allclose(quality.features(texts), whole[1])
        names, scores = langid.score_texts(texts, ["a", "b"], matrix, 8)
        assert names == whole[2][0] and np.allclose(scores, whole[2][1])


def test_a_very_long_text_takes_bounded_memory():
    """20 MB of text: what is held besides stays within a small multiple of it."""
    import tracemalloc

    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(WORDS, 1 << 20).tolist()) * 4
    text = text[: 20 << 20]
    matrix = np.zeros(((1 << 16) + 1, 2), np.float32)
    for f, most in ((lambda: langid.score_texts([text], ["a", "b"], matrix, 16), 4), (lambda: next(iter(shingle_sets([text]))), 24), (lambda: quality.features([text]), 24)):
        tracemalloc.start()
        f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(text)


def plain_risk(w, P, U, prior):
    """(risk of the negative part, gradient step's direction) of the non-negative estimator, row by row."""
    import math

    loss = lambda z: math.log1p(math.exp(-abs(z))) + max(-z, 0)
    s = lambda z: 1 / (1 + math.exp(-z))
    dot = lambda x: sum(a * b for a, b in zip(w, x))
    negative = sum(loss(-dot(u)) for u in U) / len(U) - prior * sum(loss(-dot(p)) for p in P) / len(P)
    up = [sum(s(dot(u)) * u[k] for u in U) / len(U) - prior * sum(s(dot(p)) * p[k] for p in P) / len(P) for k in range(len(w))]
    good = [prior * sum(-s(-dot(p)) * p[k] for p in P) / len(P) for k in range(len(w))]
    return negative, [a + b for a, b in zip(up, good)] if negative >= 0 else [-a for a in up]


def test_risk_and_gradient_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    for prior in (0.2, 0.9):
        for scale in (0.1, 2.0):
            P, U, w = rng.normal(1, 1, (20, 3)), rng.normal(0, 1, (30, 3)), rng.normal(0, scale, 3)
            negative, step = quality.risk_step(w, P, U, prior)
            want, direction = plain_risk(w.tolist(), P.tolist(), U.tolist(), prior)
            assert abs(negative - want) < 1e-9 and np.allclose(step, direction)


def test_quality(spark):
    rng = random.Random(4)
    from pyspark.sql import functions as F

    def text(i):
        t = words(rng, 60)
        return t if i % 4 else t.upper().replace(" ", "!! ")

    docs = [(i, text(i)) for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(200)] + [(3, None, 1), (None, 1, 0), (7, 1, 0)]
    table = frame(spark, docs + [(900, None), (901, ""), (None, "abc"), (900, None)])
    model = quality.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") % 5 != 0)
    got = quality.score(table, model, 0.3, keep=["doc_id"]).toPandas()
    assert len(got) == 404 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[(got["doc_id"] % 5 == 0) & (got["doc_id"] < 400)]
    assert ((held["doc_id"] % 4 != 0) == (held["predicted"] == 1)).mean() > 0.97
    empty = quality.train(table, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert set(quality.score(table, empty, keep=["doc_id"]).toPandas()["predicted"]) == {1}
    assert quality.score(table.limit(0), model).count() == 0


def test_copies_do_not_fill_the_quality_sample(spark):
    from pyspark.sql import functions as F

    rng = random.Random(24)
    docs = [(1, "one text again and again")] * 500 + [(i, words(rng, 30)) for i in range(2, 90)]
    labels = spark.createDataFrame([(i, i % 3 and 1) for i in range(1, 60)], "doc_id long, quality int")
    taken = []
    fit = quality.fit_nnpu
    quality.fit_nnpu = lambda positive, unlabelled, prior: taken.append((len(positive), len(unlabelled), prior)) or fit(positive, unlabelled, prior, steps=5)
    try:
        for most in (1000, 10):
            quality.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, F.lit(True), sample_rows=most)
    finally:
        quality.fit_nnpu = fit
    good = 500 + sum(1 for i in range(2, 60) if i % 3)  # each copy counts as the row it is
    assert taken[0][:2] == (good, 30) and all(0 < n <= 10 for n in taken[1][:2]) and taken[0][2] == min(0.95, good / (good + 19))


def test_risk_never_rewards_a_negative_part():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, 4)), rng.normal(-1, 1, (300, 4))
    model = quality.fit_nnpu(good[:150], np.concatenate([good[150:], bad]), 0.35, steps=1500)
    assert ((model.score(good[150:]) > 0.5).mean() + (model.score(bad) < 0.5).mean()) / 2 > 0.85


# -- 6 WARC --------------------------------------------------------------------------


def test_archives_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, "u", "same"), (3, None, None), (4, "v", ""), (5, "w", "é" * 70_000), (None, "n", "same"), (6, "b", "other"), (6, "b", "other"), (None, "m", "lone"), (7, "c", "s")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha1 string")
    for least in (0, 2, 5):
        got = warc.round_trip(pages, min_bytes=least).toPandas()
        first = {}
        for i, _, h in rows:
            if i is not None and len((h or "").encode()) >= least:
                first[h or ""] = min(first.get(h or "", i), i)
        want, seen = Counter(), set()
        for i, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
            data = (h or "").encode()
            # one response of each payload, the first; the others revisit it
            refers = first.get(h or "") if len(data) >= least and data in seen else None
            seen.add(data)
            want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers] += 1
        none = lambda x: None if x is None or x != x else int(x)
        assert Counter((none(r.row_id), r.payload_bytes, r.payload_digest, r.record_type, none(r.refers_to)) for r in got.itertuples()) == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    read = warc.read_archives(warc.write_archives(warc.mark_copies(pages), "file:///tmp/" + hashlib.md5(str(random.random()).encode()).hexdigest(), max_bytes=100)).collect()
    assert {bytes(r["payload"]).decode() for r in read if r["payload"] is not None} == {h or "" for _, _, h in rows}


def test_a_hot_payload(spark, monkeypatch):
    """Most pages alike, many of them repeated rows; with and without a broadcast of the copies."""
    rows = [(i % 90, f"u{i % 3}", "hot") for i in range(400)] + [(500 + i, "v", f"own {i}") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    for most in (50_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        got = warc.round_trip(pages).toPandas()
        hot = got[got["row_id"] < 90]
        assert len(got) == 450 and Counter(hot["row_id"].astype(int)) == Counter(i for i, _, h in rows if h == "hot")
        assert (hot["record_type"] == "response").sum() == 1 and hot[hot["record_type"] == "response"]["row_id"].tolist() == [0]
        assert set(hot["refers_to"].dropna()) == {0} and (got[got["row_id"] >= 500]["record_type"] == "response").all()


def test_damaged_archives_are_told():
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink)
    for i in range(40):
        writer.add(warc.build_record(i, "u", b"page %d " % i * 9, warc.digest(b"page %d " % i * 9), None))
    writer.close()
    data = sink.getvalue()
    assert [warc.parse_page(r)[0] for r in warc.read_archive(io.BytesIO(data))] == list(range(40))
    for broken in (data[:4], data[:100], data[:-3], data[:-40] + b"x" * 40):
        with pytest.raises(warc.WarcError):
            [warc.parse_page(r) for r in warc.read_archive(io.BytesIO(broken))]
    record = warc.build_record(1, "u", b"abc", warc.digest(b"abc"), None)
    for bad in (record.replace(b"WARC/1.1", b"WARC/9"), record[:-1], record.replace(b"abc", b"abd"), record.replace(b"WARC-Date:", b"WARC Date:"), record.replace(b"WARC-Type: response\r\n", b"")):
        with pytest.raises(warc.WarcError):
            warc.parse_page(bad)


# -- 8 fingerprints --------------------------------------------------------------------


def likeness(a, b):
    a, b = ({x for x in t.split("\n") if x} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rng = random.Random(6)
    lines = [words(rng, 3) for _ in range(300)]
    rows = [(100 + i, "\n".join(rng.sample(lines, rng.choice([0, 1, 3, 20, 90, 250])))) for i in range(40)] + odd_rows(rng)
    got = fingerprints.fingerprint_edits(frame(spark, rows)).toPandas()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1]] + [1]))
    want = Counter()
    for n, (i, t) in enumerate(order):
        other = order[(n + 1) % len(order)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + other[:k]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(t, edited), 12), round(likeness(t, other), 12)] += 1
    found = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got.itertuples())
    assert found == want
    by_text = {}
    for i, t in rows:
        for f in got[got["doc_id"] == i]["fingerprint"] if i not in (None, 4) else []:
            assert by_text.setdefault(t or "", f) == f
    assert len(set(by_text.values())) == len({frozenset(x for x in t.split("\n") if x) for t in by_text})
    assert fingerprints.fingerprint_edits(frame(spark, [(1, "a\nb")])).first()["near_next"] == 1.0
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0


def test_fingerprints_of_hot_and_null_ids(spark):
    """Nine rows of ten share an id or have none; they go to several ranges, and the order stays that of ids and texts."""
    rng = random.Random(16)
    rows = [(7, words(rng, rng.randrange(1, 30))) for _ in range(260)] + [(None, words(rng, rng.randrange(1, 30))) for _ in range(200)] + [(7, "again and again")] * 60 + [(i, words(rng, 8)) for i in range(40)]
    rng.shuffle(rows)
    docs = frame(spark, rows)
    got = fingerprints.fingerprint_edits(docs, digest="md5").toPandas()
    order = sorted(((i, t) for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1]] + [1]))
    want = Counter()
    for n, (i, t) in enumerate(order):
        other = order[(n + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        want[i, hashlib.sha256(edited.encode()).hexdigest(), round(likeness(t, other), 12)] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.edited_sha256, round(r.near_next, 12)) for r in got.itertuples()) == want
    from pyspark.sql import functions as F

    placed = docs.select("doc_id", fingerprints._head_of(F.col("text")).alias("head"))
    ranges = placed.withColumn("r", fingerprints._ranges(placed, 16)).groupBy("doc_id", "r").count().toPandas()
    assert (ranges[ranges["doc_id"] == 7]["r"].nunique() > 3) and ranges[ranges["doc_id"].isna()]["r"].nunique() > 3 and ranges["count"].max() < 200


def test_differing_digests_are_recovered(spark):
    rng = random.Random(8)
    rows = [("\n".join(rng.sample(WORDS, a)), "\n".join(rng.sample(WORDS, b))) for a in (0, 1, 5, 30, 100) for b in (0, 2, 40, 100)]
    both = spark.createDataFrame(rows, "x string, y string")
    got = fingerprints.compare_texts(both, "x", "y", "d").selectExpr("x", "y", "array_sort(d.a) = array_sort(transform(array_except(split(x, '\\n'), split(y, '\\n')), v -> xxhash64(v))) as a", "size(d.b) as b").collect()
    for r in got:
        a, b = ({v for v in t.split("\n") if v} for t in (r["x"], r["y"]))
        assert (r["a"] or not a) and r["b"] == len(b - a)


# -- 9 token counts ----------------------------------------------------------------------


def test_tokens_by_section(spark):
    path = tokenizers_files.path("byte_bpe_50k.tiktoken")
    encode = tokencounts.encoder(path, tokenizers_files.PATTERN).encoding
    rows = odd_rows(random.Random(1)) + [(20, "a\n\n\nb  \n c"), (21, "\n"), (22, "x\r\ny")]
    for rule in ("majority", "first", "last", "split"):
        got = tokencounts.count_tokens(frame(spark, rows), path, tokenizers_files.PATTERN, rule).toPandas()
        for i, t in [r for r in rows if r[0] in (3, 5, 6, 7, 20, 21, 22)]:
            data, section, n = t.encode(), [], 0
            for b in data:
                section.append(n)
                n += b == 10
            want, at = Counter(), 0
            for token in encode.encode_ordinary(t):
                size = len(encode.decode_single_token_bytes(token))
                own = section[at : at + size]
                at += size
                if rule == "split":
                    for s in own:
                        want[s] += 1 / size
                else:
                    want[{"first": own[0], "last": own[-1], "majority": max(sorted(set(own)), key=own.count)}[rule]] += 1
            x = got[got["doc_id"] == i].sort_values("section")
            assert x["char_end"].max() == len(t) and x["char_start"].tolist() == [0, *x["char_end"][:-1].tolist()]
            assert np.allclose(x["tokens"], [want[s] for s in range(len(x))])
        assert not set(got["doc_id"]) & {1, 2}
    docs = spark.createDataFrame([(1, "Tïtle body of text", [("title", 0, 5), ("body", 6, 10)])], "doc_id long, text string, spans array<struct<name string, start long, end long>>".replace("name string, start long, end long", "name:string,start:long,end:long"))
    got = tokencounts.count_tokens(docs, path, tokenizers_files.PATTERN, sections_col="spans").orderBy("section").collect()
    assert [(r["name"], r["char_start"], r["char_end"]) for r in got] == [("title", 0, 5), ("", 5, 6), ("body", 6, 10), ("", 10, 18)]
    assert sum(r["tokens"] for r in got) == len(encode.encode_ordinary("Tïtle body of text"))
    assert tokencounts.count_tokens(frame(spark, []), path, tokenizers_files.PATTERN).count() == 0


# -- 10 Jaccard ----------------------------------------------------------------------------


def plain_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    """Ids of nodes by brute force; rows without an id are in no link."""
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b:
                common = len(a & b)
                if 100 * common >= 80 * (len(a) + len(b) - common):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}, [(i, len(s)) for i, s in sets]


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("tile", [192, 8])
def test_components(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_DOCS", tile)
    rng = random.Random(11)
    base = [words(rng, 120) for _ in range(4)]
    rows = [(i, words(rng, rng.randrange(1, 60))) for i in range(120)]
    # groups of near copies far longer than a short list, at all distances
    for g, share in ((0, 0.004), (1, 0.02), (2, 0.04), (3, 0.1)):
        rows += [(1000 * (g + 1) + k, edited(rng, base[g], share * rng.random() * 2)) for k in range(70)] + [(1000 * (g + 1) + 500, base[g])]
    passage = words(rng, 40)
    rows += [(8000 + k, passage + " " + words(rng, rng.randrange(0, 30))) for k in range(60)]
    rows += [(9000 + k, base[0].upper()) for k in range(40)] + [(9100, "A b"), (9101, "a  B"), (9102, "a b c"), (9200, None), (9201, ""), (9202, " \t")]
    rows += [(9300, "one two"), (9300, base[1]), (9000, base[0])]
    rng.shuffle(rows)
    want, sizes = plain_components(rows)
    got = jaccard.jaccard_components(frame(spark, rows)).toPandas()
    assert Counter(zip(got["doc_id"], got["n_shingles"])) == Counter(sizes)
    wrong = [(r.doc_id, r.component_id, want[r.doc_id]) for r in got.itertuples() if r.component_id != want[r.doc_id] and r.doc_id != 9300]
    assert not wrong


def test_texts_of_one_id_are_one_document(spark):
    rng = random.Random(23)
    base = [words(rng, 60) for _ in range(5)]
    rows = [(10, base[0]), (20, base[0]), (20, base[1]), (30, base[1] + " more"), (40, base[2]), (40, None), (5, "alone"), (5, base[3]), (50, base[3]), (1 << 62, base[4]), (1 << 62, "x"), (None, base[1]), (60, base[4])]
    want, sizes = plain_components(rows)
    got = jaccard.jaccard_components(frame(spark, rows)).toPandas()
    assert Counter(zip(got["doc_id"].dropna(), got["n_shingles"][got["doc_id"].notna()])) == Counter((float(i), n) for i, n in sizes if i is not None)
    assert all(r.component_id == want[int(r.doc_id)] for r in got.itertuples() if r.doc_id == r.doc_id)
    assert got["component_id"][got["doc_id"].isna()].tolist() == [10]


def test_components_of_odd_rows(spark):
    rows = odd_rows(random.Random(3))
    got = {(None if r["doc_id"] is None else r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[7, 0] == 7 and got[8, 1] == 8 and got[9, 1] == 8 and got[None, 8] is None
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def test_shingle_sets_agree_with_words():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB c\tD\n\x0b\x1cé ") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    sets = list(shingle_sets(texts))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    ids = {}
    for t, s in zip(texts, sets):
        assert ids.setdefault(plain_set(t), s.tobytes()) == s.tobytes()


def test_graph_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_without_letters_alone():
    names, scores = langid.score_texts(["--", None, "12"], ["a", "b"], np.zeros(((1 << 8) + 1, 2), np.float32), 8)
    assert names == ["und"] * 3 and scores.tolist() == [0, 0, 0]
