"""Shards and ordered operators on Spark, always over rows whose partitioning is shuffled."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkshards.functions import tensors
from sparkshards.functions.errors import DuplicateKey, EmptyDataset, MissingKey, Unsupported, ValueProblem, settle
from sparkshards.functions.names import KEY, POS, SHARD_ORD, URL, base_of, ext_of, glob_to_regex, is_shard_metadata, is_shard_metadata_col
from sparkshards.operators import batch, decode, mix, order, sampling, stats, transform
from sparkshards.plans import cli
from sparkshards.plans.dataset import ShardDataset
from sparkshards.sources import shardlists, shards
from sparkshards.sources.opener import Opener
from sparkshards.sources.tario import TarWriter
from sparkshards.streaming import watch


def numbers(spark, n, start=0):
    return spark.range(start, start + n).withColumn("x", F.col("id") % 5).repartition(3, F.rand(1))


def write_tar(path, samples):
    with open(path, "wb") as f:
        w = TarWriter(f, str(path))
        for key, fields in samples:
            w.write(key, fields)
        w.close()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("shards")
    for s in range(3):
        write_tar(root / f"s-{s:03d}.tar", [(f"k{s}{i}", {"cls": str(i), "txt": f"t{s}{i}", "json": json.dumps({"i": i, "s": s}), **({"npy": tensors.write_npy(np.full(2, i, "f4"))} if i % 2 else {})}) for i in range(s + 2)])
    return root


def dataset(spark, folder, **options):
    return ShardDataset.from_shards(spark, f"{folder}/s-{{000..002}}.tar", **options)


def test_scan_project_decode(spark, folder):
    data = dataset(spark, folder)
    keys = [f"k{s}{i}" for s in range(3) for i in range(s + 2)]
    assert [r[KEY] for r in data] == keys
    typed = data.project("cls", "txt", "json", "npy").decode()
    assert dict(typed.df.dtypes)["json"] == "variant" and dict(typed.df.dtypes)["cls"] == "bigint"
    rows = typed.ordered().select("cls", "txt", F.variant_get("json", "$.s", "int").alias("s"), "npy", "__fields__").collect()
    assert [(r["cls"], r["txt"], r["s"]) for r in rows] == [(i, f"t{s}{i}", s) for s in range(3) for i in range(s + 2)]
    assert [r["npy"] is None for r in rows] == [i % 2 == 0 for s in range(3) for i in range(s + 2)]
    assert tensors.to_array(rows[1]["npy"]).tolist() == [1, 1]
    assert [len(r["fields"]) for r in dataset(spark, folder, fields=["txt"])] == [1] * 9
    assert [r[KEY] for r in dataset(spark, folder, limit=1)] == ["k00", "k10", "k20"]
    assert "read [D]" in typed.explain() and "decode [A]" in typed.explain()
    with pytest.warns(UserWarning):
        dataset(spark, folder, nothing=1)


def test_data_source(spark, folder, tmp_path):
    shards.register(spark)
    df = spark.read.format("tarshards").option("fields", "cls").load(f"{folder}/s-{{000..002}}.tar")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 9
    assert spark.read.format("tarshards").option("rank", 1).option("world_size", 2).load(f"{folder}/s-{{000..002}}.tar").select(URL).distinct().count() == 1
    df.write.format("tarshards").mode("append").save(str(tmp_path / "out"))
    files = sorted(os.listdir(tmp_path / "out"))
    assert files and all(f.startswith("part-") for f in files)
    again = shards.read_shards(shards.shard_frame(spark, [str(tmp_path / "out" / f) for f in files]))
    assert sorted(r[KEY] for r in again.collect()) == sorted(r[KEY] for r in df.collect())


def test_content_rows_and_grouping(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder)).select(F.lit(0).cast("long").alias(SHARD_ORD), F.col("path").alias("url"), "content")
    assert shards.read_content(files).count() == 9
    members = spark.createDataFrame([(0, i, n, b"x") for i, n in enumerate(["a.P", "a.q", "noext", "a.p", "b.p", "a.p"])], f"{SHARD_ORD} long, member_ord long, name string, data binary").repartition(3)
    got = shards.group_members(members).orderBy(POS).collect()
    assert [(r[KEY], r["field_order"]) for r in got] == [("a", ["p", "q"]), ("b", ["p"]), ("a", ["p"])]


def test_errors_and_policies(spark, folder, tmp_path):
    data = (folder / "s-002.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(data[:3000])
    urls = [str(tmp_path / "cut.tar"), str(folder / "s-000.tar"), str(tmp_path / "none.tar")]
    with pytest.raises(Exception, match="FormatError|archive ends|none.tar"):
        ShardDataset.from_shards(spark, urls).df.count()
    kept = ShardDataset.from_shards(spark, urls, handler="ignore_and_continue")
    assert {"k00", "k01"} < {r[KEY] for r in kept}
    rows = spark.createDataFrame([(i, ("E", "m", "f") if i in (3, 5) else None) for i in range(8)], "id long, _error struct<class:string,message:string,field:string>").repartition(3)
    assert sorted(r["id"] for r in settle(rows, "ignore_and_continue", ["id"]).collect()) == [0, 1, 2, 4, 6, 7]
    assert sorted(r["id"] for r in settle(rows, "warn_and_stop", ["id"]).collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="E: f: m"):
        settle(rows, "reraise_exception", ["id"]).collect()


def test_a_stop_policy_ends_the_stream(spark, tmp_path):
    """Three archives of 50, the second cut off after 10: what a reader of one after another would give."""
    for s in range(3):
        write_tar(tmp_path / f"s{s}.tar", [(f"k{s}{i:02d}", {"txt": f"{s} {i}"}) for i in range(50)])
    whole = (tmp_path / "s1.tar").read_bytes()
    (tmp_path / "s1.tar").write_bytes(whole[: 10 * 1024 + 600])
    urls = [str(tmp_path / f"s{s}.tar") for s in range(3)]
    counts = lambda handler: {r[0]: r[1] for r in ShardDataset.from_shards(spark, urls, handler=handler).df.groupBy(SHARD_ORD).count().collect()}
    assert counts("ignore_and_stop") == counts("warn_and_stop") == {0: 50, 1: 10}
    assert counts("ignore_and_continue") == counts("warn_and_continue") == {0: 50, 1: 10, 2: 50}
    batches = ShardDataset.from_shards(spark, urls, handler="ignore_and_stop").project("txt").decode().batched(40)
    assert sorted(len(r["txt"]) for r in batches.df.collect()) == [20, 40]


def test_archives_are_opened_twice_at_most(spark, tmp_path):
    """Once for counts and once for data, and not at all while stages are put together."""
    for s in range(4):
        write_tar(tmp_path / f"s{s}.tar", [(f"k{s}{i:02d}", {"txt": f"{s} {i}"}) for i in range(30)])
    log = tmp_path / "log"

    def noted(url, mode):
        with open(log, "a") as f:
            f.write(url + "\n")
        return open(url.removeprefix("noted:"), "rb")

    opener = Opener(handlers={"noted": noted})
    opened = lambda: len(log.read_text().splitlines()) if log.exists() else 0
    raw = ShardDataset.from_shards(spark, [f"noted:{tmp_path}/s{s}.tar" for s in range(4)], opener=opener)
    typed = raw.project("txt").decode()
    made = {
        "plain": typed, "batched": typed.batched(8), "shuffled": typed.shuffle(20), "both": typed.shuffle(20).batched(8), "sliced": typed.slice(5, 100, 2).shuffle(20).batched(8),
        "epoch": typed.with_epoch(200).batched(8), "mixed": ShardDataset.round_robin(typed.take(10), typed.slice(20, 60), longest=True),
    }
    assert opened() == 0
    for name, data in made.items():
        log.unlink(missing_ok=True)
        data.df.collect()
        assert opened() <= {"plain": 4, "mixed": 16}.get(name, 8), name
    keys = [f"k{s}{i:02d}" for s in range(4) for i in range(30)]
    got = [k for r in made["sliced"].ordered().collect() for k in r[KEY]]
    assert sorted(got) == keys[5:100:2] and got != keys[5:100:2]
    assert [k for r in made["batched"].ordered().collect() for k in r[KEY]] == keys
    assert [k for r in made["epoch"].ordered().collect() for k in r[KEY]] == (keys * 2)[:200]
    assert [r[KEY] for r in made["mixed"].ordered().collect()] == [k for pair in zip(keys[:10], keys[20:30]) for k in pair] + keys[30:60]


def test_buffered_shuffle_is_that_of_all_places(spark):
    import hashlib

    for n, size, initial in ((101, 7, None), (40, 100, None), (60, 10, 3), (1, 5, None), (0, 5, None)):
        got = {r["id"]: r["rn"] for r in sampling.shuffle_buffered(numbers(spark, n), ["id"], size, 9, initial).collect()}
        spread = max(1, min(initial or size, size))
        place = lambda i: i + int(hashlib.md5(b"9:%d" % i).hexdigest()[:8], 16) % spread
        want = sorted(range(n), key=lambda i: (place(i), i))
        assert got == {i: rn for rn, i in enumerate(want)}


def test_rank_of_a_hot_key(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 1800, F.lit(7)).otherwise(F.col("id") % 100).alias("k")).repartition(5)
    ranked = order.with_rank(rows, ["k"]).collect()
    assert sorted(r["rn"] for r in ranked) == list(range(2000))
    held = [r["k"] for r in sorted(ranked, key=lambda r: r["rn"])]
    assert held == sorted(held)
    assert order.with_rank(rows, ["k"]).select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 1500


@pytest.mark.parametrize("block", [None, 1])
def test_shards_by_size_equal_a_plain_loop(spark, block):
    import random

    rng = random.Random(5)
    for n, most, count in ((500, 900, 7), (300, 50, 1), (200, 10**9, 9), (120, 1, 50), (77, 400, 100), (1, 5, 5), (0, 5, 5)):
        sizes = [rng.choice([0, 1, 30, 100, 2000]) for _ in range(n)]
        want, shard, rows, held = [], 0, 0, 0
        for x in sizes:
            if rows >= count or held >= most:
                shard, rows, held = shard + 1, 0, 0
            want.append(shard)
            rows, held = rows + 1, held + x
        df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long").repartition(3)
        got = {r["id"]: r["shard"] for r in batch.shard_by_size(df, ["id"], F.col("n"), most, count, block=block).collect()}
        assert got == dict(enumerate(want)), (n, most, count)


def test_handlers_of_samples(spark):
    rows = [(0, b"1", b"a", b'{"k": 1}'), (1, b"x", b"b", b"{}"), (2, b"3", b"\xff", b"{}"), (3, b" +4 ", b"d", b"{"), (4, None, b"e", None), (5, b"6", b"f", b"null")]
    df = spark.createDataFrame(rows, "id long, cls binary, txt binary, json binary").withColumn("npy", F.when(F.col("id") != 5, F.lit(tensors.write_npy(np.ones(2, "f4")))).otherwise(F.lit(b"none"))).repartition(3)
    kept = lambda handler: sorted((r["id"], r["cls"]) for r in decode.decode(df, handler=handler, order_by=["id"]).select("id", "cls").collect())
    assert kept("ignore_and_continue") == kept("warn_and_continue") == [(0, 1), (4, None)] and kept("ignore_and_stop") == [(0, 1)]
    with pytest.raises(Exception):
        decode.decode(df).collect()
    assert decode.decode(df, handler="ignore_and_continue", order_by=["id"], only=["npy"]).count() == 5
    upper = decode.decode(df.select("id", F.col("txt").alias("weird")), post=[lambda name, c: F.hex(c) if name == ".weird" else None]).orderBy("id").first()
    assert upper["weird"] == "61"

    def fails(x):
        if (x["id"] == 3).any():
            raise KeyError("three")
        return x.assign(cls=x["id"].astype(str))

    small = df.select("id", F.lit("k").alias(KEY), F.lit("").alias("cls"))
    done = lambda handler: sorted(r["id"] for r in transform.map_sample(small, fails, handler=handler, order_by=["id"]).collect())
    assert done("ignore_and_continue") == [0, 1, 2, 4, 5] and done("warn_and_stop") == [0, 1, 2]
    with pytest.raises(Exception, match="three"):
        transform.map_sample(small, fails).collect()
    some = spark.createDataFrame([(i, "a" if i % 2 else None, "b" if i == 2 else None) for i in range(5)], "id long, a string, b string")
    assert sorted(r["_0"] for r in transform.to_tuple(some, "a;b", keep=["id"], handler="ignore_and_continue").collect()) == ["a", "a", "b"]
    assert sorted(r["id"] for r in transform.rename(some, handler="ignore_and_stop", order_by=["id"], c="a;b").collect()) == []
    assert sorted(r["c"] for r in transform.rename(some, handler="ignore_and_continue", order_by=["id"], c="a;b").collect()) == ["a", "a", "b"]


def test_repeat_with_limits_and_collation_switches(spark):
    data = ShardDataset.from_frame(numbers(spark, 4), ["id"], "id")
    assert [r["id"] for r in data.repeat(nsamples=10)] == [0, 1, 2, 3] * 2 + [0, 1]
    assert [r["id"] for r in data.repeat(2, nbatches=10)] == [0, 1, 2, 3] * 2 and [r["id"] for r in data.repeat(2, nsamples=3)] == [0, 1, 2]
    with pytest.raises(ValueProblem):
        data.repeat()
    typed = numbers(spark, 4).withColumn("b", F.col("id") > 1).withColumn("i", F.col("id").cast("int"))
    plain = batch.batched(typed, ["id"], 4, combine_scalars=False)
    assert dict(plain.dtypes)["b"] == "array<boolean>" and dict(plain.dtypes)["i"] == "array<int>" and plain.first()["b"] == [False, False, True, True]


def test_names_as_columns(spark):
    found = ["a/b/c.seg.png", "a/b.c/d.png", "plain", ".hidden", "__index__", "__dup__/a.png", "dir/__index__", "__a__b__/x", "__x", "a\nb.c"]
    rows = spark.createDataFrame([(x,) for x in found], "n string").select("n", base_of(F.col("n")).alias("b"), ext_of(F.col("n")).alias("e"), is_shard_metadata_col(F.col("n")).alias("m"), F.rlike("n", F.lit(glob_to_regex("*.p?g"))).alias("g")).collect()
    from sparkshards.functions.names import base_plus_ext

    for r in rows:
        assert (r["b"], r["e"]) == (base_plus_ext(r["n"]) or (None, None)) and r["m"] == is_shard_metadata(r["n"]) and r["g"] == r["n"].endswith(".png")


def test_order(spark):
    df = numbers(spark, 101)
    assert [r["rn"] for r in order.with_rank(df, ["x", "id"]).orderBy("x", "id").collect()] == list(range(101))
    assert sorted(r["id"] for r in order.slice_rows(df, ["id"], 2, 3).collect()) == [2, 3, 4]
    assert sorted(r["id"] for r in order.slice_rows(df, ["id"], 0, 3, 2).collect()) == [0, 2, 4]
    assert sorted(r["id"] for r in order.slice_args(df, ["id"], 1, 6, 2).collect()) == [1, 3, 5]
    assert order.take(df, ["id"], 0).count() == 0 and order.take(df.limit(0), ["id"], 5).count() == 0
    with pytest.raises(ValueProblem):
        order.slice_rows(df, ["id"], 0, 1, 0)
    small = numbers(spark, 3)
    assert [r["id"] for r in order.with_epoch(small, ["id"], 7).orderBy("rn").collect()] == [0, 1, 2, 0, 1, 2, 0]
    assert [r["id"] for r in order.with_epoch(small, ["id"], 4, 4).orderBy("rn").collect()] == [1, 2, 0, 1]
    assert order.with_epoch(small.limit(0), ["id"], 7).count() == 0 and order.repeat(small, 2).count() == 6
    with pytest.raises(EmptyDataset):
        order.check_not_empty(small.limit(0))
    nulls = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), (None, 0)], "k string, i long").repartition(2)
    assert [(r["k"], r["i"]) for r in order.with_rank(nulls, ["k", "i"]).orderBy("rn").collect()] == [(None, 0), (None, 1), ("a", 3), ("b", 2)]


def test_sampling(spark):
    df = numbers(spark, 1000)
    one = [r["id"] for r in sampling.random_subsample(df, 0.3, 1, "id").orderBy("id").collect()]
    assert one == [r["id"] for r in sampling.random_subsample(df.repartition(7), 0.3, 1, "id").orderBy("id").collect()] and 230 < len(one) < 370
    assert sampling.random_subsample(df, 2.0, 1, "id").count() == 1000 and sampling.random_subsample(df, -1, 1, "id").count() == 0
    first, second = ([r["id"] for r in sampling.shuffle_order(df, 4, "id", e).orderBy("rn").collect()] for e in (0, 1))
    assert sorted(first) == list(range(1000)) and first != second and first != sorted(first)
    near = [r["id"] for r in sampling.shuffle_buffered(df, ["id"], 50, 2).orderBy("rn").collect()]
    assert sorted(near) == list(range(1000)) and near != sorted(near) and all(p >= i - 50 + 1 for p, i in enumerate(near))
    assert sampling.choose(df, 10, 3, "id").count() == 10 and sampling.choose(df, 5000, 3, "id").count() == 1000
    assert sampling.resample(df, ["id"], 50, 1).count() == 50 and sampling.resample(df.limit(0), ["id"], 50, 1).count() == 0


def test_mixes(spark):
    by = lambda n, base: (numbers(spark, n, base), ["id"])
    ids = lambda df, *o: [r["id"] for r in df.orderBy(*o).collect()]
    assert ids(mix.round_robin([by(3, 0), by(3, 10)]), "rn", "source") == [0, 10, 1, 11, 2, 12]
    assert ids(mix.round_robin([by(1, 0), by(5, 10)]), "rn", "source") == [0, 10]
    assert ids(mix.round_robin([by(1, 0), by(3, 10)], longest=True), "rn", "source") == [0, 10, 11, 12]
    assert ids(mix.concat([by(2, 5), by(2, 0)]), "source", "rn") == [5, 6, 0, 1]
    got = mix.random_mix([by(50, 0), by(50, 100)], [1, 3], 5).orderBy("draw").collect()
    for s in (0, 1):
        own = [r["id"] for r in got if r["source"] == s]
        assert own == [100 * s + i for i in range(len(own))]
    assert sum(r["source"] for r in got) == 50
    assert mix.random_mix([by(5, 0), by(9, 100)], longest=True).count() == 14
    with pytest.raises(ValueProblem):
        mix.random_mix([by(1, 0), by(1, 10)], [0, 0])


def test_batches(spark):
    df = numbers(spark, 5).withColumn("f", F.col("id") * 0.5).withColumn("b", F.col("id") > 2).withColumn("s", F.concat(F.lit("v"), "id"))
    got = batch.batched(df, ["id"], 2).orderBy("batch_id").collect()
    assert [len(r["id"]) for r in got] == [2, 2, 1] and got[1]["b"] == [0, 1] and got[0]["f"] == [0.0, 0.5] and got[0]["s"] == ["v0", "v1"]
    assert batch.batched(df, ["id"], 2, partial=False).count() == 2
    back = batch.unbatched(batch.batched(df, ["id"], 2)).orderBy("id").collect()
    assert [(r["id"], r["s"]) for r in back] == [(i, f"v{i}") for i in range(5)]
    big = spark.createDataFrame([(2**53 + 1,)], "id long")
    assert batch.unbatched(batch.batched(big, ["id"], 1)).first()["id"] == 2**53 + 1
    with pytest.raises(ValueProblem):
        batch.batched(df, ["id"], 0)
    with pytest.raises(Exception, match="differ in length"):
        batch.unbatched(spark.createDataFrame([(0, [1], [1, 2])], "batch_id long, a array<int>, b array<int>")).collect()
    t = spark.createDataFrame([(i, [float(i)] * 3) for i in range(4)], "id long, a array<float>").select("id", tensors.array_to_tensor("a").alias("t"))
    stacked = batch.batched(t, ["id"], 4).first()["t"]
    assert stacked["shape"] == [4, 3] and tensors.to_array(stacked)[:, 0].tolist() == [0, 1, 2, 3]
    assert tensors.to_array(t.select(tensors.reshape(F.col("t"), [3, 1]).alias("t")).first()["t"]).shape == (3, 1)
    with pytest.raises(Exception, match="does not fit"):
        t.select(tensors.reshape(F.col("t"), [2])).collect()
    mixed = t.unionByName(spark.createDataFrame([(9, [1.0])], "id long, a array<float>").select("id", tensors.array_to_tensor("a").alias("t")))
    with pytest.raises(Exception, match="differ in shape"):
        batch.batched(mixed, ["id"], 5).collect()


def test_transforms(spark):
    df = spark.createDataFrame([("k1", 1, None, "p"), ("k2", None, 2, "q")], f"{KEY} string, `a.x` long, b long, `c.png` string")
    assert [tuple(r) for r in transform.to_tuple(df, "a.x;b c.png").collect()] == [(1, "p"), (2, "q")]
    with pytest.raises(MissingKey):
        transform.to_tuple(df, "none")
    with pytest.raises(Exception, match="MissingKey"):
        transform.to_tuple(df, "b").collect()
    assert [tuple(r) for r in transform.to_tuple(df, "b", missing_is_error=False).collect()] == [(None,), (2,)]
    assert [tuple(r) for r in transform.extract_keys(df, "*.png;*.jpg").collect()] == [("p",), ("q",)]
    with pytest.raises(DuplicateKey):
        transform.extract_keys(df, "*.*")
    with pytest.raises(MissingKey):
        transform.extract_keys(df, "z*")
    assert transform.extract_keys(df, "z*", "b", missing_is_error=False).columns == ["_0"]
    assert transform.rename(df, n="b;a.x").columns == [KEY, "c.png", "n"] and transform.rename(df, keep=False, n="a.x;b").columns == [KEY, "n"]
    assert transform.rename_keys(df, img="*.png").columns == [KEY, "img"]
    assert transform.rename_keys(df, keep_unselected=True, img="*.png").columns == [KEY, "a.x", "b", "img"]
    with pytest.raises(MissingKey):
        transform.rename_keys(df, img="*.tif")
    with pytest.raises(DuplicateKey):
        transform.rename_keys(df, keep_unselected=True, b="*.png")
    table = spark.createDataFrame([("k1", 9, "new"), (None, 1, "x")], f"{KEY} string, b long, extra string")
    got = transform.associate(df, table).orderBy(KEY).collect()
    assert [(r["b"], r["extra"]) for r in got] == [(9, "new"), (2, None)]
    with pytest.raises(DuplicateKey):
        transform.associate(df, table.unionByName(table.where("b = 9")))
    assert transform.select(df, lambda x: x["b"].notna()).count() == 1
    assert transform.map_sample(df, lambda x: x.drop(columns=[KEY]).assign(b=5)).where(F.col(KEY).isNotNull() & (F.col("b") == 5)).count() == 2
    assert transform.valid(df.withColumn("__bad__", F.col("b").isNull())).count() == 1


def test_decoders(spark):
    rows = spark.createDataFrame([(b" +4\n", "é".encode(), b'{"a":[1,2.5]}')], "`x.cls` binary, txt binary, json binary")
    got = decode.decode(rows)
    assert got.select("`x.cls`", "txt").first() == (4, "é") and got.select(F.variant_get("json", "$.a[1]", "double")).first()[0] == 2.5
    for bad, name in ((b"4.0", "cls"), (b"", "cls"), (b"99999999999999999999", "cls"), (b"\xff", "txt"), (b"{", "json"), (b"zz", "txt.gz"), (b"zz", "npy"), (b"zz", "ten"), (b"\xc1", "mp"), (b"\xff", "cbor"), (b"PK", "npz"), (b"x", "png")):
        df = spark.createDataFrame([(bad,)], f"`{name}` binary")
        with pytest.raises(Exception):
            decode.decode(df, "rgb8").select(F.col(f"`{name}`").cast("string") if name == "json" else f"`{name}`").collect()
    with pytest.raises(Unsupported):
        decode.decode(spark.createDataFrame([(b"x",)], "pkl binary"))
    with pytest.raises(Exception):
        decode.decode(got, only=["txt"], partial=False)
    assert decode.decode(rows, only=["txt"]).dtypes[0][1] == "binary"
    assert decode.decode(rows, handlers={"cls": lambda c: F.octet_length(c)}).first()[0] == 4


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([("k", 7, "text", '{"b": [1, 2.5], "a": null}', [0.5, 1.5], "gz text")], f"{KEY} string, cls long, txt string, j string, v array<float>, `a.txt.gz` string")
    df = df.select(KEY, "cls", "txt", F.parse_json("j").alias("json"), F.parse_json("j").alias("mp"), F.parse_json("j").alias("cbor"), tensors.array_to_tensor("v").alias("npy"), tensors.array_to_tensor("v").alias("ten"), F.create_map(F.lit("m"), tensors.array_to_tensor("v")).alias("npz"), "`a.txt.gz`")
    pixels = spark.createDataFrame([(tensors.to_row(np.arange(48, dtype=np.uint8).reshape(4, 4, 3)),)], "png " + tensors.TENSOR.simpleString())
    df = df.join(pixels)
    names = [c for c in df.columns if c != KEY]
    raw = decode.encode(df)
    back = decode.decode(transform.project_raw(raw, names), "rgb8")
    r = back.select("cls", "txt", F.to_json("json").alias("json"), F.to_json("mp").alias("mp"), F.to_json("cbor").alias("cbor"), "npy", "ten", "npz", "`a.txt.gz`", "png").first()
    assert (r["cls"], r["txt"], r["a.txt.gz"]) == (7, "text", "gz text") and json.loads(r["json"]) == json.loads(r["mp"]) == json.loads(r["cbor"]) == {"a": None, "b": [1, 2.5]}
    assert tensors.to_array(r["npy"]).tolist() == tensors.to_array(r["ten"][0]).tolist() == tensors.to_array(r["npz"]["m"]).tolist() == [0.5, 1.5]
    assert tensors.to_array(r["png"]).shape == (4, 4, 3)


def test_write_and_read_again(spark, folder, tmp_path):
    data = dataset(spark, folder)
    seen = []
    made = data.write(str(tmp_path / "a"), "x-%02d.tar.gz", max_count=4, post=seen.append).orderBy("shard").collect()
    assert [r["samples"] for r in made] == [4, 4, 1] and seen == [r["url"] for r in made]
    again = ShardDataset.from_shards(spark, [r["url"] for r in made])
    assert [(r[KEY], r["fields"]) for r in again] == [(r[KEY], r["fields"]) for r in data]
    typed = data.project("cls", "txt").decode().write(str(tmp_path / "b"), max_count=100).collect()
    assert [r["samples"] for r in typed] == [9]
    sized = data.write(str(tmp_path / "c"), max_size=100, max_count=1000).orderBy("shard").collect()
    assert sum(r["samples"] for r in sized) == 9 and all(r["payload_bytes"] >= 100 for r in sized[:-1])
    assert not [f for d in "abc" for f in os.listdir(tmp_path / d) if f.startswith(".") and not f.endswith(".crc")]


def test_shard_lists(spark):
    urls = lambda df: [r["url"] for r in df.orderBy(SHARD_ORD).collect()]
    ten = shardlists.simple(spark, "s-{0..9}.tar")
    assert urls(ten) == [f"s-{i}.tar" for i in range(10)]
    parts = [urls(shardlists.split_by_worker(shardlists.split_by_node(ten, n, 2), w, 2)) for n in range(2) for w in range(2)]
    assert sorted(x for p in parts for x in p) == urls(ten) and parts[0] == ["s-0.tar", "s-4.tar", "s-8.tar"]
    assert sorted(urls(shardlists.shuffled(ten, 1))) == urls(ten) and urls(shardlists.shuffled(ten, 1)) != urls(shardlists.shuffled(ten, 1, 1))
    assert len(urls(shardlists.resampled(ten, 25, 1))) == 25
    for bad in (lambda: shardlists.simple(spark, ""), lambda: shardlists.resampled(ten, None), lambda: shardlists.single_node_only(ten, 2)):
        with pytest.raises((EmptyDataset, ValueProblem)):
            bad()
    spec = shardlists.mix_from_yaml("prefix: /d/\nbuckets: [one, two]\ndatasets:\n- {name: a, shards: 'a-{0..4}.tar', choose: 3}\n- {name: b, shards: ['b.tar'], resample: 5, buckets: three}\n", 2)
    got = urls(spec.shards_for_epoch(spark))
    assert len(got) == 8 and got.count("/d/three/b.tar") == 5 and sum(x.startswith("/d/one/a-") for x in got) == 3
    assert shardlists.repeated_sample(spark, {"a": 1}, 4).count() == 4


def test_stats_and_report(spark, folder):
    raw = dataset(spark, folder).df
    t = stats.totals(raw).first()
    assert (t["samples"], t["shards"]) == (9, 3) and t["mean_bytes"] == t["payload_bytes"] // 9
    assert [(r["field"], r["samples"]) for r in stats.by_field(raw).collect()] == [("cls", 9), ("json", 9), ("npy", 4), ("txt", 9)]
    assert [r["samples"] for r in stats.by_shard(raw).collect()] == [2, 3, 4]
    assert json.loads(stats.report(raw))["samples"] == json.loads(dataset(spark, folder).info())["samples"] == 9
    dataset(spark, folder).trace("t", 2)
    dataset(spark, folder).log_keys(f"{folder}/keys", 2)
    assert sorted(r[0] for r in spark.read.text(f"{folder}/keys").collect()) == ["0\tk00", "1\tk01"]


def test_fluent_stages_apply_in_order(spark, folder):
    data = dataset(spark, folder).project("cls", "txt").decode()
    assert [r["cls"] for r in data.select("cls > 0").slice(2)] == [1, 1]
    assert len(data.batched(4).slice(2).df.collect()) == 2
    assert [r["_0"] for r in data.to_tuple("txt", "cls").take(2)] == ["t00", "t01"]
    assert sorted(r["txt"] for r in data.shuffle(seed=3)) == sorted(r["txt"] for r in data)
    assert [r["txt"] for r in data.with_epoch(11)][9:] == ["t00", "t01"]
    assert len(list(data.repeat(2))) == 18 and len(data.with_length(5)) == 5
    assert [r["cls"] for r in data.compose(lambda d: d.where("cls = 3"))] == [3]


def test_secure_opener(spark, folder):
    with pytest.raises(Exception, match="secure mode"):
        dataset(spark, folder, opener=Opener(secure=True)).df.count()
    assert ShardDataset.from_shards(spark, [f"pipe:cat {folder}/s-000.tar"], opener=Opener(allow_pipe=True)).df.count() == 2


def test_watched_folder(spark, folder, tmp_path):
    import shutil

    inbox = tmp_path / "in"
    inbox.mkdir()
    got = []
    run = lambda: watch.for_each_batch(watch.watch(spark, str(inbox), files_per_batch=1), lambda df, n: got.extend(r[KEY] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    shutil.copy(folder / "s-000.tar", inbox)
    run()
    shutil.copy(folder / "s-001.tar", inbox)
    run()
    assert sorted(got) == ["k00", "k01", "k10", "k11", "k12"]


def test_command_line(spark, folder, tmp_path, capsys):
    pattern = f"{folder}/s-{{000..002}}.tar"
    call = lambda *a: (cli.parser().parse_args(a), None)[0]

    def run(*a):
        args = call(*a)
        args.run(spark, args)
        return capsys.readouterr().out

    assert run("ls", pattern, "-n", "2").splitlines() == ["k00\tcls\tjson\ttxt", "k01\tcls\tjson\tnpy\ttxt"]
    assert json.loads(run("ls", pattern, "-n", "1", "--json"))["fields"]["cls"] == 1
    assert "samples 9" in run("info", pattern) and json.loads(run("info", pattern, "--json"))["shards"] == 3
    run("cat", pattern, "-o", str(tmp_path / "one.tar"), "-f", "npy", "-n", "4")
    assert [r[KEY] for r in ShardDataset.from_shards(spark, [str(tmp_path / "one.tar")])] == ["k01", "k11"]
    assert len(run("split", pattern, "-o", str(tmp_path / "p-%d.tar"), "--max-count", "5").splitlines()) == 2
    run("extract", pattern, "-o", str(tmp_path / "x"), "-f", "txt")
    assert (tmp_path / "x" / "k21.txt").read_text() == "t21" and len(os.listdir(tmp_path / "x")) == 9
    run("create", str(tmp_path / "x"), "-o", str(tmp_path / "c-%d.tar"))
    assert [r[KEY] for r in ShardDataset.from_shards(spark, [str(tmp_path / "c-0.tar")])] == sorted(f"k{s}{i}" for s in range(3) for i in range(s + 2))
    write_tar(tmp_path / "evil.tar", [("../../up", {"txt": "x"})])
    with pytest.raises(Exception, match="leads out"):
        run("extract", str(tmp_path / "evil.tar"), "-o", str(tmp_path / "y"))
