"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The documents table is written as shards first (not timed), and 8,192 pictures of 64 x 64
pixels as JPEG samples in 16 shards.  Every query runs once to warm up and then three
times; the best run counts.  ``samples_per_s`` and ``mb_per_s`` are the rates of the scan
queries.  ``value`` sums the queries on documents and tables; those on pictures and on four
copies of the document shards, which hide more of a job's fixed cost, are listed besides.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

import numpy as np
import pandas as pd

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sparkshards.functions.jpeg import write_jpeg
    from sparkshards.functions.names import KEY, SHARD_ORD
    from sparkshards.plans import queries as core
    from sparkshards.plans.dataset import ShardDataset
    from sparkshards.sources.shards import write_shards

    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "file://" + scratch).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    manifest = core._written(spark, SF, "b-%02d.tar").select(F.col("shard").alias(SHARD_ORD), "url").collect()
    shards = spark.createDataFrame(manifest, f"{SHARD_ORD} long, url string")
    n = spark.read.parquet(f"{SF}/documents.parquet").count()

    def scan(fields=None):
        return ShardDataset.from_shards(spark, shards, nodesplit="none", fields=fields)

    def typed():
        return scan().project("txt", "json", "cls").decode()

    def pictures(numbers: pd.Series) -> pd.Series:
        y, x = np.mgrid[0:64, 0:64]
        made = [np.stack([127 + 90 * np.sin(x / (5 + i % 11) + y / (6 + i % 7) + k) + i % 29 for k in range(3)], axis=2) for i in numbers.tolist()]
        return pd.Series([write_jpeg(a.clip(0, 255).astype(np.uint8), 85) for a in made])

    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    rows = spark.range(0, 8192, 1, 16).withColumn("jpg", F.pandas_udf(pictures, "binary")("id"))
    fields = F.map_from_entries(F.array(entry("jpg", F.col("jpg")), entry("cls", (F.col("id") % 10).cast("string").cast("binary")), entry("json", F.to_json(F.struct("id")).cast("binary"))))
    rows = rows.select(F.floor(F.col("id") / 512).cast("long").alias("shard"), F.lpad(F.col("id").cast("string"), 6, "0").alias(KEY), fields.alias("fields"))
    drawn = write_shards(rows, f"file://{scratch}/pictures", "p-%02d.tar").select(F.col("shard").alias(SHARD_ORD), "url", "payload_bytes").collect()
    albums = spark.createDataFrame([r[:2] for r in drawn], f"{SHARD_ORD} long, url string")
    fourfold = spark.createDataFrame([(4 * r[0] + k, r[1]) for r in manifest for k in range(4)], f"{SHARD_ORD} long, url string")

    def seen():
        return ShardDataset.from_shards(spark, albums, nodesplit="none").project("jpg", "json", "cls").decode("rgb8")

    def larger():
        return ShardDataset.from_shards(spark, fourfold, nodesplit="none")

    pipelines = {
        "read_only": lambda: scan().df,
        "decode_basic": lambda: typed().df,
        "to_tuple": lambda: typed().to_tuple("txt", "json", missing_is_error=False).df,
        "batched_64": lambda: typed().batched(64).df,
        "shuffle_1000": lambda: typed().shuffle(1000).df,
        "python_map": lambda: scan(["txt"]).project("txt").decode().map(lambda x: x.assign(txt=x["txt"].str.upper())).df,
    }
    others = {
        "large_read_only": lambda: larger().df,
        "large_decode_basic": lambda: larger().project("txt", "json", "cls").decode().df,
        "large_batched_64": lambda: larger().project("txt", "json", "cls").decode().batched(64).df,
        "large_shuffle_1000": lambda: larger().project("txt", "json", "cls").decode().shuffle(1000).df,
        "jpeg_decode_rgb8": lambda: seen().df,
        "jpeg_to_tuple": lambda: seen().to_tuple("jpg", "json", missing_is_error=False).df,
        "jpeg_batched_64": lambda: seen().to_tuple("jpg", "cls", missing_is_error=False).batched(64).df,
        "jpeg_shuffle_1000": lambda: seen().shuffle(1000).df,
    }
    tables = ["group_runs", "slice_step", "batched", "unbatched", "associate", "round_robin", "random_mix", "shuffle_order", "shard_assign_size", "info_totals", "json_decode", "tensor_stats", "global_rank", "select", "map_field"]
    todo = pipelines | others | {name: (lambda f=core.QUERIES[name]: f(spark, SF)) for name in tables}
    took: dict[str, float] = {}
    for name, make in todo.items():
        runs = []
        for _ in range(1 + RUNS):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    size = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    amount = {name: (n, size) for name in pipelines} | {name: (4 * n, 4 * size) if name.startswith("large") else (8192, sum(r["payload_bytes"] for r in drawn)) for name in others}
    rates = {name: round(rows / took[name]) for name, (rows, _) in amount.items()}
    speeds = {name: round(held / 1e6 / took[name], 1) for name, (_, held) in amount.items()}
    value = sum(v for k, v in took.items() if k not in others)
    print(json.dumps({"metric": "sum of best query times", "value": round(value, 3), "unit": "sec", "queries": took, "samples_per_s": rates, "mb_per_s": speeds, "samples": n, "sf": SF}))


if __name__ == "__main__":
    main()
