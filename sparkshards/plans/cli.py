"""Command line: ls, info, cat, split, extract, create."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.errors import SecurityError
from ..functions.names import KEY, POS, SHARD_ORD, base_of, ext_of, human_bytes
from ..operators import order, stats
from ..sources.shards import write_shards
from .dataset import ShardDataset


def _open(spark: SparkSession, args: argparse.Namespace) -> ShardDataset:
    data = ShardDataset.from_shards(spark, args.shards, handler=args.handler)
    return data.take(args.limit) if args.limit is not None else data


def _sizes() -> F.Column:
    return F.transform("field_order", lambda n: F.struct(n.alias("name"), F.octet_length(F.element_at("fields", n)).alias("bytes")))


def ls(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = _open(spark, args).ordered().select(KEY, _sizes().alias("f")).toLocalIterator()
    for row in rows:
        if args.json:
            print(json.dumps({"key": row[KEY], "fields": {x["name"]: x["bytes"] for x in row["f"]}}))
        else:
            print(row[KEY], *(f"{x['name']}({human_bytes(x['bytes'])})" if args.long else x["name"] for x in row["f"]), sep="\t")


def info(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = _open(spark, args).df.persist()
    if args.json:
        print(stats.report(raw))
        return
    t = stats.totals(raw).first()
    print(f"samples {t['samples']}\nshards  {t['shards']}\nbytes   {human_bytes(t['payload_bytes'])}, {human_bytes(t['mean_bytes'])} a sample")
    for r in stats.by_field(raw).toLocalIterator():
        print(f"  {r['field']:<20} {r['samples']:>10} {human_bytes(r['bytes']):>12} {r['percent']:>6.1f} %")
    if t["shards"] > 1:
        for r in stats.by_shard(raw).toLocalIterator():
            print(f"  {r['samples']:>10} {r['url']}")


def cat(spark: SparkSession, args: argparse.Namespace) -> None:
    """The limit counts before the filter by field."""
    df = _open(spark, args).df
    for name in args.field or []:
        df = df.where(F.map_contains_key("fields", name))
    ranked = order.with_rank(df, [SHARD_ORD, POS], "__at__").withColumn("shard", F.lit(0))
    _one(ranked, args.output)


def _one(ranked, output: str) -> None:
    folder, name = os.path.split(os.path.abspath(output))
    made = write_shards(ranked, folder, f".{name}.%d.part{os.path.splitext(name)[1]}", order_by=["__at__"]).collect()
    if made:
        os.replace(made[0]["url"].removeprefix("file://"), os.path.join(folder, name))


def split(spark: SparkSession, args: argparse.Namespace) -> None:
    data = _open(spark, args)
    if args.shuffle:
        data = data.shuffle(seed=args.seed)
    folder, pattern = os.path.split(os.path.abspath(args.output))
    for r in data.write(folder, pattern, args.max_count, args.max_size).orderBy("shard").collect():
        print(r["url"], r["samples"])


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """One file a field; keys that lead out of the folder are refused."""
    root = os.path.abspath(args.output)
    wanted = set(args.field or [])

    def save(rows) -> None:
        for row in rows:
            for name, data in row["fields"].items():
                if wanted and name not in wanted:
                    continue
                path = os.path.normpath(os.path.join(root, f"{row[KEY]}.{name}"))
                if not path.startswith(root + os.sep):
                    raise SecurityError(f"{row[KEY]} leads out of {root}")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(data)

    _open(spark, args).df.select(KEY, "fields").foreachPartition(save)


def create(spark: SparkSession, args: argparse.Namespace) -> None:
    """Files of a folder to shards, grouped by basename wherever they are, by key."""
    root = os.path.abspath(args.folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(args.recursive).lower()).load("file://" + root)
    name = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 1 << 20)
    rows = files.select(name.alias("name"), "content").where(base_of(F.col("name")).isNotNull())
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lower(ext_of(F.col("name"))).alias("k"), F.col("content").alias("v")))))
    samples = rows.groupBy(base_of(F.col("name")).alias(KEY)).agg(pairs.alias("fields"))
    folder, pattern = os.path.split(os.path.abspath(args.output))
    ShardDataset(samples, (KEY,)).write(folder, pattern, args.max_count, args.max_size)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkshards")
    sub = top.add_subparsers(dest="command", required=True)

    def command(run) -> argparse.ArgumentParser:
        p = sub.add_parser(run.__name__, help=run.__doc__)
        p.set_defaults(run=run)
        p.add_argument("folder" if run is create else "shards")
        if run is not create:
            p.add_argument("-n", "--limit", type=int)
            p.add_argument("--handler", default="reraise_exception")
        return p

    p = command(ls)
    p.add_argument("-l", "--long", action="store_true")
    p.add_argument("--json", action="store_true")
    command(info).add_argument("--json", action="store_true")
    for run in (cat, split, extract, create):
        p = command(run)
        p.add_argument("-o", "--output", required=True)
        if run in (cat, extract):
            p.add_argument("-f", "--field", action="append")
        if run in (split, create):
            p.add_argument("--max-count", type=int, default=100_000)
            p.add_argument("--max-size", type=int)
        if run is split:
            p.add_argument("--shuffle", action="store_true")
            p.add_argument("--seed", type=int, default=0)
        if run is create:
            p.add_argument("-r", "--recursive", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkshards").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    args.run(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
