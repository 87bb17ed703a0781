"""Operators applied to the driver's Parquet tables, with DuckDB SQL beside them.

Integers are BIGINT on both sides; seeded draws use md5, which both engines have.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.errors import ValueProblem
from ..functions.tensors import array_to_tensor, tensor_to_array
from ..operators import batch, decode, mix, order, sampling, stats, transform
from ..sources import shardlists, shards
from .dataset import ShardDataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(*columns)


_RN = "(select *, row_number() over (order by doc_id) - 1 as rn from documents)"


def _raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw samples: a shard a source, fields txt, json and, where labelled, cls."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    entries = F.array(
        F.struct(F.lit("cls").alias("key"), F.col("quality").cast("string").cast("binary").alias("value")),
        F.struct(F.lit("json").alias("key"), F.to_json(F.struct("lang", "n_chars", "source")).cast("binary").alias("value")),
        F.struct(F.lit("txt").alias("key"), F.col("text").cast("binary").alias("value")),
    )
    fields = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return rows.select(F.substring("source", 4, 9).cast("long").alias(names.SHARD_ORD), F.col("doc_id").alias(names.POS), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias(names.KEY), F.col("source").alias(names.URL), fields.alias("fields"))


# -- grouping, names ---------------------------------------------------------------


@_query("""
    with a as (select conv_id, turn, role, case when lag(role) over w = role then 0 else 1 end as new from conversations window w as (partition by conv_id order by turn)),
    b as (select *, sum(new) over (partition by conv_id order by turn rows unbounded preceding) - 1 as run from a)
    select conv_id, run::bigint as run, role, count(*) as members, min(turn) as first_turn from b group by all""")
def group_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD8: neighbours with one key form a group; a key that comes again starts another."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    rows = rows.withColumn("new", F.coalesce((F.lag("role").over(w) != F.col("role")).cast("long"), F.lit(1)))
    rows = rows.withColumn("run", (F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    return rows.groupBy("conv_id", "run", "role").agg(F.count(F.lit(1)).alias("members"), F.min("turn").alias("first_turn"))


@_query("""
    with m as (select conv_id as shard, turn as member_ord, 'k' || (turn // 3) || '.' || role || (turn % 3) as name from conversations),
    a as (select *, regexp_extract(name, '^((?:.*/)?[^/.]+)\\.([^/]*)$', 1) as base, regexp_extract(name, '^((?:.*/)?[^/.]+)\\.([^/]*)$', 2) as ext from m),
    b as (select *, case when lag(base) over (partition by shard order by member_ord) = base then 0 else 1 end as new from a),
    c as (select *, sum(new) over (partition by shard order by member_ord rows unbounded preceding) - 1 as pos from b)
    select shard, pos::bigint as pos, base as sample_key, count(distinct ext) as n_fields, string_agg(ext, ',' order by member_ord) as fields from c group by all""")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD7, RD8: archive members to samples, as columns."""
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias(names.SHARD_ORD), F.col("turn").alias("member_ord"), F.expr("concat('k', turn div 3, '.', role, turn % 3)").alias("name"), F.col("text").cast("binary").alias("data"))
    out = shards.group_members(rows)
    return out.select(F.col(names.SHARD_ORD).alias("shard"), F.col(names.POS).cast("long").alias("pos"), F.col(names.KEY).alias("sample_key"), F.size("fields").cast("long").alias("n_fields"), F.array_join("field_order", ",").alias("fields"))


@_query("""select page_id, nullif(regexp_extract(url, '^((?:.*/)?[^/.]+)\\.([^/]*)$', 1), '') as base,
    case when regexp_matches(url, '^((?:.*/)?[^/.]+)\\.([^/]*)$') then regexp_extract(url, '^((?:.*/)?[^/.]+)\\.([^/]*)$', 2) end as ext from pages""")
def base_plus_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD6: a name split at the first dot after the last slash."""
    return _t(spark, sf_dir, "pages").select("page_id", names.base_of(F.col("url")).alias("base"), names.ext_of(F.col("url")).alias("ext"))


# -- order -------------------------------------------------------------------------


@_query(f"select doc_id, lang from {_RN} where rn >= 5 and (rn - 5) % 3 = 0 and (rn - 5) // 3 < 100")
def slice_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR1."""
    return order.slice_rows(_docs(spark, sf_dir, "doc_id", "lang"), ["doc_id"], 5, 100, 3)


@_query(f"select doc_id from {_RN} where rn >= 10 and rn < 200 and (rn - 10) % 7 = 0")
def slice_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR2: stop is absolute."""
    return order.slice_args(_docs(spark, sf_dir, "doc_id"), ["doc_id"], 10, 200, 7)


@_query(f"select doc_id, rn::bigint as rn from {_RN} where rn < 50")
def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR3."""
    return order.with_rank(order.take(_docs(spark, sf_dir, "doc_id"), ["doc_id"], 50), ["doc_id"])


@_query(f"select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber) - 1 as rn from lineitem")
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank that all ordered operators stand on, by two columns."""
    return order.with_rank(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@_query("select e.epoch, n_nationkey, n_name from nation, (select unnest(range(3)) as epoch) e")
def repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR9."""
    return order.repeat(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 3)


@_query("""select r_regionkey, epoch, rn from (select r_regionkey, epoch, epoch * 5 + row_number() over (partition by epoch order by r_regionkey) - 1 as rn
    from region, (select unnest(range(3)) as epoch)) where rn < 13""")
def with_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR10."""
    return order.with_epoch(_t(spark, sf_dir, "region").select("r_regionkey"), ["r_regionkey"], 13)


@_query("""select r_regionkey, epoch, rn - 3 as rn from (select r_regionkey, epoch, epoch * 5 + row_number() over (partition by epoch order by r_regionkey) - 1 as rn
    from region, (select unnest(range(4)) as epoch)) where rn >= 3 and rn < 16""")
def with_epoch_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR11: the second epoch of 13 goes on where the first stopped (13 mod 5 = 3)."""
    return order.with_epoch(_t(spark, sf_dir, "region").select("r_regionkey"), ["r_regionkey"], 13, 13)


# -- draws -------------------------------------------------------------------------


@_query("select doc_id, source from documents where md5('7:' || doc_id) < '4000000000000000' || repeat('0', 16)")
def rsample_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR4 with p = 1/4."""
    return sampling.random_subsample(_docs(spark, sf_dir, "doc_id", "source"), 0.25, 7, "doc_id")


@_query("select doc_id, row_number() over (order by md5('3:0:0:' || doc_id), doc_id) - 1 as rn from documents")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR5, OR6: a seeded global order."""
    return sampling.shuffle_order(_docs(spark, sf_dir, "doc_id"), 3, "doc_id")


@_query(f"""select doc_id, row_number() over (order by place, rn) - 1 as rn from (select doc_id, rn, rn + ('0x' || substr(md5('5:' || rn), 1, 8))::bigint % 100 as place from {_RN})""")
def shuffle_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR5 with a reach of 100."""
    return sampling.shuffle_buffered(_docs(spark, sf_dir, "doc_id"), ["doc_id"], 100, 5)


@_query("select doc_id from documents order by md5('11:' || doc_id), doc_id limit 30")
def choose_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL10: so many without replacement."""
    return sampling.choose(_docs(spark, sf_dir, "doc_id"), 30, 11, "doc_id")


@_query(f"""select doc_id, draw from (select range as draw, ('0x' || substr(md5('13:0:' || range), 1, 8))::bigint % (select count(*) from documents) as rn from range(500)) join {_RN} using (rn)""")
def resampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL17: draws with replacement."""
    return sampling.resample(_docs(spark, sf_dir, "doc_id"), ["doc_id"], 500, 13)


_SHARDS = "(select source as url, row_number() over (order by source) - 1 as ord from (select distinct source from documents))"


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_rank(_docs(spark, sf_dir, "source").distinct().withColumnRenamed("source", "url"), ["url"], names.SHARD_ORD)


def _out(df: DataFrame) -> DataFrame:
    return df.select(F.col(names.SHARD_ORD).alias("ord"), "url")


@_query(f"select row_number() over (order by md5('5:1:' || url), ord) - 1 as ord, url from {_SHARDS}")
def shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL3, in epoch 1."""
    return _out(shardlists.shuffled(_shards(spark, sf_dir), 5, 1))


@_query(f"select draw as ord, url from (select range as draw, ('0x' || substr(md5('9:0:0:' || range), 1, 8))::bigint % (select count(*) from {_SHARDS}) as ord from range(64)) join {_SHARDS} using (ord)")
def resampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL4."""
    return _out(shardlists.resampled(_shards(spark, sf_dir), 64, 9))


@_query(f"select row_number() over (order by ord) - 1 as ord, url from {_SHARDS} where ord % 3 = 1")
def split_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL5: node 1 of 3."""
    return _out(shardlists.split_by_node(_shards(spark, sf_dir), 1, 3))


@_query(f"select row_number() over (order by o) - 1 as ord, url from (select row_number() over (order by ord) - 1 as o, url from {_SHARDS} where ord % 3 = 1) where o % 2 = 0")
def split_by_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL6: worker 0 of 2, over what node 1 of 3 has."""
    return _out(shardlists.split_by_worker(shardlists.split_by_node(_shards(spark, sf_dir), 1, 3), 0, 2))


# -- maps and projections ------------------------------------------------------------


@_query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 1000")
def select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR1; the filter reaches the scan."""
    return transform.select(_t(spark, sf_dir, "orders"), "o_orderstatus = 'F' and o_totalprice > 1000").select("o_orderkey", "o_totalprice")


@_query("select l_orderkey, l_linenumber, round(l_extendedprice * 2, 2) as l_extendedprice from lineitem")
def map_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR3."""
    return transform.map_field(_t(spark, sf_dir, "lineitem"), "l_extendedprice", lambda c: F.round(c * 2, 2)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@_query("select upper(n_name) as n_name, n_regionkey::bigint + 1 as n_regionkey, n_nationkey from nation")
def map_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR4."""
    return transform.map_dict(_t(spark, sf_dir, "nation"), n_name=F.upper, n_regionkey=lambda c: c.cast("long") + 1)


@_query("select doc_id * 2 as doc_id, source from documents where doc_id % 2 = 0")
def map_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR2: a function over frames that drops rows."""
    return transform.map_sample(_docs(spark, sf_dir, "doc_id", "source"), lambda x: x[x["doc_id"] % 2 == 0].assign(doc_id=lambda y: y["doc_id"] * 2))


@_query("select o_orderstatus as _0, o_orderkey as _1 from orders")
def to_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR5, TR6: the first present of several names."""
    return transform.to_tuple(_t(spark, sf_dir, "orders"), "status;o_orderstatus o_orderkey")


@_query("select d.doc_id, coalesce(l.quality::varchar, d.lang) as _0 from documents d left join labels l using (doc_id)")
def to_tuple_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR7: alternatives row by row."""
    both = _docs(spark, sf_dir, "doc_id", "lang").join(_t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("cls")), "doc_id", "left")
    return transform.to_tuple(both, "cls;lang", keep=["doc_id"])


@_query("select c_custkey, c_name as _0, c_acctbal as _1 from customer")
def extract_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR8: fields by glob."""
    return transform.extract_keys(_t(spark, sf_dir, "customer"), "*name", "x*;*acctbal", keep=["c_custkey"])


@_query("select s_suppkey, s_nationkey, s_acctbal, s_name as name from supplier")
def rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR10."""
    return transform.rename(_t(spark, sf_dir, "supplier"), name="title;s_name")


@_query("select p_name as name, p_size as size from part")
def rename_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR11."""
    return transform.rename_keys(_t(spark, sf_dir, "part"), name="*_name", size="*_si?e")


@_query("select lower(p_brand) as _0, p_size::bigint * 10 as _1 from part")
def map_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR13."""
    return transform.map_tuple(transform.to_tuple(_t(spark, sf_dir, "part"), "p_brand", "p_size"), F.lower, lambda c: c.cast("long") * 10)


@_query("select doc_id, lang, source, quality, toxic from documents left join labels using (doc_id)")
def associate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR15: a lookup by key that keeps unknown keys."""
    return transform.associate(_docs(spark, sf_dir, "doc_id", "lang", "source"), _t(spark, sf_dir, "labels"), "doc_id")


# -- batches -------------------------------------------------------------------------


@_query(f"select rn // 64 as batch_id, string_agg(doc_id::varchar, ',' order by rn) as ids, sum(n_chars)::bigint as total from {_RN} group by 1")
def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BA2, BA4."""
    out = batch.batched(_docs(spark, sf_dir, "doc_id", "n_chars"), ["doc_id"], 64)
    return out.select("batch_id", F.array_join(F.transform("doc_id", lambda x: x.cast("string")), ",").alias("ids"), F.aggregate("n_chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@_query(f"select rn // 64 as batch_id, string_agg(doc_id::varchar, ',' order by rn) as ids from {_RN} group by 1 having count(*) = 64")
def listed_drop_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BA1 without the short last group."""
    out = batch.listed(_docs(spark, sf_dir, "doc_id"), ["doc_id"], 64, partial=False)
    return out.select("batch_id", F.array_join(F.transform("items", lambda x: x["doc_id"].cast("string")), ",").alias("ids"))


@_query(f"select rn // 64 as batch_id, rn % 64 as pos, doc_id, lang from {_RN}")
def unbatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BA5: batches taken apart again."""
    return batch.unbatched(batch.batched(_docs(spark, sf_dir, "doc_id", "lang"), ["doc_id"], 64))


@_query("select doc_id, lang from documents")
def unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BA7."""
    return batch.unlisted(batch.listed(_docs(spark, sf_dir, "doc_id", "lang"), ["doc_id"], 10))


@_query(f"select rn // 50 as batch_id, count(*) as n, max(n_chars) as longest from {_RN} group by 1")
def custom_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BA9: a function over each batch's frame."""
    import pandas as pd

    def collate(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"first_id": [int(x["doc_id"].iloc[0])], "n": [len(x)], "longest": [int(x["n_chars"].max())]})

    out = batch.batched(_docs(spark, sf_dir, "doc_id", "n_chars"), ["doc_id"], 50, collation=collate, schema="first_id long, n long, longest long")
    ranked = order.with_rank(out, ["first_id"], "batch_id")
    return ranked.select("batch_id", "n", "longest")


@_query(f"select doc_id, rn // 300 as shard from {_RN}")
def shard_assign_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3 by count."""
    return batch.shard_by_count(_docs(spark, sf_dir, "doc_id"), ["doc_id"], 300)


@_query(f"""with recursive d as {_RN},
    r as (select rn, n_chars as held, 1 as n, 0::bigint as shard from d where rn = 0
          union all select d.rn, case when r.held >= 100000 or r.n >= 40 then d.n_chars else r.held + d.n_chars end, case when r.held >= 100000 or r.n >= 40 then 1 else r.n + 1 end,
          case when r.held >= 100000 or r.n >= 40 then r.shard + 1 else r.shard end from r join d on d.rn = r.rn + 1)
    select doc_id, shard from r join d using (rn)""")
def shard_assign_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3 by size or count, whichever comes first."""
    return batch.shard_by_size(_docs(spark, sf_dir, "doc_id", "n_chars"), ["doc_id"], F.col("n_chars"), 100_000, 40).select("doc_id", "shard")


# -- mixes ---------------------------------------------------------------------------


def _by_lang(spark: SparkSession, sf_dir: str) -> list[mix.Source]:
    """Documents by language; the last source has all others, and those without one."""
    docs = _docs(spark, sf_dir, "doc_id", "lang")
    known = ("de", "en", "es")
    parts = [F.col("lang") == x for x in known] + [F.col("lang").isNull() | ~F.col("lang").isin(*known)]
    return [(docs.where(p).select("doc_id"), ["doc_id"]) for p in parts]


_LANGS = """(select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as rn
    from (select doc_id, case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end as source from documents))"""


@_query(f"""with a as {_LANGS}, l as (select source, count(*) as n from a group by 1), c as (select n, source from l order by n, source limit 1)
    select a.doc_id, a.source::bigint as source, a.rn from a, c where a.rn < c.n or (a.rn = c.n and a.source < c.source)""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MX2: cut at the first source that is dry at its turn."""
    return mix.round_robin(_by_lang(spark, sf_dir))


@_query("""with a as (select 0 as source, n_nationkey as k, row_number() over (order by n_nationkey) - 1 as rn from nation
    union all select 1, r_regionkey, row_number() over (order by r_regionkey) - 1 from region
    union all select 2, s_suppkey, row_number() over (order by s_suppkey) - 1 from supplier where s_suppkey < 8),
    l as (select source, count(*) as n from a group by 1), c as (select n, source from l order by n, source limit 1)
    select a.k::bigint as k, a.source::bigint as source, a.rn from a, c where a.rn < c.n or (a.rn = c.n and a.source < c.source)""")
def round_robin_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MX2 where a source in the middle is dry first."""
    parts = (("nation", "n_nationkey", "true"), ("region", "r_regionkey", "true"), ("supplier", "s_suppkey", "s_suppkey < 8"))
    return mix.round_robin([(_t(spark, sf_dir, t).where(w).select(F.col(c).cast("long").alias("k")), ["k"]) for t, c, w in parts])


@_query(f"select doc_id, source::bigint as source, rn from {_LANGS}")
def round_robin_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MX2 to the end of the longest."""
    return mix.round_robin(_by_lang(spark, sf_dir), longest=True)


@_query(f"""with a as materialized (select * from {_LANGS}), l as materialized (select source, count(*) as n from a group by 1),
    d as (select range as draw, ('0x' || substr(md5('21:' || range), 1, 8))::bigint as h from range((select count(*) + 1 from documents))),
    s as (select draw, case when h < (4294967296 * 0.1)::bigint then 0 when h < (4294967296 * 0.6)::bigint then 1 when h < (4294967296 * 0.8)::bigint then 2 else 3 end as source from d),
    k as materialized (select draw, source, row_number() over (partition by source order by draw) - 1 as rn from s),
    e as materialized (select min(draw) as stop from k left join l using (source) where k.rn >= coalesce(l.n, 0))
    select a.doc_id, k.draw, a.source::bigint as source, a.rn from k join a using (source, rn), e where k.draw < e.stop""")
def random_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MX3 with weights 1, 5, 2, 2."""
    return mix.random_mix(_by_lang(spark, sf_dir), [1, 5, 2, 2], 21)


@_query("""select 0::bigint as source, row_number() over (order by doc_id) - 1 as rn, text as body from documents
    union all select 1, row_number() over (order by page_id) - 1, html from pages""")
def concat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MX1."""
    a = _docs(spark, sf_dir, "doc_id", "text").toDF("id", "body")
    b = _t(spark, sf_dir, "pages").select("page_id", "html").toDF("id", "body")
    return mix.concat([(a, ["id"]), (b, ["id"])]).drop("id")


# -- totals --------------------------------------------------------------------------

_FIELDS = """(select doc_id, source as url, 'txt' as field, octet_length(encode(text))::bigint as b from documents
    union all select doc_id, source, 'cls', length(quality::varchar) from documents join labels using (doc_id)
    union all select doc_id, source, 'json', octet_length(encode('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}')) from documents)"""


@_query(f"select count(distinct doc_id) as samples, sum(b)::bigint as payload_bytes, count(distinct url) as shards, (sum(b) // count(distinct doc_id))::bigint as mean_bytes from {_FIELDS}")
def info_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1."""
    return stats.totals(_raw_documents(spark, sf_dir))


@_query(f"select field, count(*) as samples, sum(b)::bigint as bytes, round(100.0 * count(*) / (select count(*) from documents), 3) as percent from {_FIELDS} group by 1")
def info_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2."""
    return stats.by_field(_raw_documents(spark, sf_dir))


@_query(f"select url, count(distinct doc_id) as samples, sum(b)::bigint as bytes from {_FIELDS} group by 1")
def info_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3."""
    return stats.by_shard(_raw_documents(spark, sf_dir))


@_query("select doc_id, sha256('text:' || text) as digest from documents")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6."""
    return _t(spark, sf_dir, "documents").select("doc_id", stats.canonical_digest(F.col("text")).alias("digest"))


# -- decoding ------------------------------------------------------------------------


@_query("select event_id, (props->>'$.k')::bigint as k from events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC7: bytes to VARIANT."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("props").cast("binary").alias("json"))
    return decode.decode(rows, only=["json"]).select("event_id", F.variant_get("json", "$.k", "bigint").alias("k"))


@_query("select doc_id, quality::bigint as cls from labels")
def cls_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC6: bytes to BIGINT, blanks around."""
    rows = _t(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit(" +"), F.col("quality").cast("string"), F.lit("\n")).cast("binary").alias("cls"))
    return decode.decode(rows)


@_query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 3) as total, len(embedding)::bigint as n from embeddings")
def tensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors through npy bytes and back."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", array_to_tensor("embedding").alias("npy"))
    back = decode.decode(rows.withColumn("npy", decode.encode_column(F.col("npy"), "npy", rows.schema["npy"].dataType)))
    flat = back.select("vec_id", tensor_to_array("npy").alias("a"))
    return flat.select("vec_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 3).alias("total"), F.size("a").cast("long").alias("n"))


_TOTAL = "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 3) as total, len(embedding)::bigint as n from embeddings"


def _through(spark: SparkSession, sf_dir: str, name: str, pack: Callable, unpack: Callable) -> DataFrame:
    """Embeddings as tensors, through a field's bytes and back; their sums and lengths."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", pack(array_to_tensor("embedding")).alias(name))
    back = decode.decode(rows.withColumn(name, decode.encode_column(F.col(name), name, rows.schema[name].dataType)))
    flat = back.select("vec_id", tensor_to_array(unpack(F.col(name))).alias("a"))
    return flat.select("vec_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 3).alias("total"), F.size("a").cast("long").alias("n"))


@_query(_TOTAL)
def npy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN5, DC8."""
    return _through(spark, sf_dir, "npy", lambda t: t, lambda t: t)


@_query(_TOTAL)
def npz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN6, DC9: a map of tensors as an archive."""
    return _through(spark, sf_dir, "npz", lambda t: F.create_map(F.lit("x"), t), lambda m: F.element_at(m, "x"))


@_query(_TOTAL)
def tenbin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN6, DC10: a list of tensors."""
    return _through(spark, sf_dir, "ten", lambda t: F.array(t, t), lambda a: F.get(a, F.lit(1)))


def _props(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"))
    packed = rows.select("event_id", decode.encode_column(F.col("v"), name, rows.schema["v"].dataType).alias(name))
    back = decode.decode(packed, only=[name])
    return back.select("event_id", F.variant_get(transform.quoted(name), "$.k", "bigint").alias("k"))


@_query("select event_id, (props->>'$.k')::bigint as k from events")
def msgpack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN6, DC11."""
    return _props(spark, sf_dir, "msgpack")


@_query("select event_id, (props->>'$.k')::bigint as k from events")
def cbor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN6, DC12, and DC14: gzipped besides."""
    return _props(spark, sf_dir, "cbor.gz")


@_query("select doc_id, text as body, length(text)::bigint as n from documents")
def gzip_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DC14, DC5: text behind a second extension."""
    rows = _docs(spark, sf_dir, "doc_id", "text")
    packed = rows.select("doc_id", decode.encode_column(F.col("text"), "txt.gz", rows.schema["text"].dataType).alias("txt.gz"))
    return decode.decode(packed).select("doc_id", F.col("`txt.gz`").alias("body"), F.length("`txt.gz`").cast("long").alias("n"))


def _flat_images(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A picture of 8 x 8 equal pixels for each nation, written and read."""
    one = lambda c: F.lpad(F.hex(c), 2, "0")
    grey = F.col("n_nationkey").cast("long") * 10
    pixel = one(grey) if name == "jpg" else F.concat(one(grey), one(F.col("n_regionkey").cast("long") * 50), one(F.lit(255).cast("long")))
    shape = F.array(F.lit(8), F.lit(8)) if name == "jpg" else F.array(F.lit(8), F.lit(8), F.lit(3))
    tensor = F.struct(F.lit("uint8").alias("dtype"), shape.alias("shape"), F.unhex(F.repeat(pixel, 64)).alias("data")).cast(decode.TENSOR)
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", tensor.alias(name))
    packed = rows.select("n_nationkey", decode.encode_column(F.col(name), name, rows.schema[name].dataType).alias(name))
    back = decode.decode(packed, "rgb8", only=[name]).select("n_nationkey", F.col(name)["shape"].alias("shape"), tensor_to_array(name).alias("a"))
    return back.select("n_nationkey", F.array_join("shape", "x").alias("shape"), F.aggregate("a", F.lit(0.0), lambda s, x: s + x).cast("long").alias("total"))


@_query("select n_nationkey, '8x8x3' as shape, (64 * (n_nationkey::bigint * 10 + n_regionkey::bigint * 50 + 255))::bigint as total from nation")
def png_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN7, DC16 to DC18."""
    return _flat_images(spark, sf_dir, "png")


@_query("select n_nationkey, '8x8x3' as shape, (192 * n_nationkey::bigint * 10)::bigint as total from nation")
def jpeg_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN7, DC16: a grey JPEG read as RGB; equal pixels come back exactly."""
    return _flat_images(spark, sf_dir, "jpg")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as class fields, some of which are no integers."""
    rows = _t(spark, sf_dir, "labels").where("quality is not null")
    return rows.select("doc_id", F.when(F.col("doc_id") % 97 == 50, F.lit("x1")).otherwise(F.col("quality").cast("string")).cast("binary").alias("cls"))


@_query("select doc_id, quality::bigint as cls from labels where quality is not null and doc_id % 97 <> 50")
def decode_errors_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler that goes on: samples with a field that can't be decoded are left out."""
    return decode.decode(_damaged(spark, sf_dir), handler="ignore_and_continue", order_by=["doc_id"])


@_query("""select doc_id, quality::bigint as cls from labels where quality is not null
    and doc_id < coalesce((select min(doc_id) from labels where quality is not null and doc_id % 97 = 50), 9223372036854775807)""")
def decode_errors_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler that stops: nothing of the first such sample or after it is left."""
    return decode.decode(_damaged(spark, sf_dir), handler="warn_and_stop", order_by=["doc_id"])


@_query("select doc_id * 2 as doc_id, lang from documents where doc_id % 10 <> 3")
def map_errors_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map that fails for some samples, with a handler that goes on."""

    def twice(x):
        if (x["doc_id"] % 10 == 3).any():
            raise ValueError("three")
        return x.assign(doc_id=x["doc_id"] * 2)

    return transform.map_sample(_docs(spark, sf_dir, "doc_id", "lang"), twice, handler="ignore_and_continue", order_by=["doc_id"])


# -- shards --------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that executors share: under spark.checkpoint.dir where that is set."""
    import uuid

    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held and not spark.sparkContext.master.startswith("local"):
        raise ValueProblem("spark.checkpoint.dir must name a folder that all executors share")
    return f"{held.rstrip('/')}/shards-{uuid.uuid4().hex}" if held else "file://" + tempfile.mkdtemp(prefix="shards-")


def _written(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    raw = _raw_documents(spark, sf_dir).withColumn("shard", F.col(names.SHARD_ORD))
    return shards.write_shards(raw, _scratch(spark), pattern)


@_query("""select lpad(doc_id::varchar, 9, '0') as sample_key, text as txt, quality::bigint as cls, lang, source from documents left join labels using (doc_id)""")
def roundtrip_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1, RD11, decoders: documents written as tar shards, scanned and decoded."""
    manifest = _written(spark, sf_dir, "docs-%03d.tar.gz").select(F.col("shard").alias(names.SHARD_ORD), "url")
    data = ShardDataset.from_shards(spark, manifest, nodesplit="none").project("txt", "cls", "json").decode()
    return data.df.select(F.col(names.KEY).alias("sample_key"), "txt", "cls", F.variant_get("json", "$.lang", "string").alias("lang"), F.variant_get("json", "$.source", "string").alias("source"))


_SCANNED = "(select doc_id, n_chars, row_number() over (order by substr(source, 4)::bigint, lpad(doc_id::varchar, 9, '0')) - 1 as rn from documents)"


def _scanned(spark: SparkSession, sf_dir: str) -> ShardDataset:
    manifest = _written(spark, sf_dir, "part-%03d.tar").select(F.col("shard").alias(names.SHARD_ORD), "url")
    return ShardDataset.from_shards(spark, manifest, nodesplit="none").project("txt").decode()


@_query(f"select rn // 64 as batch_id, string_agg(lpad(doc_id::varchar, 9, '0'), ',' order by rn) as keys, sum(n_chars)::bigint as total from {_SCANNED} group by 1")
def scan_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in the order of shards and positions, whose ranks need no sort."""
    out = _scanned(spark, sf_dir).batched(64).df
    return out.select("batch_id", F.array_join(names.KEY, ",").alias("keys"), F.aggregate("txt", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("total"))


@_query(f"""select row_number() over (order by place, rn) - 1 as rn, lpad(doc_id::varchar, 9, '0') as sample_key
    from (select doc_id, rn, rn + ('0x' || substr(md5('4:' || rn), 1, 8))::bigint % 200 as place from {_SCANNED})""")
def scan_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffered shuffle of scanned samples."""
    out = _scanned(spark, sf_dir).shuffle(200, seed=4)
    return out.df.select(F.col(out.rank).alias("rn"), F.col(names.KEY).alias("sample_key"))


@_query("select source, count(*) as samples, sum(octet_length(encode(text)))::bigint as txt_bytes from documents group by 1")
def shard_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a shard list scanned, samples counted by shard."""
    manifest = _written(spark, sf_dir, "src%d.tar").select(F.col("shard").alias(names.SHARD_ORD), "url")
    raw = shards.read_shards(manifest, fields=["txt"])
    return raw.groupBy(F.regexp_extract(names.URL, r"(src\d+)\.tar$", 1).alias("source")).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.octet_length(F.element_at("fields", "txt"))).cast("long").alias("txt_bytes"))
