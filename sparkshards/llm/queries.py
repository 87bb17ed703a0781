"""The queries over the driver's tables, one for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, jaccard, langid, quality, sharding, tokencounts, urlfilter, warc
from .common import fold, table
from .packing import pack_documents


SHARD_BYTES = 1 << 20
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 4096, 1)


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, of at most 1 MiB of text each."""
    found = sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return found.select("doc_id", F.col("bytes").alias("n_bytes"), "shard_id", "shard_bytes", F.col("depth").cast("long").alias("depth"))


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged.

    Labels to mine from: the verdicts of the explicit rules on the urls they judge, and of the
    others those pages whose number has a label, bad if it is of low quality or toxic.
    """
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    others = pages.select("page_id", "url").where(urlfilter.match_rules(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url")), URL_RULES).isNull())
    labelled = urlfilter.rule_labels(pages, URL_RULES).unionByName(others.join(marks, "page_id").select("url", (F.col("bad") == 1).alias("block")))
    found = urlfilter.judge(pages, labelled, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    found = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return found.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    langs, matrix = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    found = langid.identify(docs, langs, matrix, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from four of five folds."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    found = quality.score(docs, model, 0.3, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"), digest="md5")


def op9_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded as a whole."""
    import public_tokenizers

    found = tokencounts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "section", "char_start", "char_end", F.col("tokens").cast("long").alias("tokens"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 80, 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_shard": op2_shard,
    "op3_urlfilter": op3_urlfilter,
    "op4_decontaminate": op4_decontaminate,
    "op5_langid": op5_langid,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_fingerprints": op8_fingerprints,
    "op9_tokencounts": op9_tokencounts,
    "op10_jaccard": op10_jaccard,
}

_PARAGRAPHS = f"""list_distinct(list_transform(list_filter(flatten(list_transform(string_split({{}}, chr(10)),
    lambda y: case when length(y) > {fingerprints.LONG_LINE} then string_split(regexp_replace(y, '([.?!])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) else [y] end)), lambda x: x <> ''),
    lambda x: ('0x' || substr(md5(x), 1, 15))::bigint))"""
_CELLS = f"""len({{0}}) || ':' || array_to_string(list_transform(list_transform(range(24), lambda c: list_filter({{0}}, lambda d: (d >> ((c // 8) * 3)::int) & 7 = c % 8)),
    lambda l: case when len(l) = 0 then '' else to_hex(list_aggregate(l, 'bit_xor')) || '.' || to_hex(list_sum(list_transform(l, lambda d: {fingerprints.MARK_BASE} + d % {fingerprints.MARK_PRIME}))::bigint) end), ',')"""
_LIKENESS = "case when len({0}) + len({1}) = 0 then 1.0::double else len(list_intersect({0}, {1}))::double / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) end"

#: DuckDB SQL where it can express the query.
ORACLE_SQL: dict[str, str] = {
    "op2_shard": f"""
        with d as (select doc_id, coalesce(strlen(text), 0) as n_bytes, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as h from documents),
        sums as (select depth, h >> (60 - depth) as prefix, sum(n_bytes)::bigint as bytes from d, range(0, 61) t(depth) group by all),
        leaf as (select doc_id, n_bytes, min(depth) as depth from d, sums
                 where prefix = h >> (60 - depth) and bytes <= {SHARD_BYTES} group by doc_id, n_bytes)
        select l.doc_id, l.n_bytes, 's' || case when l.depth = 0 then '' else right(lpad(bin(d.h), 60, '0')[1:l.depth], l.depth::int) end as shard_id, s.bytes as shard_bytes, l.depth::bigint as depth
        from leaf l join d using (doc_id) join sums s on s.depth = l.depth and s.prefix = d.h >> (60 - l.depth)""",
    "op6_warc": """
        with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
        f as (select h, min(page_id) as first from p group by h),
        r as (select p.*, first, row_number() over (partition by h, page_id order by page_id) as nth from p join f using (h))
        select page_id, n::bigint as payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
            case when page_id = first and nth = 1 then 'response' else 'revisit' end as record_type,
            case when page_id = first and nth = 1 then null else first end as refers_to
        from r""",
    "op8_fingerprints": f"""
        with o as (select doc_id, coalesce(text, '') as text, coalesce(lead(coalesce(text, '')) over w, first_value(coalesce(text, '')) over w) as next
                   from documents window w as (order by doc_id desc rows between unbounded preceding and unbounded following)),
        e as (select *, length(text)::bigint as n_chars, substr(text, 1, length(text) - length(text) // 3) || substr(next, 1, length(text) // 3) as edited from o),
        k as (select doc_id, n_chars, sha256(edited) as edited_sha256, {_PARAGRAPHS.format('text')} as kt, {_PARAGRAPHS.format('edited')} as ke, {_PARAGRAPHS.format('next')} as kn from e)
        select doc_id, n_chars, edited_sha256, {_CELLS.format('kt')} as fingerprint, {_CELLS.format('ke')} as edited_fingerprint,
            {_LIKENESS.format('kt', 'ke')} as near_edited, {_LIKENESS.format('kt', 'kn')} as near_next from k""",
    "op10_jaccard": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
        p as (select doc_id, len(ws) as m, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
        b as (select doc_id, m, i, concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o) as gram from p window o as (partition by doc_id order by i)),
        s as (select doc_id, list(distinct gram order by gram) as grams from b where i <= greatest(m - 4, 1) group by doc_id),
        a as (select doc_id, coalesce(grams, []) as grams from documents left join s using (doc_id)),
        g as (select doc_id, len(grams)::bigint as n, min(doc_id) over (partition by md5(array_to_string(grams, chr(10)))) as node, grams from a),
        u as (select node, n, grams from g where doc_id = node and n > 0),
        t as (select node, unnest(grams[1:(n - (80 * n + 99) // 100 + 1)]) as gram from u),
        c as (select distinct q.node as x, r.node as y from t q join t r on q.gram = r.gram and q.node < r.node),
        i as (select x, y, q.n as nx, r.n as ny, len(list_intersect(q.grams, r.grams)) as i from c join u q on q.node = x join u r on r.node = y),
        l as (select x, y from i where 100 * i >= 80 * (nx + ny - i)),
        e as (select x, y from l union all select y, x from l),
        r(node, other) as (select distinct x, x from e union select r.node, e.y from r join e on e.x = r.other),
        m as (select node, min(other) as least from r group by node)
        select g.doc_id, g.n as n_shingles, case when g.n = 0 then g.doc_id else coalesce(m.least, g.node) end as component_id from g left join m on g.node = m.node""",
}
