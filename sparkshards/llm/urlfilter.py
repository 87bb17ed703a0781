"""URL filters: explicit host/path rules, and mined association rules for the rest.

Explicit rules are looked up in an index by host: a url's host and all its parent
domains are looked up, the longest rule whose path starts the url's path wins.

For other urls, Spark's FP-growth mines combinations of url tokens (host labels,
path segments, query keys; numbers as one token) from labelled pages, with the
label as one more item.  Rules that conclude the label are kept if support and
confidence are high enough and no shorter rule says as much.  Each kept rule is
indexed under its rarest token; distinct urls meet it by an equi-join on that token
and match if they hold all its tokens.

Everything is DataFrame functions.  Edge cases: a null url, or one without "://",
has an empty host and path, no tokens, no rule, and is allowed; null labels are not
learned from; repeated rows are judged each; without labels all such urls are
allowed; other columns are kept only if named.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "=block"
#: Rules up to this number and size are sent to all executors, more are joined by a shuffle.
BROADCAST_RULES, BROADCAST_BYTES = 50_000, 8 << 20


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; rules are (host/path, verdict)."""
    by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        by_host[name.translate(str.maketrans(_UPPER, _LOWER))].append((slash + rest, rule, verdict))
    entry = lambda p, r, v: F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path"))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    index = F.create_map(*[x for name, held in sorted(by_host.items()) for x in (F.lit(name), F.array(*[entry(*h) for h in held]))])
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.filter(F.transform(domains, lambda d: F.element_at(index, d)), lambda x: x.isNotNull())
    fits = F.filter(F.flatten(known), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(F.size(fits) > 0, F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments, query keys; numbers count as one token."""
    plain = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), plain(p)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(tagged("h:", F.split(host_of(url), r"\.")), tagged("p:", F.split(path_of(url), "/")), tagged("q:", keys))))


def merge_tokens(labelled: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """(items, block) of each row, and (item, tokens, freq): tokens that always come together are one item.

    Tokens in the same rows have the same support in every combination, so one of them
    (the first) stands for all, and a long path that many urls share is not enumerated by
    its subsets.  Tokens in fewer than ``min_rows`` rows can be in no rule and are left out.
    """
    rows = labelled.select(url_tokens(F.col("url")).alias("tokens"), "block", F.xxhash64("url", "block").alias("h"))
    # equal rows: same number and same sums of two hashes of the rows that hold them
    seen = rows.select(F.explode("tokens").alias("token"), "h").groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("s2"))
    groups = seen.where(F.col("freq") >= min_rows).groupBy("freq", "s", "s2").agg(F.array_sort(F.collect_list("token")).alias("tokens"))  # tokens of one url
    items = cut(groups.select(F.col("tokens")[0].alias("item"), "tokens", "freq"))
    firsts = items.select(F.col("item").alias("token"))
    rows = rows.select("block", "tokens", F.xxhash64("tokens", "block").alias("k")).groupBy("k", "block", "tokens").agg(F.count(F.lit(1)).alias("n"))
    held = rows.select("k", F.explode("tokens").alias("token")).join(firsts, "token").groupBy("k").agg(F.array_sort(F.collect_list("token")).alias("items"))
    out = rows.join(held, "k", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "block", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth")).drop("nth")
    return out, items


def mine_rules(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.7, min_rows: int = 20) -> DataFrame:
    """(key token, tokens, confidence, support) of the rules that conclude a block.

    ``labelled``: url and block (boolean).  A combination must occur in ``min_support``
    of the labelled rows and in ``min_rows`` of them at least.
    """
    known = labelled.where(F.col("block").isNotNull() & F.col("url").isNotNull()).select("url", "block")
    n = known.count()
    none = labelled.sparkSession.createDataFrame([], "token string, tokens array<string>, confidence double, support double")
    if n == 0:
        return none
    least = max(min_rows, math.ceil(min_support * n))
    rows, items = merge_tokens(known, least)
    baskets = cut(rows.select(F.when(F.col("block"), F.array_append("items", LABEL)).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == LABEL))
    found = cut(found.select(F.array_sort("antecedent").alias("items"), "confidence", "support").withColumn("rule_id", F.md5(F.array_join("items", "\n"))))
    # a rule stands under its rarest item; another rule or a url that holds all its items holds that one
    each = found.select("rule_id", F.explode("items").alias("item")).join(items, "item")
    keys = each.groupBy("rule_id").agg(F.min(F.struct("freq", "item"))["item"].alias("item"), F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    keyed = found.join(keys, "rule_id")
    # a rule is dropped if one with fewer items, all among its own, is as confident
    shorter = keyed.select("item", F.col("items").alias("less"), F.col("confidence").alias("c"))
    longer = found.select(F.explode("items").alias("item"), "rule_id", "items", "confidence")
    covered = longer.join(shorter, "item").where((F.size("less") < F.size("items")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("less", "items")) == 0)).select("rule_id").distinct()
    return cut(keyed.join(covered, "rule_id", "left_anti").select(F.col("item").alias("token"), "tokens", "confidence", "support"))


def match_mined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that some rule fits, each with its best confidence."""
    # each rule stands under one token, so a url meets it once at most
    tokens = urls.where(F.col("url").isNotNull()).select("url").distinct().withColumn("all_tokens", url_tokens(F.col("url")))
    probes = tokens.select("url", "all_tokens", F.explode("all_tokens").alias("token"))
    met = probes.join(rules, "token").where(F.size(F.array_except("tokens", "all_tokens")) == 0)
    return met.groupBy("url").agg(F.max("confidence").alias("confidence"))


def rule_labels(urls: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """(url, block) of the urls that an explicit rule judges: labels to mine from."""
    rows = urls.select(F.col(url_col).cast("string").alias("url"))
    fit = match_rules(host_of(F.col("url")), path_of(F.col("url")), rules)
    return rows.select("url", (fit["verdict"] == "block").alias("block")).where("block is not null")


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", min_support: float = 0.001, min_confidence: float = 0.7, min_rows: int = 20) -> DataFrame:
    """id, url, host, path, rule, verdict and, where mined rules blocked, their confidence."""
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("fit", match_rules(F.col("host"), F.col("path"), rules))
    mined = mine_rules(labelled, min_support, min_confidence, min_rows)
    size = mined.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.array_join("tokens", ","))).alias("b")).first()
    if size["n"] <= BROADCAST_RULES and (size["b"] or 0) <= BROADCAST_BYTES:
        mined = F.broadcast(mined)
    # only urls that no explicit rule judges meet the mined ones
    left = F.col("url").isNotNull() & F.col("fit").isNull()
    blocked = match_mined(rows.where(left), mined)
    none = F.lit(None).cast("double")
    out = rows.where(left).join(blocked, "url", "left").select(*rows.columns, "confidence").unionByName(rows.where(~left).withColumn("confidence", none))
    return out.select(id_col, "url", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
