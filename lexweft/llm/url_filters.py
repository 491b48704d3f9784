"""URL filters: stated host and path rules, and association rules mined from labels by FP-growth.

URLs become token sets (host suffixes, path segment, extension, query keys, scheme). FP-growth finds token
combinations that go with blocked pages; rules of enough support and confidence stand in an inverted index from
token to rule. A URL meets it token by token; a rule fires when all its tokens were met. DataFrame functions
and the JVM's FP-growth only.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

BLOCK = "label:block"
#: Rows of the index up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, with A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def tokens(url: str = "url", host: str = "host", path: str = "path") -> Column:
    """Distinct tokens of a URL: h: host suffixes, p: first path segment, x: extension, q: query keys, s: scheme."""
    return F.expr(f"""array_distinct(filter(flatten(array(
        transform(sequence(1, size(split({host}, '[.]'))), i -> 'h:' || substring_index({host}, '.', -i)),
        array('p:' || regexp_extract({path}, '^/([^/]+)/', 1), 'x:' || lower(regexp_extract({path}, '[.]([A-Za-z0-9]+)$', 1)),
              's:' || lower(regexp_extract({url}, '^([A-Za-z]+)://', 1))),
        transform(split(regexp_extract({url}, '[?]([^#]*)', 1), '&'), q -> 'q:' || substring_index(q, '=', 1))
    )), t -> length(t) > 2))""")


def judged(urls: DataFrame) -> DataFrame:
    """Adds host and path to a frame with a url column."""
    return urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and block (boolean) of pages whose path names a labelled document (/<lang>/<doc_id>).

    A page is blocked if its document is of quality 0 or toxic.
    """
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("block"))
    named = judged(pages.select("url").distinct()).withColumn("doc_id", F.expr("try_cast(regexp_extract(path, '^/[^/]+/([0-9]{1,18})', 1) as bigint)"))
    return named.where("doc_id is not null").join(known, "doc_id").select("url", "host", "path", "block")


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.001, min_count: int = 20, min_confidence: float = 0.7) -> DataFrame:
    """Mined rules: rule (text), needs (array of tokens), support, confidence, lift.

    Null urls, and pages whose document has no label, take no part; repeated urls count once. Labels that urls don't
    foretell give no rules.

    A rule says: a page with all its tokens is blocked. It needs at least ``min_support`` of the labelled pages
    and ``min_count`` of them, ``min_confidence``, and no shorter rule within it that is as confident; it may
    have any number of tokens. Without labelled pages there are no rules.
    """
    rows = labelled(pages, labels).select(tokens().alias("tokens"), "block")
    items = F.when(F.col("block"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens"))
    baskets = scratch(rows.select(items.alias("items"), "block"), "baskets")
    n, blocked = (lambda r: (r["n"], r["blocked"] or 0))(baskets.agg(F.count("*").alias("n"), F.sum(F.col("block").cast("long")).alias("blocked")).first())
    empty = "rule string, needs array<string>, support double, confidence double, lift double"
    if not n or not blocked:
        return pages.sparkSession.createDataFrame([], empty)
    # FP-growth passes over tokens that hold less often than a rule may.
    support = max(min_support, min_count / n)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK))
    rules = rules.select(F.array_sort("antecedent").alias("needs"), "support", "confidence", "lift")
    rules = scratch(rules.withColumn("rule", F.array_join("needs", "&")), "rules")
    inner = rules.select(F.col("needs").alias("less"), F.col("confidence").alias("less_confidence"), F.col("rule").alias("less_rule"), F.explode("needs").alias("token"))
    outer = rules.select("rule", "needs", "confidence", F.explode("needs").alias("token"))
    covered = outer.join(inner, "token").where((F.col("rule") != F.col("less_rule")) & (F.col("confidence") <= F.col("less_confidence")) & (F.size(F.array_except("less", "needs")) == 0))
    return rules.join(covered.select("rule").distinct(), "rule", "left_anti")


def match(pages: DataFrame, stated: list[tuple[str, str]], mined: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence of every page.

    ``stated``: (verdict, rule) with rules like example.com/en/; a rule fits its host and all subdomains if the
    path starts with the rule's; the longest fitting one decides. Else a mined rule blocks (the most confident
    one, ties to the smaller name), else the verdict is ``default``. Null and malformed URLs have an empty host and
    path and fit no stated rule. Equal URLs are judged once; repeated pages each get their row; other columns
    are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = [(f"h:{r.split('/', 1)[0]}", r, 1, "/" + r.split("/", 1)[1], v, None) for v, r in stated]
    kinds = "token string, rule string, needed int, prefix string, verdict string, confidence double"
    index = spark.createDataFrame(rows, kinds)
    learnt = mined.select(F.explode("needs").alias("token"), "rule", F.size("needs").alias("needed"), F.lit(None).cast("string").alias("prefix"), F.lit("block").alias("verdict"), "confidence")
    index = scratch(index.unionByName(learnt), "rule-index")
    size = index.count()
    index = F.broadcast(index) if size <= BROADCAST_ROWS else index

    urls = judged(pages.select("url").where("url is not null").distinct())
    met = urls.select("url", "path", F.explode(tokens()).alias("token")).join(index, "token")
    met = met.where(F.col("prefix").isNull() | F.expr("startswith(path, prefix)"))
    fired = met.groupBy("url", "rule", "verdict", "needed", "confidence").agg(F.count("*").alias("found")).where("found = needed")
    own = F.when(F.col("confidence").isNull(), F.struct(F.length("rule").alias("size"), "rule", "verdict"))
    learnt = F.when(F.col("confidence").isNotNull(), F.struct((-F.col("confidence")).alias("cost"), "rule"))
    # Written, so that the join meets plain exchanges and Spark can split a url that very many pages have. It packs so well
    # that its size in files is no bound for a broadcast.
    best = scratch(fired.groupBy("url").agg(F.max(own).alias("own"), F.min(learnt).alias("learnt")), "judged")
    named = judged(pages.select("page_id", "url"))
    without = named.where("url is null").select("*", *[F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("own", "learnt")])
    out = named.where("url is not null").join(best.hint("merge"), "url", "left").unionByName(without)
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("learnt").isNotNull(), F.lit("block")), F.lit(default))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), F.col("learnt.rule").alias("mined_rule"), (-F.col("learnt.cost")).alias("confidence"))
