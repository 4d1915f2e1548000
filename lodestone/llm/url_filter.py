"""URL filtering by rules and, where none fits, by association rules mined from labels.

URLs become sets of tokens, and tokens that always occur together one item.
FP-growth mines the item combinations of labelled URLs; rules that end in the
blocking label and reach the confidence are kept, each filed under the rarest
item of its condition. A URL looks up its items and is blocked if the whole
condition of a rule found there holds.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch

# No token has this prefix.
BLOCKED = "class=block"
# Classes of tokens and rules are broadcast up to this number, and joined as Spark sees fit beyond it.
BROADCAST_ROWS = 100_000


def parts(url: str) -> tuple[F.Column, F.Column]:
    """(host, path): after the first "://" up to "/", "?", "#" or the end, and from there up to "?", "#" or the end."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: str) -> F.Column:
    """Host labels, the host, path segments (digits as one sign), names of query parameters, and whether there is a fragment."""
    host, path = parts(url)
    u = F.coalesce(F.col(url), F.lit(""))
    tag = lambda name, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(f"{name}="), x))
    query = F.split(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), "&")
    return F.array_distinct(
        F.concat(
            tag("label", F.split(host, r"\.")),
            tag("host", F.array(host)),
            tag("path", F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, r"[0-9]+", "#"))),
            tag("query", F.transform(query, lambda x: F.split(x, "=")[0])),
            tag("fragment", F.array(F.when(u.contains("#"), "yes").otherwise(""))),
        )
    )


def lower_confidence(hits: F.Column, n: F.Column, z: float) -> F.Column:
    """The lower end of the score interval of a share of hits in n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def token_classes(known: DataFrame, min_support: float) -> DataFrame:
    """(token, item): the tokens that reach the support, filed by the set of pages they occur on.

    Tokens of one set of pages (told apart by its size and a sum of hashes)
    are one item, named by the first of them: they occur in the same rules, so
    mining each subset of them would only repeat rules. At most 1 / min_support
    tokens for each token of a page are left, whatever the number of pages.
    """
    pages = known.count()
    t = known.select("page", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("page").cast("decimal(38,0)")).alias("sum"), F.sum(F.xxhash64("page", F.lit(1)).cast("decimal(38,0)")).alias("sum2"))
    t = t.where(F.col("n") >= min_support * pages)
    return t.withColumn("item", F.min("token").over(Window.partitionBy("n", "sum", "sum2"))).select("token", "item")


def _side(df: DataFrame) -> DataFrame:
    """A counted table as the broadcast side of a join, where it is small; else left to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mine(scratch: Scratch, known: DataFrame, min_support: float, min_confidence: float, z: float) -> tuple[DataFrame, DataFrame]:
    """known (page, tokens, blocked) -> (classes of tokens, rules (anchor, condition, confidence, support)).

    A condition is a set of items; it holds where each has a token in the URL,
    as one of the plain rules that it stands for then does. A rule counts if
    the lower end of its confidence's interval, z standard deviations wide,
    reaches min_confidence, so a few labels teach nothing.
    """
    classes = _side(scratch.keep(token_classes(known, min_support), "classes"))
    each = known.select("page", "blocked", F.explode("tokens").alias("token")).join(classes, "token")
    items = scratch.keep(each.groupBy("page", "blocked").agg(F.collect_set("item").alias("found")), "items")
    items = items.select(F.when(F.col("blocked"), F.array_append("found", F.lit(BLOCKED))).otherwise(F.col("found")).alias("items"))
    pages = known.count()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCKED))).select("antecedent", "confidence", "support")
    # FP-growth takes shares of the pages with an item; pages are what counts here.
    in_items = items.count()
    n = F.round(F.col("support") * in_items / F.col("confidence"))
    rules = rules.where(lower_confidence(F.col("confidence") * n, n, z) >= min_confidence).withColumn("support", F.col("support") * in_items / pages)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    by_item = rules.withColumn("item", F.explode("antecedent")).join(single, "item")
    rules = by_item.groupBy("antecedent", "confidence", "support").agg(F.min_by("item", F.struct("freq", "item")).alias("anchor")).withColumnRenamed("antecedent", "condition")
    return classes, _side(scratch.keep(rules, "rules"))


def url_filter(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", min_support: float = 0.002, min_confidence: float = 0.6, z: float = 3.0) -> DataFrame:
    """One row per row of pages: (id_col, host, path, rule, verdict).

    rules: (verdict, host, path); a rule fits its host and all subdomains if
    the path starts with the rule's; the longest wins, of equal ones the first
    by name. They are a list of the caller's and part of the plan. Without a
    fitting rule the verdict is block if a mined rule matches, else allow; rule
    is then null. A mined condition needs min_support of the labelled pages and
    min_confidence at the lower end of its interval (see mine). labels
    (doc_id, quality, toxic) label the pages of the same id: blocked if
    toxic = 1 or quality = 0; null marks count as not. A null URL, or one
    without "://", has empty parts, fits no rule and is allowed. Rows with a
    null id are judged like others and teach nothing. Repeated rows stay, and
    count as other pages in the mining; other columns are not read; empty
    tables and labels give no mined rules.
    """
    host, path = parts("u")
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).withColumn("host", host).withColumn("path", path)
    fit_rule, fit_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(start)
        fit_rule, fit_verdict = F.when(fits, h + start).otherwise(fit_rule), F.when(fits, verdict).otherwise(fit_verdict)
    p = p.withColumn("rule", fit_rule).withColumn("by_rule", fit_verdict)

    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.bool_or((F.col("toxic") == 1) | (F.col("quality") == 0)), F.lit(False)).alias("blocked"))
    known = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).where(F.col("u").contains("://")).join(marked, "id")
    scratch = Scratch(spark, "url-filter")
    known = scratch.keep(known.select(F.monotonically_increasing_id().alias("page"), tokens("u").alias("tokens"), "blocked"), "known")
    classes, mined = mine(scratch, known, min_support, min_confidence, z)
    open_ = p.where("by_rule is null and host <> ''").select("u").distinct().select("u", F.explode(tokens("u")).alias("token"))
    found = open_.join(classes, "token").groupBy("u").agg(F.collect_set("item").alias("found"))
    hit = found.withColumn("anchor", F.explode("found")).join(mined, "anchor").where(F.size(F.array_except("condition", "found")) == 0).select("u").distinct().withColumn("hit", F.lit(True))
    return p.join(hit, "u", "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("hit") & F.col("by_rule").isNull(), "block").otherwise("allow")).alias("verdict"))
