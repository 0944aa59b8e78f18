"""URL filters: a list of rules, and association rules where the list is silent.

The listed rules are looked up by host and path.  What they decide labels their pages; from the labelled pages' URLs Spark's
FP-growth mines the token combinations that go with a verdict (``label_col`` names labels of your own instead).  Tokens
are the host's parts, the path's parts (numbers as ``#``) and the names of query parameters.  A combination becomes a rule
if enough labelled pages hold it with the verdict (support) and nearly all that hold it have the verdict (confidence);
of rules that a shorter one makes superfluous only the shorter stays.

Rules are matched by an inverted index: each stands under its rarest token, a URL finds those under its own tokens, and
those of which it holds all tokens fit.  The rule of highest confidence, then support, then length, then order of its
tokens decides; without any the verdict is ``default``.

At scale: each different URL is judged once and joined back; the index is broadcast only if it is found to be small.

Defined results: a null URL, or one without ``://``, has an empty host and path and no tokens, so it gets the default;
repeated rows are judged each; no labelled pages mean no mined rules; an empty table gives an empty result; further
columns play no part.  All labelled URLs are learnt from, whatever their number of tokens: FP-growth's combinations double
with each frequent token of a URL, so where one has more than ``fit_tokens`` of these (without those of one verdict), they
are grown only as far as they can become rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import c, cut, hinted, stored

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Listed:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract, as given.
RULES = (
    Listed(ALLOW, "org", "/"),
    Listed(BLOCK, "example.org", "/es/"),
    Listed(BLOCK, "example.org", "/en/1"),
    Listed(ALLOW, "com", "/fr/"),
    Listed(BLOCK, "com", "/de/"),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[Listed, ...] = RULES) -> Column:
    """The longest rule that fits (name, verdict), or null: a rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):  # the longest is tried first: it stands outermost
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The different tokens of a URL, in order."""
    some = lambda text, by, mark, change: F.transform(F.filter(F.split(text, by), lambda x: x != ""), lambda x: F.concat(F.lit(mark), change(x)))
    same = lambda x: x
    host = some(host_of(url), r"\.", "h:", same)
    path = some(path_of(url), "/", "p:", lambda x: F.regexp_replace(ascii_lower(x), "[0-9]+", "#"))
    query = some(query_of(url), "&", "q:", lambda x: F.regexp_extract(ascii_lower(x), "^[^=]*", 0))
    return F.array_sort(F.array_distinct(F.concat(host, path, query)))


def mine(labelled: DataFrame, *, min_support: float = 0.01, least: int = 10, min_confidence: float = 0.8, fit_tokens: int = 16) -> DataFrame:
    """Rules from rows (tokens, verdict): items, verdict, support (rows), confidence, key (the rarest item).

    Needs ``min_support`` of the rows, and ``least`` of them, with the combination and the verdict.  FP-growth counts the
    combinations unless some row holds more than ``fit_tokens`` tokens that can stand in one; then they are grown token by
    token, with the same rules.
    """
    spark = labelled.sparkSession
    shape = "items array<string>, verdict string, support long, confidence double, key string"
    told = labelled.filter(F.col("verdict").isNotNull() & (F.size("tokens") > 0))
    rows = cut(told.select(F.monotonically_increasing_id().alias("id"), "tokens", "verdict"))
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], shape)
    needed = max(least, -int(-n * min_support // 1), 1)
    if needed > n:
        return spark.createDataFrame([], shape)
    held = rows.select("id", "verdict", F.explode("tokens").alias("item"))
    single = held.groupBy("item", "verdict").agg(F.count(F.lit(1)).alias("support"))
    whole = single.groupBy("item").agg(F.sum("support").alias("all"), F.max("support").alias("most")).filter(F.col("most") >= needed)
    single = cut(single.join(whole, "item").select(F.array("item").alias("items"), "verdict", "support", "all", "most"))
    # what holds a token of one verdict alone says no more than that token; the others are open to combinations
    open_ = single.filter("most < all")
    items = hinted(cut(open_.select(F.col("items")[0].alias("item")).distinct()), 100_000)
    baskets = cut(held.join(items, "item").groupBy("id", "verdict").agg(F.array_sort(F.collect_list("item")).alias("items")).select("verdict", "items"))
    m, longest = baskets.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("items")), F.lit(0))).first()
    surely = (F.col("support") >= needed) & (F.col("confidence") >= min_confidence)
    rules = single.withColumn("confidence", F.col("support") / F.col("all")).filter(surely).select("items", "verdict", "support", "confidence")
    if longest > fit_tokens:
        rules = rules.unionByName(_grown(baskets, open_, needed).filter(surely))
    elif m >= needed:
        rules = rules.unionByName(_combined(baskets, (needed - 0.5) / m).filter(surely & (F.size("items") > 1)))
    rules = cut(rules)
    # superfluous: a rule with one item less says the same at least as surely
    shorter = rules.select("items", "verdict", F.col("confidence").alias("_other"))
    less = rules.filter(F.size("items") > 1).select(F.col("items").alias("_whole"), "verdict", "confidence", F.explode("items").alias("_left"))
    less = less.withColumn("items", F.array_remove("_whole", F.col("_left")))
    beaten = less.join(shorter, ["items", "verdict"]).filter(F.col("_other") >= F.col("confidence")).select(F.col("_whole").alias("items"), "verdict").distinct()
    rules = rules.join(beaten, ["items", "verdict"], "left_anti")
    counts = single.select(F.col("items")[0].alias("_item"), F.col("all").alias("_n")).distinct()
    rarest = rules.select("items", "verdict", F.explode("items").alias("_item")).join(counts, "_item").groupBy("items", "verdict").agg(F.min(F.struct("_n", "_item")).alias("_rare"))
    return rules.join(rarest, ["items", "verdict"]).select("items", "verdict", "support", "confidence", F.col("_rare._item").alias("key"))


def _combined(baskets: DataFrame, share: float) -> DataFrame:
    """Combinations that ``share`` of the rows (items, verdict) hold with a verdict, by FP-growth: items, verdict, support, confidence."""
    from pyspark.ml.fpm import FPGrowth

    mark = "="  # no token begins with it
    marked = baskets.select(F.concat("items", F.array(F.concat(F.lit(mark), "verdict"))).alias("items"))
    sets = cut(FPGrowth(itemsCol="items", minSupport=share, minConfidence=1.0).fit(marked).freqItemsets)
    is_label = lambda x: x.startswith(mark)
    split = sets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("items"), F.filter("items", is_label).alias("_label"), "freq")
    alone = split.filter(F.size("_label") == 0).select("items", F.col("freq").alias("_all"))
    both = split.filter((F.size("_label") == 1) & (F.size("items") > 0)).select("items", F.substring(F.element_at("_label", 1), 2, 1 << 20).alias("verdict"), F.col("freq").alias("support"))
    return both.join(alone, "items").withColumn("confidence", F.col("support") / F.col("_all")).drop("_all")


def _grown(baskets: DataFrame, single: DataFrame, needed: int) -> DataFrame:
    """Combinations of two items and more that can be rules, whatever the length of the rows: items, verdict, support, confidence.

    A combination is of use only if each with one item less is held by more rows (else that one says the same) and has
    several verdicts (else it is as sure as can be).  Both hold for its parts too, so combinations grow from those one
    shorter, all of which must be of use: a path that many rows share whole, or in parts of any depth, never goes
    beyond its pairs.
    """
    rows = baskets.groupBy("items", "verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id())
    kept = cut(rows).select("id", "verdict", "n", F.explode("items").alias("last")).select("id", "verdict", "n", F.array().cast("array<string>").alias("head"), "last")
    found = single.sparkSession.createDataFrame([], "items array<string>, verdict string, support long, confidence double")
    before, size = single.select("items", "verdict", "support", "all"), 1
    while True:
        size += 1
        other = kept.select("id", "head", F.col("last").alias("next"))
        longer = kept.join(other, ["id", "head"]).filter("last < next").select("id", "verdict", "n", F.concat("head", F.array("last")).alias("head"), F.col("next").alias("last"))
        counted = longer.groupBy("head", "last", "verdict").agg(F.sum("n").alias("support")).select(F.concat("head", F.array("last")).alias("items"), "verdict", "support")
        counted = cut(counted)
        whole = counted.groupBy("items").agg(F.sum("support").alias("all"), F.max("support").alias("most")).filter(F.col("most") >= needed)
        counted = counted.join(whole, "items")
        part = F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("_part")
        parts = before.select(F.col("items").alias("_part"), "verdict", F.col("all").alias("_all"))
        met = counted.select("items", "verdict", "support", "all", "most", part).join(parts, ["_part", "verdict"])
        sets = met.groupBy("items", "verdict", "support", "all", "most").agg(F.count(F.lit(1)).alias("_parts"), F.min("_all").alias("_least"))
        sets = cut(sets.filter((F.col("_parts") == size) & (F.col("_least") > F.col("all"))))
        found = found.unionByName(sets.select("items", "verdict", "support", (F.col("support") / F.col("all")).alias("confidence")))
        before = sets.filter("most < all").select("items", "verdict", "support", "all")
        if before.isEmpty():
            return found
        of_use = before.select(F.slice("items", 1, size - 1).alias("head"), F.element_at("items", -1).alias("last")).distinct()
        kept = stored(longer.join(of_use, ["head", "last"], "left_semi"), "url-combinations")


def match(urls: DataFrame, rules: DataFrame, *, most: int = 100_000) -> DataFrame:
    """Per different URL of ``urls`` (column url) that fits a rule: url, verdict, items (of the rule that decides)."""
    index = hinted(cut(rules), most)
    asked = urls.filter("url is not null").select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    met = asked.select("url", "tokens", F.explode("tokens").alias("key")).join(index, "key").filter(F.size(F.array_except("items", "tokens")) == 0)
    rank = F.struct("confidence", "support", F.size("items").alias("n"), (F.col("verdict") == ALLOW).alias("a"), "items", "verdict")
    return met.groupBy("url").agg(F.max(rank).alias("_best")).select("url", F.col("_best.verdict").alias("verdict"), F.col("_best.items").alias("items"))


def judge(
    df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, rules: tuple[Listed, ...] = RULES, default: str = ALLOW, min_support: float = 0.01, least: int = 10, min_confidence: float = 0.8, fit_tokens: int = 16
) -> DataFrame:
    """Per row: id, host, path, rule (the listed rule's name, else null), verdict, by (``list``, ``mined`` or ``default``) and
    items (those of the mined rule that decided)."""
    url = F.col("url")
    pages = df.select(c(id_col).alias("id"), c(url_col).cast("string").alias("url"), *([c(label_col).cast("string").alias("label")] if label_col else []))
    told = pages.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("_rule", listed(F.col("host"), F.col("path"), rules))
    labelled = told.select(tokens(url).alias("tokens"), (F.col("label") if label_col else F.col("_rule.verdict")).alias("verdict"))
    mined = mine(labelled, min_support=min_support, least=least, min_confidence=min_confidence, fit_tokens=fit_tokens)
    found = match(told.filter("_rule is null"), mined).withColumnsRenamed({"verdict": "_mined", "url": "_url"})
    open_ = told.filter("_rule is null").join(found, url == F.col("_url"), "left")
    out = told.filter("_rule is not null").unionByName(open_, allowMissingColumns=True)
    by = F.when(F.col("_rule").isNotNull(), "list").when(F.col("_mined").isNotNull(), "mined").otherwise("default")
    return out.select("id", "host", "path", F.col("_rule.name").alias("rule"), F.coalesce("_rule.verdict", "_mined", F.lit(default)).alias("verdict"), by.alias("by"), "items")
