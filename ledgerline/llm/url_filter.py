"""URL filter: curated host and path rules, and association rules for all other URLs.

A URL becomes a set of tokens (host labels, path segments, query keys, ...). FP-growth finds
the token combinations that are frequent among labelled pages; those that come with the
label ``block`` at ``CONFIDENCE`` or more and on ``LEAST`` such pages or more, however many pages
there are, are the rules, less those that a shorter rule implies. An inverted index lists each rule under its rarest
token: a URL fetches the rules of its own tokens and is blocked if it has all tokens of one.

Frequent sets are many where pages share many tokens, so fewer things are mined, to the same
rules: tokens that stand in just the same labelled pages are one item (any of them stands for
all: their sets and shares are the same); an item that is a rule by itself leaves all pages, as
whatever holds it is implied; sets grow over the ``block`` pages only, and how many other pages
hold one is counted by the inverted index. What is left can still be exponential in the items
that ``LEAST`` blocked pages share while none of these items is a rule or equal to another.

Rules are fewer than URLs: only distinct token sets are matched, and
curated rules are looked up by the host's suffixes, longest rule first.

Defined results: a null URL or one without ``://`` has empty host and path, no tokens, and is
allowed; pages without label teach nothing; without labels or rules every page without a
curated rule is allowed; rows that repeat a page come out alike; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, cut

#: Curated rules: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Pages labelled ``block`` that a rule must hold, and the share that they must be of all that it holds.
LEAST, CONFIDENCE = 10, 0.9


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The URL's different tokens, sorted; digits of the path are all alike."""
    mark = lambda kind, col: F.transform(col, lambda x: F.concat(F.lit(kind), x))
    labels = F.reverse(F.split(host(url), r"\."))
    segments = F.filter(F.split(F.regexp_replace(ascii_lower(path(url)), r"[0-9]+", "#"), "/"), lambda x: x != "")
    keys = F.filter(F.split(F.regexp_replace(F.regexp_extract(_rest(url), r"\?([^#]*)", 1), r"=[^&]*", ""), "&"), lambda x: x != "")
    both = F.concat(mark("host:", F.filter(labels, lambda x: x != "")), mark("path:", segments), mark("query:", keys),
                    F.when(_rest(url).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")))
    return F.coalesce(F.sort_array(F.array_distinct(both)), F.array().cast("array<string>"))


def curated(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (``host``, ``path`` among its columns) with ``rule`` and ``rule_verdict`` of the longest
    rule that fits, null without one."""
    table = pages.sparkSession.createDataFrame([(h, p, v) for v, h, p in rules], "on string, under string, verdict string")
    labels = F.split("host", r"\.")
    places = (pages.select("host", "path").distinct()
                   .withColumn("on", F.explode(F.transform(labels, lambda _, i: F.array_join(
                       F.slice(labels, i + 1, F.size(labels)), ".")))))
    fits = (places.join(F.broadcast(table), "on").filter(F.col("path").startswith(F.col("under")))  # a given list
                  .withColumn("rule", F.concat("on", "under")))
    best = (fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.char_length("rule")).alias("best"))
                .select("host", "path", "best.rule", F.col("best.verdict").alias("rule_verdict")))
    return pages.join(best, ["host", "path"], "left")


def items_of(labelled: DataFrame) -> DataFrame:
    """``token``, ``item`` (the smallest of the tokens that stand in the same rows of ``labelled``),
    ``n`` and ``bad`` (rows that hold it, and those of them to ``block``). Sets of rows are told apart
    by two sums of 64-bit hashes of their ids. ``labelled``: ``row``, ``tokens``, ``verdict``."""
    each = labelled.select("row", "verdict", F.explode("tokens").alias("token"))
    total = lambda *of: F.sum(F.xxhash64(*of).cast("decimal(38,0)"))
    held = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("bad"),
                                     total("row").alias("s1"), total(F.lit(1), "row").alias("s2"))
    same = held.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    return held.join(same, ["n", "s1", "s2"]).select("token", "item", "n", "bad")


def _as_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Token sets (``tokens``) with the ``items`` that they hold; tokens without an item are left out."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token")
    return each.groupBy("tokens").agg(F.sort_array(F.collect_set("item")).alias("items"))


def mine_items(labelled: DataFrame, support: float | None = None, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """The rules to ``block`` as sets of items (``rule``), and ``items_of`` the labelled pages.
    ``labelled``: ``tokens`` and ``verdict``. ``support``: share of the pages that a rule must hold with
    ``block``; without it, ``LEAST`` pages."""
    rows = cut(labelled.filter("verdict IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"))
    total, n_bad = rows.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    least = LEAST if support is None else max(math.ceil(support * total), 1)
    items = cut(items_of(rows))
    single = items.filter((F.col("bad") >= least) & (F.col("bad") >= confidence * F.col("n"))).select("item").distinct()
    rules = single.select(F.array("item").alias("rule"))
    open_ = items.join(single, "item", "left_anti").filter(F.col("bad") >= least).select("token", "item")
    if not n_bad or open_.isEmpty():
        return cut(rules), items
    held = cut(rows.select("row", "verdict", F.explode("tokens").alias("token")).join(open_, "token")
                   .groupBy("row", "verdict").agg(F.sort_array(F.collect_set("item")).alias("items")))
    # half a page less, as n times the share may come out above the least number
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n_bad)).fit(_whole(held, n_bad))
    sets = cut(model.freqItemsets.filter((F.size("items") > 1) & (F.col("freq") >= least))
                    .select(F.sort_array("items").alias("rule"), F.col("freq").alias("bad")))
    other = _holding(held.filter("verdict <> 'block'").select("row", F.col("items").alias("tokens")), sets.select("rule"))
    often = other.groupBy("rule").agg(F.count("*").alias("other"))
    sure = sets.join(often, "rule", "left").filter(F.col("bad") >= confidence * (F.col("bad") + F.coalesce("other", F.lit(0))))
    return _minimal(cut(rules.unionByName(sure.select("rule")))), items


def _whole(held: DataFrame, n_bad: int) -> DataFrame:
    """All blocked pages as sets of items, those that hold no open item as empty ones: the
    support is a share of them all."""
    bad = held.filter("verdict = 'block'").select("items")
    empty = held.sparkSession.range(n_bad - bad.count()).select(F.array().cast("array<string>").alias("items"))
    return bad.unionByName(empty)


def _minimal(rules: DataFrame) -> DataFrame:
    """Rules without those that have all tokens of a shorter one, which is looked up by its rarest token."""
    each = rules.select("rule", F.explode("rule").alias("token"))
    short = _index(rules, each).select(F.col("rule").alias("short"), "token")
    implied = (each.join(short, "token")
                   .filter((F.size("short") < F.size("rule")) & (F.size(F.array_except("short", "rule")) == 0))
                   .select("rule").distinct())
    return rules.join(implied, "rule", "left_anti")


def mine(labelled: DataFrame, support: float | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """``rule`` (tokens) of the rules to ``block``, spelled out: one for each choice of a token of
    each item. ``blocked_pages`` needs them by item only."""
    rules, items = mine_items(labelled, support, confidence)
    members = items.groupBy("item").agg(F.collect_set("token").alias("members"))
    one = rules.select("rule", F.explode("rule").alias("item")).join(members, "item")
    choices = one.groupBy("rule").agg(F.collect_list("members").alias("members"))
    spelled = F.aggregate("members", F.array(F.array().cast("array<string>")), lambda all_, own: F.flatten(
        F.transform(all_, lambda x: F.transform(own, lambda t: F.concat(x, F.array(t))))))
    return choices.select(F.explode(spelled).alias("rule")).select(F.sort_array("rule").alias("rule"))


def _index(rules: DataFrame, each: DataFrame) -> DataFrame:
    """``rule`` and its rarest ``token`` by the rows of ``each``."""
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("rule").orderBy("n", "token")
    return (rules.select("rule", F.explode("rule").alias("token")).join(often, "token")
                 .withColumn("turn", F.row_number().over(rarest)).filter("turn = 1").select("rule", "token"))


def _holding(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets`` (``tokens`` among its columns), once for each rule all of whose tokens they have."""
    each = sets.select("*", F.explode("tokens").alias("token"))
    return each.join(_index(rules, each), "token").filter(F.size(F.array_except("rule", "tokens")) == 0).drop("token")


def blocked(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of the distinct token sets (``tokens``) that have all tokens of a rule."""
    return _holding(sets.select("tokens"), rules).select("tokens").distinct()


def blocked_pages(sets: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """``blocked`` for rules of items."""
    told = _as_items(sets, items)
    hit = _holding(told.select(F.col("items").alias("tokens")).distinct(), rules).select(F.col("tokens").alias("items")).distinct()
    return told.join(hit, "items", "left_semi").select("tokens")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES,
          support: float | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of each page. ``labels``: ``page_id`` and
    ``verdict`` (``allow`` or ``block``) of some, which alone teach; curated rules only decide pages."""
    p = pages.select("page_id", F.col("url").alias("url"))
    p = curated(p.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens")), rules)
    p = cut(p)
    known = p.join(labels.filter("verdict IS NOT NULL").select("page_id", "verdict"), "page_id")
    found, items = mine_items(known.select("tokens", "verdict"), support, confidence)
    open_ = p.filter("rule IS NULL")
    # written, so that the join is one of plain shuffles, of which Spark splits hot token sets
    bad = cut(blocked_pages(open_.select("tokens").distinct(), found, items).withColumn("bad", F.lit(True)))
    out = p.join(bad, "tokens", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "rule_verdict", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def page_labels(spark: SparkSession, labels: DataFrame) -> DataFrame:
    """Labels of pages from the labels of the documents made of them (same id): a document of
    low quality or a toxic one marks its page ``block``."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id"))
                  .agg(F.max(F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")))
