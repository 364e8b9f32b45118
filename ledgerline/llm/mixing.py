"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words. A source takes itself whole as often as the budget
holds it (complete epochs); the rest of the budget goes to documents in the order of their
sampling keys ``-ln(u) / weight``: ``u`` is drawn from a hash of the document, so reruns agree,
and the weight is the document's quality, so better documents tend to come first. The
document at the edge of the budget gives only the words that are left of it.

Order and prefix sums are never made over a whole source: keys are dealt into buckets, words
are summed per (source, bucket), and only the bucket in which the budget ends is looked into.
As long as it holds more than ``MOST_SORTED`` rows of a source it is dealt into finer buckets in
turn; then it is sorted. So however many rows a source has, no task sorts more than that, but
for rows that share one key (copies of a document under one id).

Defined results: a null text has 0 words and takes 0; sources are ordered by code point with
null, a source of its own, last; a source without words gets target 0; rows that repeat a
document are documents of their own, tied ones ordered by a row hash; an empty table gives
no rows. ``mixed`` returns the documents themselves with their other columns; there, rows that
repeat doc_id, source and text become one that takes their words together, and columns named
like those it adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, cut, join_same

WEIGHTS, MOST_EPOCHS, BUCKETS, SEED = (1, 2, 3), 3, 1 << 12, "mix-1"
#: Rows of one source that are sorted together, and how often a bucket is dealt into finer ones: keys
#: have 48 bits.
MOST_SORTED, LEVELS = 200_000, 4
#: Sources up to which their budgets are broadcast.
MOST_BROADCAST = 100_000
#: Letters a word has on average in running text.
USUAL_WORD = 5.0


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for a text whose words are of usual length, less the farther they are from it."""
    mean = F.char_length(F.coalesce(text, F.lit(""))) / size
    return F.when(size > 0, F.least(mean / USUAL_WORD, F.lit(USUAL_WORD) / mean)).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential key of rate ``weight``: smaller ones are taken first."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
                                     .cast("binary")), 1, 12), 16, 10).cast("long")
    return -F.log((drawn + 0.5) / float(1 << 48)) / weight


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source (``source``, ``source_size``).

    Shares stop at ``most`` times the source; what is left over goes to the others by weight.
    The level at which this comes to rest is found directly: sources reach their cap in the
    order of cap / weight. One row per source is ordered here, nothing else.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("share", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(rest))
    # the first source, in that order, that stays below its cap sets the level for all that follow
    s = s.withColumn("common", F.min(F.when(F.col("level") >= F.col("share"), F.struct("level", "share"))).over(whole)["share"])
    return s.select("source", "source_size",
                    F.when(F.col("common").isNull() | (F.col("level") <= F.col("common")), F.col("cap"))
                     .otherwise(F.col("common") * F.col("weight")).alias("target"))


def _edges(per_bucket: DataFrame, left: DataFrame, shared) -> DataFrame:
    """``s`` (source), ``edge`` (the bucket in which its budget ends), ``start`` (words of the buckets
    before), ``inside`` (rows in it), from words and rows per (source, bucket)."""
    start = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    e = per_bucket.withColumn("start", F.coalesce(F.sum("words").over(start), F.lit(0)))
    return (e.join(shared(left), F.col("source").eqNullSafe(F.col("s")))
             .filter("start <= left AND left < start + words")
             .select(F.col("source").alias("s"), F.col("bucket").alias("edge"), "start", F.col("n").alias("inside")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, buckets: int = BUCKETS, seed: str = SEED,
        quality_col: str | None = None, most_sorted: int = MOST_SORTED) -> DataFrame:
    """One row per document: ``doc_id``, ``tie`` (a hash of the text), ``source``, ``size``,
    ``source_size``, ``target``, ``taken``. ``quality_col`` names a column with the documents'
    quality (``quality.score_of``, say), by which keys are scaled; null counts as 1, and no weight is
    below 0.001. Without it the weight is taken from the text (``quality_weight``)."""
    quality = F.lit(None) if quality_col is None else F.col(f"`{quality_col}`").cast("double")
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                    F.col(f"`{text_col}`").alias("text"), quality.alias("quality"))
    d = d.withColumn("size", n_words(F.col("text")))
    weight = (quality_weight(F.col("text"), F.col("size")) if quality_col is None
              else F.greatest(F.coalesce(F.nanvl("quality", F.lit(1.0)), F.lit(1.0)), F.lit(0.001)))
    d = d.withColumn("key", sampling_key(F.col("doc_id"), weight, seed))
    place = 1 - F.exp(-F.col("key"))
    d = cut(d.select("doc_id", "source", "size", "key", F.floor(place * buckets).alias("bucket"),
                     F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")))
    per_bucket = cut(d.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    t = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                                .otherwise(F.lit(0)).cast("long"))
    t = cut(t.withColumn("left", F.floor("target") - F.col("epochs") * F.col("source_size")))
    # one row per source: broadcast if they are few, so that a hot source is not dealt to one task
    shared = F.broadcast if t.count() <= MOST_BROADCAST else (lambda d: d)
    edge = cut(_edges(per_bucket, t.select(F.col("source").alias("s"), "left"), shared))
    t = (t.withColumnRenamed("source", "t").join(edge, F.col("t").eqNullSafe(F.col("s")), "left").drop("s"))
    d = d.join(shared(t), F.col("source").eqNullSafe(F.col("t")))
    cols = ["doc_id", "tie", "source", "size", "source_size", "target",
            (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    at_edge = F.col("bucket") == F.col("edge")
    settled = [(d.filter(~F.coalesce(at_edge, F.lit(False)))
                 .withColumn("part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))).select(*cols)]
    inside = d.filter(at_edge).withColumn("left", F.col("left") - F.col("start"))
    for level in range(2, LEVELS + 1):
        if (edge.agg(F.max("inside")).first()[0] or 0) <= most_sorted:
            break
        # the words left of each source end somewhere in these rows: deal them into finer buckets
        inside = cut(inside.drop("edge", "start", "inside").withColumn("bucket", F.floor(place * float(buckets) ** level)))
        finer = cut(inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
        edge = cut(_edges(finer, inside.groupBy(F.col("source").alias("s")).agg(F.first("left").alias("left")), shared))
        inside = inside.join(shared(edge), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        settled.append(inside.filter(~at_edge).withColumn("part", F.when(F.col("bucket") < F.col("edge"), F.col("size"))
                                                          .otherwise(F.lit(0))).select(*cols))
        inside = inside.filter(at_edge).withColumn("left", F.col("left") - F.col("start"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    out = (inside.withColumn("past", F.coalesce(F.sum("size").over(order), F.lit(0)))
                 .withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("past"))))).select(*cols)
    for part in settled:
        out = out.unionByName(part)
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes words of, with ``mix_size``, ``mix_source_size``,
    ``mix_target`` and ``mix_taken``."""
    keys = ["__id", "__tie", "__source"]
    of = (mix(docs, id_col, text_col, source_col, **options)
          .groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("source").alias("__source"))
          .agg(F.first("size").alias("mix_size"), F.first("source_size").alias("mix_source_size"),
               F.first("target").alias("mix_target"), F.sum("taken").alias("mix_taken"), F.count("*").alias("__rows"))
          .filter("mix_taken > 0"))
    added = ["mix_size", "mix_source_size", "mix_target", "mix_taken"]
    rows = (docs.drop(*added).withColumn("__id", F.col(f"`{id_col}`")).withColumn("__source", F.col(f"`{source_col}`"))
                .withColumn("__tie", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    rows = join_same(rows, of, *keys)
    again = cut(of.filter("__rows > 1").select("__id"))
    if not again.isEmpty():
        rows = rows.filter("__rows = 1").unionByName(rows.filter("__rows > 1").dropDuplicates(keys))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *added)
