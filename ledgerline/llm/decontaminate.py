"""Benchmark decontamination by a hash set of test n-grams.

Test items become normalised word n-grams (13 words; an item of fewer words is one shorter
n-gram). Their 64-bit hashes are broadcast, and the windows of every training document are
looked up in them on the map side. Every hit is then verified word by word against the text.
Whatever is broadcast (hashes, n-grams, n-grams with their items) is measured on its own first;
beyond ``MOST_BROADCAST`` bytes it is joined by an ordinary shuffle instead.

Only DataFrame functions are used. The words of a document are hashed once, as an array; its
windows are rows that point into that array, and their hashes are made, looked up and thrown
away in one generated loop. Texts are read again only for documents with hits.

Defined results: a null or empty text has no words and is never contaminated; an item
without words has no windows; a null item id is listed as ``null``; rows that repeat doc_id
and text come out alike; empty tables give no rows (documents) or no hits (benchmark);
other columns pass through ``drop_contaminated`` and ``remove_spans`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, cut, join_same, texts

N, SHARE = 13, 20
#: Bytes up to which a table is broadcast, and what a row counts for beside its texts.
MOST_BROADCAST, ROW_BYTES = 128 << 20, 32
#: Words of lower-cased text: all that is not ASCII punctuation, space or control. Named by what they
#: hold: Java matches the same class, written as what they do not hold, many times slower.
TOKEN = r"[a-z0-9\x80-\x{10FFFF}]+"
ANY_CASE_TOKEN = r"[a-zA-Z0-9\x80-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def _window_hash(n: int) -> Column:
    """Hash of the ``n`` words from word ``at`` (1 is the first), from the array ``hashes``."""
    return F.xxhash64(*[F.get(F.col("hashes"), F.col("at") + (j - 1)) for j in range(n)])


def _shared(side: DataFrame) -> DataFrame:
    """``side`` (cheap to compute) marked for broadcast if its measured size is within the bound."""
    size = F.lit(ROW_BYTES)
    for name, kind in side.dtypes:
        if kind == "string":
            size = size + F.octet_length(name)
    return F.broadcast(side) if (side.agg(F.sum(size)).first()[0] or 0) <= MOST_BROADCAST else side


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """``item``, ``len``, ``gram`` (its words, space-joined), ``h``: one row per window."""
    w = (benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"),
                          words(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("words"))
                  .filter("size(words) > 0").withColumn("len", F.least(F.size("words"), F.lit(n))))
    w = w.withColumn("window", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda i: F.slice("words", i, F.col("len")))))
    h = F.xxhash64(F.transform("window", lambda x: F.xxhash64(x)))
    return w.select("item", "len", F.array_join("window", " ").alias("gram"), h.alias("h")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """All documents (``doc_id``, ``fp``, ``n_words``), one row for each row of ``docs``, and
    the documents with verified hits (``doc_id``, ``fp``, ``spans`` of (pos, len, gram),
    ``items``)."""
    grams = cut(item_windows(benchmark, n=n))
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect()) or [n]  # n numbers at most
    table = grams.select("h", "len").distinct()
    small = table.count() * ROW_BYTES <= MOST_BROADCAST
    d = texts(docs).withColumn("fp", F.xxhash64("text"))
    scan = d.select("doc_id", "fp", words(F.col("text")).alias("words"))
    scan = scan.select("doc_id", "fp", F.size("words").alias("n_words"), F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"))
    at_len = F.explode(F.array(*[F.lit(k) for k in lengths]))
    fits = (F.col("at") > 0) & (F.col("at") + F.col("len") <= F.col("n_words") + 1)
    h = F.lit(0).cast("long")
    for k in lengths:
        h = F.when((F.col("at") > 0) & (F.col("len") == k), _window_hash(k)).otherwise(h)
    if small:
        # place 0 of each document stands for the document itself and always finds its partner
        marker = table.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(0).alias("of"))
        rows = (scan.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_words")))).withColumn("len", at_len)
                    .filter(fits | ((F.col("at") == 0) & (F.col("len") == lengths[0])))
                    .select("doc_id", "fp", "n_words", "at", F.when(F.col("at") == 0, 0).otherwise(F.col("len")).alias("len"), h.alias("h")))
        found = cut(rows.join(F.broadcast(table.withColumnRenamed("len", "of").unionByName(marker)), "h").filter("len = of"))
        every = found.filter("at = 0").select("doc_id", "fp", "n_words")
        found = found.filter("at > 0")
    else:
        # rows that stand for documents would all have one key: they are read on their own
        every = scan.select("doc_id", "fp", "n_words")
        rows = (scan.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_words")))).withColumn("len", at_len)
                    .filter(fits).select("doc_id", "fp", "at", "len", h.alias("h")))
        found = cut(rows.join(table, ["h", "len"]))
    spans = (found.select("doc_id", "fp", "h", "len", (F.col("at") - 1).alias("pos"))
                  .join(_shared(grams.select("h", "len", "gram").distinct()), ["h", "len"])
                  .groupBy("doc_id", "fp").agg(F.collect_set(F.struct("pos", "len", "gram")).alias("spans")))
    held = join_same(d, spans, "doc_id", "fp").select("doc_id", "fp", "spans", words(F.col("text")).alias("words"))
    # the words are bound to a lambda's variable, so they are made once per document and not per span
    real = F.transform(F.array("words"), lambda w: F.filter("spans", lambda x: F.array_join(
        F.slice(w, x["pos"] + 1, x["len"]), " ") == x["gram"]))[0]
    held = (held.withColumn("spans", real).drop("words").filter("size(spans) > 0").dropDuplicates(["doc_id", "fp"]))
    held = cut(held)
    items = (held.select("doc_id", "fp", F.explode(F.array_distinct("spans.gram")).alias("gram"))
                 .join(_shared(grams.select("gram", "item").distinct()), "gram")
                 .groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set("item")).alias("items")))
    return every, join_same(held, items, "doc_id", "fp")


def _covered() -> Column:
    """Positions of the words that any span covers."""
    return F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """One row per document: ``doc_id``, ``fp``, ``n_words``, ``n_hit``, ``items``, ``contaminated``
    (at least 1 in ``share`` words hit)."""
    every, held = hits(docs, benchmark, n)
    held = held.select("doc_id", "fp", F.size(_covered()).cast("long").alias("n_hit"), "items")
    out = join_same(every, held, "doc_id", "fp", how="left").select(
        "doc_id", "fp", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (docs.withColumn("__id", F.col(f"`{id_col}`"))
                .withColumn("__fp", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = (report(_plain(docs, id_col, text_col), benchmark, n, share).filter("contaminated")
           .select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).distinct())
    rows = _keyed(docs, id_col, text_col)
    return (join_same(rows, bad, "__id", "__fp", how="left_anti")
                .select(*[F.col(f"`{c}`") for c in docs.columns]))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every hit word, and what stands between it and the next word, cut from
    the text."""
    _, held = hits(_plain(docs, id_col, text_col), benchmark, n)
    held = held.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), _covered().alias("__hit"))
    rows = _keyed(docs, id_col, text_col)
    rows = join_same(rows, held, "__id", "__fp", how="left")
    text, token = F.col(f"`{text_col}`"), F.lit(ANY_CASE_TOKEN)
    rows = (rows.withColumn("__words", F.when(F.col("__hit").isNotNull(), F.regexp_extract_all(text, token, F.lit(0))))
                .withColumn("__gaps", F.when(F.col("__hit").isNotNull(), F.split(text, ANY_CASE_TOKEN, -1))))
    pieces = F.transform("__words", lambda w, i: F.when(F.array_contains("__hit", i), F.lit(""))
                         .otherwise(F.concat(w, F.get(F.col("__gaps"), i + 1))))
    cleaned = F.when(F.col("__hit").isNull(), text).otherwise(
        F.concat(F.get(F.col("__gaps"), F.lit(0)), F.array_join(pieces, "")))
    return rows.select(*[(cleaned.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
