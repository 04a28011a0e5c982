"""Benchmark decontamination by template canonicalisation.

Words, numbers and sentence ends are taken from the text; numbers, units after a number and names
(capitalised words; the first one of a sentence is one, too, since it may be) become typed placeholders,
the rest is lower-cased. Windows of the
resulting template are hash-joined with those of the benchmark, but for item windows without a single
word, which say nothing. Windows in step (at one offset between
document and item) make a match; a match whose placeholders stand for values that do not follow
one-to-one from the item's values is no re-parameterised copy and is dropped.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import checkpointed

#: Words, numbers, sentence ends.
TOKEN = r"[\p{L}\p{M}]+|\p{Nd}+(?:[.,]\p{Nd}+)*|[.!?]"
#: Units that count as such after a number.
UNITS = "mm cm m km in ft mi g kg mg lb oz l ml s sec min h hr hrs hours hour minutes minute seconds second days day weeks week months month years year usd eur gbp dollars dollar euros euro cents cent percent mph kmh kph hz khz mhz ghz w kw kwh v a j kj kcal c f k".split()
#: Rows that are broadcast at most.
MOST_BROADCAST = 200_000
NUMBER, UNIT, NAME = "\u0001n", "\u0001u", "\u0001p"


def tokens(text: Column) -> Column:
    """array<struct<raw, tmpl>>: the words and numbers of a text with what they are in its template."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def is_number(t: Column) -> Column:
        first = t.substr(1, 1)
        # digits of other scripts come after the Latin letters
        return first.between("0", "9") | ((first > "\u024f") & first.rlike(r"^\p{Nd}"))

    def one(all_: Column) -> Column:
        def at(t: Column, i: Column) -> Column:
            prev = F.when(i > 0, F.get(all_, i - 1)).otherwise(F.lit("."))
            first = t.substr(1, 1)
            tmpl = F.when(t.isin(".", "!", "?"), F.lit(None).cast("string")).when(is_number(t), NUMBER).when(is_number(prev) & F.lower(t).isin(*UNITS), UNIT).when(first != F.lower(first), NAME).otherwise(F.lower(t))
            return F.struct(t.alias("raw"), tmpl.alias("tmpl"))

        return F.transform(all_, at)

    # the array is bound to a lambda variable: named as an expression, it would be computed anew for each element
    return F.filter(F.transform(F.array(found), one)[0], lambda x: x["tmpl"].isNotNull())


def _windows(hashes: Column, window: int) -> Column:
    return F.transform(F.array(hashes), lambda h: _windows_of(h, window))[0]


def _windows_of(hashes: Column, window: int) -> Column:
    n = F.size(hashes)
    many = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(F.slice(hashes, i + 1, window)))
    return F.when(n >= window, many).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def _placed(hashes: Column, window: int, shorter: list[int]) -> Column:
    """array<struct<at, h>>: the windows, and those of ``shorter`` lengths, with their places."""

    def whole(h: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(i.cast("int").alias("at"), F.xxhash64(F.slice(h, i + 1, n)).alias("h")))

    def of(h: Column) -> Column:
        own = F.transform(_windows_of(h, window), lambda x, i: F.struct(i.alias("at"), x.alias("h")))
        none = F.slice(own, 1, 0)
        # a text below a window is one window of its whole already
        more = [F.when(F.size(h) > n, whole(h, n)).otherwise(none) for n in shorter]
        return F.concat(own, *more)

    return F.transform(F.array(hashes), of)[0]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_windows: int = 6) -> DataFrame:
    """row_key, doc_id, item_id, n_windows, n_slots, n_changed: documents that contain a passage of an item.

    A match has ``min_windows`` windows of ``window`` template tokens at one offset, or all windows of an
    item that has fewer: passages of ``window + min_windows - 1`` tokens. n_slots counts placeholders in
    it, n_changed those with another value than in the item; equal values in the item must stand for equal
    values in the document, and different ones for different ones. Item windows of placeholders only do not count. Of several offsets the one with most windows is told. An item
    shorter than a window is one window, which documents have at every place. row_key is a hash of doc_id and text. Null texts have no tokens;
    null ids are kept. Repeated rows match alike and give one row. Empty tables: no rows. Extra columns
    are ignored.
    """
    hashed = lambda text: F.transform(tokens(text), lambda x: F.xxhash64(x["tmpl"]))
    items = checkpointed(benchmark.select("item_id", tokens(F.col("text")).alias("item_tokens")).where(F.size("item_tokens") > 0).distinct())
    item_windows = items.withColumn("h", _windows(F.transform("item_tokens", lambda x: F.xxhash64(x["tmpl"])), window))
    told = lambda i: F.exists(F.slice("item_tokens", i + 1, window), lambda x: ~x["tmpl"].isin(NUMBER, UNIT, NAME))
    with_words = F.filter(F.transform("h", lambda h, i: F.struct(i.alias("item_at"), h.alias("h"))), lambda w: told(w["item_at"]))
    item_windows = item_windows.withColumn("w", with_words).select("item_id", F.size("w").alias("of"), F.explode("w").alias("w"))
    item_windows = checkpointed(item_windows.select("item_id", "of", "w.item_at", "w.h"))
    small = item_windows.count() <= MOST_BROADCAST
    shorter = sorted(r[0] for r in items.where(F.size("item_tokens") < window).select(F.size("item_tokens")).distinct().collect())
    doc_keys = ["doc_id", F.xxhash64("doc_id", "text").alias("row_key")]
    if shorter:
        doc_windows = docs.select(*doc_keys, F.explode(_placed(hashed(F.col("text")), window, shorter)).alias("w")).select("doc_id", "row_key", "w.at", "w.h")
    else:
        doc_windows = docs.select(*doc_keys, F.posexplode(_windows(hashed(F.col("text")), window)).alias("at", "h"))
    met = doc_windows.join(F.broadcast(item_windows) if small else item_windows, "h")
    steps = met.groupBy("row_key", "doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.countDistinct("item_at").alias("n_windows"), F.max("of").alias("of"), F.min("item_at").alias("lo"), (F.max("item_at") + window - 1).alias("hi"))
    found = checkpointed(steps.where(F.col("n_windows") >= F.least(F.lit(min_windows), F.col("of"))))

    # values are compared only where an item has placeholders in the span that matched
    slots = F.filter(F.sequence(F.lit(0), F.size("item_tokens") - 1), lambda p: F.get(F.col("item_tokens"), p)["tmpl"].isin(NUMBER, UNIT, NAME) & p.between(F.col("lo"), F.col("hi")))
    with_items = found.join(F.broadcast(items) if small else items, "item_id").withColumn("slots", slots)
    plain = with_items.where(F.size("slots") == 0).select("row_key", "doc_id", "item_id", "n_windows", F.lit(0).alias("n_slots"), F.lit(0).alias("n_changed"))
    slotted = checkpointed(with_items.where(F.size("slots") > 0).drop("of", "lo", "hi"))
    n = slotted.count()
    if n:
        keys = F.broadcast(slotted) if n <= MOST_BROADCAST else slotted
        texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("doc_id", "text").alias("__key"), "text")
        texts = texts.join(keys, (texts["__key"] == keys["row_key"]) & texts["__id"].eqNullSafe(keys["doc_id"]))
        value = lambda col, p: F.lower(F.get(col, p)["raw"])
        # bound to a lambda variable, a text's tokens are taken once and not for each slot
        pairs = F.transform(F.array(tokens(F.col("text"))), lambda own: F.transform("slots", lambda p: F.struct(value(F.col("item_tokens"), p).alias("a"), value(own, p + F.col("shift")).alias("b"))))
        kinds = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda x: x[side])))
        # as rows, pairs are made once and not for each condition on them
        checked = texts.select(*keys.columns, F.explode(pairs).alias("pairs")).where(F.size(F.array_distinct("pairs")) == kinds("a")).where(kinds("a") == kinds("b"))
        slotted_ok = checked.select("row_key", "doc_id", "item_id", "n_windows", F.size("slots").alias("n_slots"), F.size(F.filter("pairs", lambda x: ~x["a"].eqNullSafe(x["b"]))).alias("n_changed"))
        plain = plain.unionByName(slotted_ok)
    best = F.max(F.struct("n_windows", -F.col("n_changed"), "n_slots")).alias("best")
    return plain.groupBy("row_key", "doc_id", "item_id").agg(best).select("row_key", "doc_id", "item_id", "best.n_windows", "best.n_slots", (-F.col("best.col2")).alias("n_changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """``docs`` without the rows that ``matches`` finds; columns and values are those of ``docs``.

    Null and empty texts match nothing and stay, as do all rows if the benchmark is empty or has null texts
    only. Rows that repeat go or stay alike; rows of one doc_id, or of none, are judged by their own
    texts. No documents: no rows.
    """
    hit = checkpointed(matches(docs, benchmark, **how).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__hit")).distinct())
    found = F.broadcast(hit) if hit.count() <= MOST_BROADCAST else hit
    return docs.join(found, (F.xxhash64(docs["doc_id"], docs["text"]) == hit["__hit"]) & docs["doc_id"].eqNullSafe(hit["__id"]), "left_anti")
