"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders: a number is a run of digits (separators inside it dropped), a unit one of UNITS right
after a number, a name a capitalised word inside a sentence (after a letter, digit or one of , ; : and a space). All other
words, lower-cased, are literals. A benchmark item is cut into windows of ``window`` template words (an item that is shorter: one window of all). A window
is known by up to three hashes: that of its words as they are, lower-cased; that of its template; and, since a copy may stand where a sentence does not
begin, that of its template with its sentences' capitalised first words as names. Documents give the first two at every position; the hash join of the two
sides finds the windows, and its rows are compared word by word: what is a literal of the item has to be the same word, what is a slot of the type. A window
with fewer than ``literals`` literals (numbers, tables, lists of names) is looked for as it is only: it has no slots.

So an exact copy is found whatever stands before it, its full stops and its capitals; and a question whose numbers, names or units were exchanged is
found too. The exchange has to be consistent: along one alignment of item and document, values of the item and of the document have to stand for each other
one to one. Windows in which nothing was exchanged count in any case. Of the others, those are dropped that hold a number or unit which breaks this (it may
have been the same by chance), and all of them if a name does (then the persons are others).

The windows are broadcast if their counted number and bytes are below ``most_broadcast`` and ``most_mb``; documents' texts are then never shuffled. Else hashes
and positions alone are shuffled to the windows, and only documents that hold one are read again for the comparison.

An item counts as found with at least ``least`` windows on consistent alignments: all, if it has fewer, or all with slots allowed, if it has fewer of
those (its other windows are lost where its numbers were exchanged). Cases: null or empty texts and items hold nothing; texts may be of any length; an item of
fewer words than ``shortest`` is never found; items or documents given twice count once; of several texts of one id each is looked at, and the id has what
any of them holds; documents or items with a null id are left out of the result. Nothing depends on how ties are broken: every item found is a row. Empty
tables give an empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.storage import write_shared

#: Words that are units right after a number.
UNITS = "km|m|cm|mm|miles?|feet|ft|inch(?:es)?|kg|g|mg|lbs?|pounds?|tons?|l|ml|litres?|liters?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|usd|eur|dollars?|euros?|cents?|percent|kwh|w|kw|v|hz|mph|kmh|degrees?"
NAME, UNIT, CAPITAL, NUMBER = "\u0001", "\u0002", "\u0003", "\u0005"
SEED = 0


def marked_words(text: Column, capitals: bool = False) -> Column:
    """The words of a text, lower-cased; names begin with NAME, units with UNIT, numbers with a digit, and with ``capitals`` all other
    capitalised words with CAPITAL. (Patterns begin with what is rare, so that most places are passed at one look.)"""
    named = F.regexp_replace(text, r"(?=\p{Lu})(?<=[\p{L}\p{N},;:] )", NAME)
    if capitals:
        named = F.regexp_replace(named, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}{NAME}])", CAPITAL)
    numbers = F.regexp_replace(named, r"[.,](?=\d)(?<=\d.)", "")
    apart = F.regexp_replace(numbers, r"(\d)(?=\p{L})", "$1 ")
    units = F.regexp_replace(apart, rf"(\d ){NAME}?(?=(?i:{UNITS})(?![\p{{L}}\p{{N}}]))", f"$1{UNIT}")
    return F.split(F.lower(F.when(text.rlike(r"\d"), units).otherwise(named)), rf"[^\p{{L}}\p{{N}}{NAME}{UNIT}{CAPITAL}]+")


def is_slot(word: Column) -> Column:
    return (word < CAPITAL) | ((word >= "0") & (word < ":"))


def plain(word: Column) -> Column:
    """The word without its mark."""
    return F.when(word < "\u0004", F.substring(word, 2, 1 << 30)).otherwise(word)


def typed(word: Column, capital: str | None = None) -> Column:
    """The template word: a placeholder for a slot, and for a word marked CAPITAL if one is given."""
    out = F.when(word < CAPITAL, F.substring(word, 1, 1)).when((word >= "0") & (word < ":"), NUMBER)
    if capital:
        return out.when(word < "\u0004", F.lit(capital)).otherwise(word)
    return out.otherwise(plain(word))


def chained(hashes: Column) -> Column:
    """The hash of a window from an array of its words' hashes."""
    return F.aggregate(hashes, F.lit(SEED).cast("long"), lambda so_far, h: F.xxhash64(so_far, h))


def item_windows(items: DataFrame, item_id: str, text: str, window: int, literals: int, shortest: int) -> DataFrame:
    """hash, item_id, at (of the window), n_windows (of the item), n_open (of them), open (it may have slots), size, words (marked)."""
    words = F.filter(marked_words(F.col(text), capitals=True), lambda w: w != "")
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), words.alias("w")).distinct().where(F.size("w") >= shortest)
    rows = rows.withColumn("size", F.least(F.size("w"), F.lit(window)))
    rows = rows.select("item_id", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("at"))
    rows = rows.select("item_id", "size", "at", F.slice("w", F.col("at") + 1, F.col("size")).alias("words"))
    rows = rows.withColumn("open", F.size(F.filter("words", lambda w: ~is_slot(w))) >= literals)
    own = chained(F.transform("words", lambda w: F.xxhash64(plain(w))))
    template = F.when(F.col("open"), chained(F.transform("words", lambda w: F.xxhash64(typed(w)))))
    inside = F.when(F.col("open"), chained(F.transform("words", lambda w: F.xxhash64(typed(w, NAME)))))
    counts = rows.groupBy("item_id").agg(F.countDistinct("at").alias("n_windows"), F.countDistinct(F.when(F.col("open"), F.col("at"))).alias("n_open"))
    rows = rows.join(counts, "item_id").withColumn("hash", F.explode(F.array_distinct(F.array(own, template, inside))))
    return rows.where(F.col("hash").isNotNull()).select("hash", "item_id", "at", "n_windows", "n_open", "open", "size", "words")


def document_windows(docs: DataFrame, sizes: list[int], *others: str) -> DataFrame:
    """docs: w (marked words), then the columns others. hash, pos of every window of every size: of its words, and of its template where there is one."""
    both = docs.select("*", F.transform("w", lambda w: F.xxhash64(plain(w))).alias("own"), F.transform("w", lambda w: F.xxhash64(typed(w))).alias("template"))
    # The outer form, since of the other one Spark would derive a filter that splits every text again.
    spread = both.select(*others, "w", "own", "template", F.posexplode_outer("own").alias("pos", "first"))
    # Step by step, without array functions of higher order: so all windows of a text are one generated loop that copies no array.
    hashes, one, two = [], F.lit(SEED).cast("long"), F.lit(SEED).cast("long")
    for i in range(max(sizes, default=0)):
        one, two = F.xxhash64(one, F.get("own", F.col("pos") + i)), F.xxhash64(two, F.get("template", F.col("pos") + i))
        spread = spread.withColumns({f"one{i}": one, f"two{i}": two})
        one, two = F.col(f"one{i}"), F.col(f"two{i}")
        if i + 1 in sizes:
            fits = F.col("pos") + i < F.size("own")
            hashes += [F.when(fits, one), F.when(fits & (one != two), two)]
    return spread.select(*others, "w", "pos", F.explode(F.array(*hashes)).alias("hash")).where(F.col("hash").isNotNull())


def contamination(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 8,
    literals: int = 5,
    least: int = 4,
    shortest: int = 3,
    most_broadcast: int = 200_000,
    most_mb: int = 64,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, n_found (windows), n_windows (of the item), reparameterised."""
    windows = write_shared(item_windows(items, item_id, item_text, window, literals, shortest), "item-windows")
    n, n_bytes, sizes = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0)), F.sort_array(F.collect_set("size"))).first()
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not n:
        sizes = [window]
    if n <= most_broadcast and n_bytes <= most_mb << 20:
        marked = docs.select("doc_id", marked_words(F.col("text")).alias("w"))
        met = document_windows(marked, sizes, "doc_id").join(F.broadcast(windows), "hash")
    else:
        keyed = docs.select("doc_id", F.xxhash64("text").alias("version"), marked_words(F.col("text")).alias("w"))
        places = document_windows(keyed, sizes, "doc_id", "version").select("doc_id", "version", "pos", "hash").join(windows, "hash")
        met = keyed.dropDuplicates(["doc_id", "version"]).join(write_shared(places, "window-places"), ["doc_id", "version"])
    # Word by word too: a condition with array functions would take the join, and with it a copy of its words for each place of a text, out of that loop.
    same = F.lit(True)
    for i in range(window):
        word, there = F.get("words", F.lit(i)), F.get("w", F.col("pos") + i)
        slot = F.col("open") & is_slot(word) & (typed(word) == typed(there))
        same = same & ((F.lit(i) >= F.col("size")) | (plain(word) == plain(there)) | slot)
    pairs = F.arrays_zip(F.col("words").alias("item"), F.slice("w", F.col("pos") + 1, F.col("size")).alias("document"))
    slots = F.transform(F.filter(pairs, lambda p: F.col("open") & is_slot(p["item"])), lambda p: F.struct(p["item"].alias("item"), plain(p["document"]).alias("document")))
    hits = met.where(same).select("doc_id", "item_id", "n_windows", "n_open", (F.col("pos") - F.col("at")).alias("shift"), F.struct("at", "open", slots.alias("slots")).alias("hit"))
    # One row per window and alignment, then one per alignment: its values have to be a one-to-one mapping.
    aligned = hits.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("hit").alias("hits"), *(F.max(c).alias(c) for c in ("n_windows", "n_open")))
    value = lambda p: F.concat(F.when(p["item"] < CAPITAL, F.substring(p["item"], 1, 1)).otherwise(""), p["document"])
    exchanged = F.array_distinct(F.flatten("hits.slots"))
    aligned = aligned.withColumn("values", F.array_sort(F.transform(exchanged, lambda p: p["item"]))).withColumn("those", F.array_sort(F.transform(exchanged, value)))
    twice = lambda c: F.array_distinct(F.filter(c, lambda v, i: v == F.get(c, i - 1)))
    aligned = aligned.withColumns({"several_values": twice("values"), "several_those": twice("those")})
    aligned = aligned.withColumn("persons", F.exists(F.concat("several_values", "several_those"), lambda v: v.startswith(NAME)))
    changed = lambda h: F.exists(h["slots"], lambda p: plain(p["item"]) != p["document"])
    broken = lambda p: F.array_contains(F.col("several_values"), p["item"]) | F.array_contains(F.col("several_those"), value(p))
    clash = lambda h: F.col("persons") | F.exists(h["slots"], broken)
    aligned = aligned.withColumn("hits", F.filter("hits", lambda h: ~(changed(h) & clash(h)))).where(F.size("hits") > 0)
    found_at = {"n_found": F.col("hits.at"), "n_open_found": F.filter("hits", lambda h: h["open"])["at"]}
    per_item = aligned.groupBy("doc_id", "item_id").agg(
        *(F.size(F.array_distinct(F.flatten(F.collect_set(at)))).cast("long").alias(n) for n, at in found_at.items()),
        *(F.max(c).alias(c) for c in ("n_windows", "n_open")),
        F.max(F.exists("hits", changed)).alias("reparameterised"),
    )
    all_open = (F.col("n_open") > 0) & (F.col("n_open_found") >= F.least(F.lit(least), F.col("n_open")))
    per_item = per_item.where((F.col("n_found") >= F.least(F.lit(least), F.col("n_windows"))) | all_open)
    return per_item.select("doc_id", "item_id", "n_found", "n_windows", "reparameterised")


def decontaminated(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """documents, all columns, without those in which an item is found."""
    found = contamination(documents, items, **options).select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti").select(*documents.columns)
