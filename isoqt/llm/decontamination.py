"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Every window of ``WINDOW`` template words of every document is hashed and joined with the benchmark's windows. For the
documents found, the values that stand in the placeholders are compared: a document is contaminated when enough of an
item's windows occur in it and its values are consistent, so that re-parameterised questions are caught and unrelated
texts of the same form are not. Consistent means one value for every place of the item and one for every name.
Where the hits of a whole text contradict each other, each of its alignments is judged by itself: for every distance
between text and item that a hit has, every window of the item takes its nearest hit (none farther than nothing, a
window, the item's length), and one consistent alignment with enough windows is enough.

Windows with placeholders for half of their words or more say too little as templates and are compared by their raw
words. Items shorter than a window are looked for in windows of their own length and, as templates, as whole documents. Words capitalised inside a sentence of
an item are names as the listed ones are: windows that hold one are compared once more with all capitalised words masked.

Defined cases: a null, empty or blank text on either side matches nothing; an item of one word is found only as a whole
document; texts are read whole; repeated rows are judged alike; an empty benchmark flags nothing; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.llm.common import let, window_hashes, written

WINDOW = 8
#: A document is found when it holds this share of an item's windows, or this many.
SHARE, ENOUGH = 0.5, 13
#: Rows of the benchmark's window table up to which it is broadcast (two 8 byte fields each); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Units of measurement and currency (fixed values).
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "miles",
         "feet", "inches", "pounds", "ounces", "percent", "degrees", "dollars", "euros", "cents", "meters", "metres", "litres", "liters", "grams", "kilograms")
#: Given names frequent in word problems (fixed values).
NAMES = ("james", "john", "robert", "michael", "david", "william", "richard", "thomas", "mary", "patricia", "jennifer", "linda", "elizabeth", "susan", "sarah", "karen",
         "anna", "emma", "olivia", "sophia", "alice", "bob", "carol", "peter", "paul", "maria", "laura", "julia", "lisa", "tom", "tim", "sam", "jack", "lucy", "kate")


def raw_words(text: Column) -> Column:
    """Lower-case words of letters and digits; points and commas stay inside numbers; units leave the digits they touch."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    apart = F.regexp_replace(low, rf"(?<=[0-9])(?=(?:{'|'.join(UNITS)})\b)", " ")
    numbers = F.regexp_replace(apart, r"[^\p{L}\p{N}.,]+|[.,](?<![0-9].)|[.,](?![0-9])", " ")
    return F.array_remove(F.when(low.rlike("[0-9]"), F.split(numbers, " +")).otherwise(F.split(low, r"[^\p{L}\p{N}]+")), "")


def is_number(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def template(words: Column) -> Column:
    """The words with their placeholders; an array without digits and names stays as it is."""
    marked = F.transform(words, lambda w, i: F.when(is_number(w), "<number>").when(w.isin(*NAMES), "<name>").when(
        w.isin(*UNITS) & (i > 0) & F.coalesce(is_number(F.get(words, i - 1)), F.lit(False)), "<unit>").otherwise(w))
    return F.when(F.exists(words, lambda w: w.isin(*NAMES) | is_number(w)), marked).otherwise(words)


def cased_words(text: Column) -> Column:
    """The words of ``raw_words`` as they are written."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    apart = F.regexp_replace(whole, rf"(?i)(?<=[0-9])(?=(?:{'|'.join(UNITS)})\b)", " ")
    numbers = F.regexp_replace(apart, r"[^\p{L}\p{N}.,]+|[.,](?<![0-9].)|[.,](?![0-9])", " ")
    return F.array_remove(F.when(whole.rlike("[0-9]"), F.split(numbers, " +")).otherwise(F.split(whole, r"[^\p{L}\p{N}]+")), "")


def inner_names(text: Column) -> Column:
    """Lower-cased words that are capitalised inside a sentence: after a word and a blank, with or without a comma."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text.cast("string"), F.lit(r"(?<=[\p{L}\p{N}],? )(\p{Lu}\p{Ll}[\p{L}\p{N}]*)"), F.lit(1)), lambda w: F.lower(w)))


def capitalised(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}\p{Ll}")


def masked(words: Column, cased: Column) -> Column:
    """Template words with every capitalised word as a name; unchanged where the two arrays do not run in parallel."""
    return F.when(F.size(words) == F.size(cased), F.zip_with(words, cased, lambda w, c: F.when(capitalised(c) & ~is_slot(w), "<name>").otherwise(w))).otherwise(words)


def is_slot(word: Column) -> Column:
    return word.startswith("<")


def counts(marks: Column) -> Column:
    """Sum of every window of an array of numbers."""
    pair = lambda h, k: F.zip_with(F.slice(h, 1, F.size(h) - k), F.slice(h, k + 1, F.size(h) - k), lambda a, b: a + b)
    return let(pair(marks, 1), lambda h2: let(pair(h2, 2), lambda h4: pair(h4, 4)))


def marks(words: Column) -> Column:
    return F.transform(words, lambda w: is_slot(w).cast("int"))


def windows(raw: Column, words: Column) -> Column:
    """Hashes of all windows: of the template words, or of the raw words where half of them or more are placeholders."""
    exact = let(window_hashes(raw), lambda r: let(counts(marks(words)), lambda n: F.transform(
        window_hashes(words), lambda h, i: F.when(F.get(n, i) * 2 >= WINDOW, F.xxhash64(F.lit("raw"), F.get(r, i))).otherwise(h))))
    many = (F.size(words) >= WINDOW) & (F.size(F.filter(words, is_slot)) * 2 >= WINDOW)
    return F.when(many, exact).otherwise(window_hashes(words))


def short_windows(raw: Column, words: Column, width) -> Column:
    """``windows`` of ``width`` words, less than ``WINDOW``; one word is a window only where it is the whole text."""
    width = F.lit(width) if isinstance(width, int) else width
    places = F.sequence(F.lit(0), F.size(words) - width)
    one = lambda i: let(F.slice(words, i + 1, width), lambda part: F.when(
        F.size(F.filter(part, is_slot)) * 2 >= width, F.xxhash64(F.lit("raw"), F.slice(raw, i + 1, width))).otherwise(F.xxhash64(part)))
    return F.when((F.size(words) == width) | ((F.size(words) > width) & (width > 1)), F.transform(places, one)).otherwise(F.array().cast("array<bigint>"))


def whole(words: Column) -> Column:
    """Hash of the template of a text shorter than ``WINDOW``; null for longer ones and where it has half a window of placeholders or more."""
    return F.when(F.size(words).between(1, WINDOW - 1) & (F.size(F.filter(words, is_slot)) * 2 < WINDOW), F.xxhash64(F.lit("whole"), words))


def name_windows(words: Column, hidden: Column) -> Column:
    """Hashes of the masked windows that differ from the template's; null for others and where half is placeholders or more."""
    differs = F.zip_with(words, hidden, lambda a, b: (a != b).cast("int"))
    return F.when((F.size(words) >= WINDOW) & F.exists(differs, lambda d: d > 0), let(counts(differs), lambda d: let(counts(marks(hidden)), lambda n: F.transform(
        window_hashes(hidden), lambda h, i: F.when((F.get(d, i) > 0) & (F.get(n, i) * 2 < WINDOW), F.xxhash64(F.lit("name"), h))))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """A row for each window of each item: item_id, at, h (hash to match), w (the window, however matched), kind (template, raw, name, whole),
    slots (place in the item, value and whether it is a name), span (words of the item), n_windows and n_templates of the item."""
    rows = written(benchmark.select("item_id", raw_words(F.col("text")).alias("raw"), cased_words(F.col("text")).alias("cased"), F.coalesce(inner_names(F.col("text")), F.array().cast("array<string>")).alias("inner")))
    rows = written(rows.select("item_id", "raw", "cased", "inner", template(F.col("raw")).alias("words")))
    rows = written(rows.select("*", masked(F.col("words"), F.col("cased")).alias("hidden")).where(F.size("raw") > 0))
    size = F.size("raw")
    own = F.when(size < WINDOW, short_windows(F.col("raw"), F.col("words"), size)).otherwise(windows(F.col("raw"), F.col("words")))
    base = written(rows.select("item_id", "raw", "words", "hidden", "inner", F.least(size, F.lit(WINDOW)).alias("width"), size.alias("span"),
                               F.posexplode(F.arrays_zip(own.alias("w"), F.coalesce(name_windows(F.col("words"), F.col("hidden")), F.array().cast("array<bigint>")).alias("other"))).alias("at", "x"))
                   .select("*", F.col("x.w").alias("w"), F.col("x.other").alias("other")))
    part = F.slice("words", F.col("at") + 1, F.col("width"))
    heavy = F.size(F.filter(part, is_slot)) * 2 >= F.col("width")

    def held(words: str) -> Column:
        all_ = F.transform(F.slice(words, F.col("at") + 1, F.col("width")), lambda w, i: F.struct(
            (F.col("at") + i).alias("place"), F.get("raw", F.col("at") + i).alias("value"), (w == "<name>").alias("name"), is_slot(w).alias("slot")))
        # A capitalised word that is no name (the first of a sentence) is masked, and its value is free.
        kept = F.filter(all_, lambda x: x["slot"] & (~x["name"] | x["value"].isin(*NAMES) | F.array_contains(F.col("inner"), x["value"])))
        return F.transform(kept, lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value"), x["name"].alias("name")))

    common = ["item_id", "at", "w", "span"]
    none = F.filter(held("words"), lambda x: F.lit(False))
    plain = base.select(*common, F.col("w").alias("h"), F.when(heavy, "raw").otherwise("template").alias("kind"), F.when(heavy, none).otherwise(held("words")).alias("slots"))
    inner = F.exists(F.slice("raw", F.col("at") + 1, F.col("width")), lambda w: F.array_contains(F.col("inner"), w) & ~w.isin(*NAMES))
    names = base.where(F.col("other").isNotNull() & inner).select(*common, F.col("other").alias("h"), F.lit("name").alias("kind"), held("hidden").alias("slots"))
    complete = base.where((F.col("span") < WINDOW) & whole(F.col("words")).isNotNull()).select(
        *common, whole(F.col("words")).alias("h"), F.lit("whole").alias("kind"), held("words").alias("slots"))
    counted = plain.groupBy("item_id").agg(F.countDistinct("w").alias("n_windows"), F.countDistinct(F.when(F.col("kind") == "template", F.col("w"))).alias("n_templates"))
    return written(plain.unionByName(names).unionByName(complete).join(counted, "item_id"))


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def matched(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Key (of the text), doc_id, place, hash of the document windows that the benchmark holds."""
    hashes = bench.select("h").distinct()
    if bench.count() <= BROADCAST_ROWS:
        hashes = F.broadcast(hashes)
    short = sorted(r.span for r in bench.where(F.col("span") < WINDOW).select("span").distinct().collect())
    names = not bench.where("kind = 'name'").isEmpty()
    if not short and not names:
        hashed = let(raw_words(F.col("text")), lambda raw: let(template(raw), lambda words: windows(raw, words)))
        rows = docs.select("doc_id", text_key().alias("key"), hashed.alias("hs"))
        # The outer form infers no filter on the array's size, which would compute the hashes twice; the join drops its nulls.
        return rows.select("doc_id", "key", F.posexplode_outer("hs").alias("pos", "h")).join(hashes, "h", "left_semi")

    placed = lambda hs: F.transform(hs, lambda h, i: F.struct(i.alias("pos"), h.alias("h")))

    def found(raw, words):
        parts = [windows(raw, words)] + [short_windows(raw, words, n) for n in short] + ([F.array(whole(words))] if short else [])
        if names:
            parts.append(let(masked(words, cased_words(F.col("text"))), lambda hidden: F.coalesce(name_windows(words, hidden), F.array().cast("array<bigint>"))))
        return F.concat(*[placed(p) for p in parts])

    hashed = let(raw_words(F.col("text")), lambda raw: let(template(raw), lambda words: found(raw, words)))
    rows = docs.select("doc_id", text_key().alias("key"), hashed.alias("hs"))
    return rows.select("doc_id", "key", F.explode_outer("hs").alias("x")).select("doc_id", "key", F.col("x.pos").alias("pos"), F.col("x.h").alias("h")).join(hashes, "h", "left_semi")


def enough() -> list[Column]:
    """Figures of a group of hits: windows found, windows found that are templates, and whether they are enough for the item."""
    n, light = F.countDistinct("w"), F.countDistinct(F.when(F.col("kind") != "raw", F.col("w")))
    share = (n >= SHARE * F.max("n_windows")) | ((light >= SHARE * F.max("n_templates")) & (light > 0)) | (n >= ENOUGH)
    return [n.alias("n_matched"), F.max("n_windows").alias("n_windows"), share.alias("enough")]


def consistent(values: DataFrame, *by: str) -> DataFrame:
    """``by`` and consistent: one value for each place and for each name of the item; ``values`` has them exploded as v."""
    place, name = F.col("v.place"), F.when(F.col("v.name"), F.col("v.theirs"))
    return values.groupBy(*by).agg(((F.countDistinct(place) == F.countDistinct(place, F.col("v.ours"))) & (F.countDistinct(name) == F.countDistinct(name, F.col("v.ours")))).alias("consistent"))


def aligned(hits: DataFrame) -> DataFrame:
    """(scope, key, item_id) with an alignment that is consistent and has enough windows. A hit has its pos, at, w, kind, span and v (its values)."""
    hits = hits.withColumn("far", F.col("pos") - F.col("at"))
    at = F.floor(F.col("far") / F.col("span"))
    seeds = hits.select("scope", "key", "item_id", "span", F.col("far").alias("seed")).distinct().select("*", F.explode(F.array(*[F.floor(F.col("seed") / F.col("span")) + k for k in (-1, 0, 1)])).alias("bucket")).drop("span")
    near = (hits.withColumn("bucket", at).join(seeds, ["scope", "key", "item_id", "bucket"]).withColumn("dist", F.abs(F.col("far") - F.col("seed"))).where(F.col("dist") <= F.col("span"))
            .groupBy("scope", "key", "item_id", "seed", "at").agg(F.min(F.struct("dist", "pos", "kind", "w", "span", "n_windows", "n_templates", "v")).alias("x"))
            .select("scope", "key", "item_id", "seed", "x.*"))
    one = ["scope", "key", "item_id", "seed", "reach"]
    near = written(near.select("*", F.explode(F.array_distinct(F.array(F.lit(0), F.lit(WINDOW), F.col("span")))).alias("reach")).where("dist <= reach"))
    whole = near.groupBy(*one).agg(*enough()).where("enough").select(*one)
    bad = consistent(near.select(*one, F.explode("v").alias("v")), *one).where("NOT consistent").select(*one)
    return whole.join(bad, one, "left_anti").select("scope", "key", "item_id").distinct()


def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Doc_id, key, item_id, n_matched, n_windows, n_slots, consistent and contaminated of all pairs with a common window."""
    bench = benchmark_windows(benchmark)
    hits = written(matched(docs, bench))
    both = hits.join(bench, "h")
    by = ["scope", "key", "item_id"]
    # Hits by names add to the others but take none away: a pair is judged without them (scope 1) and with them (scope 2).
    scope = F.explode(F.when(F.col("kind") == "name", F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))) if not bench.where("kind = 'name'").isEmpty() else F.lit(1)
    found = both.withColumn("scope", scope).groupBy("doc_id", *by).agg(*enough())
    if both.where(F.size("slots") > 0).isEmpty():
        checked = found.withColumn("n_slots", F.lit(0).cast("long")).withColumn("consistent", F.lit(True))
    else:
        found = written(found)
        wanted = both.where(F.size("slots") > 0).select("key", "item_id").distinct().join(found.where("enough").select("key", "item_id").distinct(), ["key", "item_id"])
        one = written(both.join(wanted, ["key", "item_id"]).select("key", "item_id", "pos", "at", "w", "kind", "span", "n_windows", "n_templates", "slots").distinct())
        texts = docs.select("text").select(text_key().alias("key"), "text").join(one.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        ours = lambda x: F.struct(x["place"].alias("place"), x["name"].alias("name"), x["value"].alias("theirs"), F.get("raw", F.col("pos") - F.col("at") + x["place"]).alias("ours"))
        read = written(one.join(texts.select("key", raw_words(F.col("text")).alias("raw")), "key").select("*", F.transform("slots", ours).alias("v")).drop("raw", "slots")
                       .withColumn("scope", scope))
        maps = consistent(read.select(*by, F.explode("v").alias("v")), *by)
        slots = read.select(*by, F.explode("v").alias("v")).groupBy(*by).agg(F.countDistinct("v.theirs").alias("n_slots"))
        split = written(maps.where("NOT consistent").select(*by))
        good = aligned(read.join(split, by, "left_semi")).withColumn("aligned", F.lit(True))
        verdict = written(slots.join(maps, by).join(good, by, "left").select(*by, "n_slots", (F.col("consistent") | F.coalesce("aligned", F.lit(False))).alias("consistent")))
        checked = (found.join(verdict, by, "left").withColumn("n_slots", F.coalesce("n_slots", F.lit(0).cast("long")))
                   .withColumn("consistent", F.coalesce("consistent", F.lit(True))))
    best = F.struct((F.col("enough") & F.col("consistent")).alias("contaminated"), "n_matched", "n_windows", "n_slots", "consistent")
    return checked.groupBy("doc_id", "key", "item_id").agg(F.max(best).alias("x")).select("doc_id", "key", "item_id", "x.n_matched", "x.n_windows", "x.n_slots", "x.consistent", "x.contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated (doc_id, item_id) pairs with their figures."""
    return pairs(docs.select("doc_id", "text"), benchmark).where("contaminated").select("doc_id", "item_id", "n_matched", "n_windows", "n_slots", "consistent")


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without contaminated texts."""
    bad = written(pairs(docs.select("doc_id", "text"), benchmark).where("contaminated").select(F.col("key").alias("__bad")).distinct())
    return docs.join(bad, text_key() == F.col("__bad"), "left_anti")
