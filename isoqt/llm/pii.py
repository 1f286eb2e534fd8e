"""Personal data: fixed formats plus bootstrapped contextual extraction, all in built-in functions.

The fixed formats (email, ip, card, phone) give seed entities. The word to the left of an entity is a lexical pattern;
every token with a digit or an at-sign is an instance. Pattern and instance scores are iterated over the graph of
(pattern, instance) counts: a pattern is as good as the mean score of its instances, an instance as its patterns
together, seeds stay at 1. Instances that follow a pattern of high confidence and are no seed are ``context`` spans.

Patterns are written without nested repetition, so that long runs of one kind of sign neither overflow the stack of
the regular expression engine nor take quadratic time: signs that a format can't use are blanked first, in place.

Defined cases: a null or empty text has no spans; texts are scanned whole; equal texts have equal spans; a table
without seeds has no patterns; other columns pass ``redact`` untouched. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.llm.common import let, written

KINDS = ("email", "ip", "card", "phone")
PLACEHOLDER = {kind: f"<{kind}>" for kind in (*KINDS, "context")}
SPAN = "array<struct<start:int,end:int,value:string,left:string>>"
BLOCK = 128
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TOKEN = r"(?<!\S)[^\s0-9@]*[0-9@]\S*"


def matches(text: Column, pattern: str, left=lambda gap: F.lit("")) -> Column:
    """All leftmost non-overlapping matches with their places: lengths of the gaps and matches add up to the starts.

    ``left`` makes a string of the gap before a match. The last gap has no match and adds nothing. The running sums are
    built in blocks that are shifted afterwards, since appending to one long array would take quadratic time.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"), left(gap).alias("left")))
    start = lambda acc, x: acc["at"] + x["gap"]
    end = lambda acc, x: start(acc, x) + F.length(x["value"])
    span = lambda acc, x: F.struct(start(acc, x).alias("start"), end(acc, x).alias("end"), x["value"].alias("value"), x["left"].alias("left"))
    block = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), lambda acc, x: F.when(
        x["value"].isNull(), acc).otherwise(F.struct(end(acc, x).alias("at"), F.array_append(acc["out"], span(acc, x)).alias("out"))))
    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(BLOCK)), lambda at: block(F.slice(p, at + 1, BLOCK)))
    offsets = lambda bs: F.aggregate(bs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, b: F.struct(
        (acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    shifted = lambda b, by: F.transform(b["out"], lambda x: F.struct(
        (x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value"), x["left"].alias("left")))
    return let(pairs, lambda p: let(blocks(p), lambda bs: F.flatten(F.zip_with(bs, offsets(bs), shifted))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(value: Column) -> Column:
    d = digits(value)
    n = F.length(d)
    double = lambda i: F.substr(d, i, F.lit(1)).cast("int") * (1 + F.pmod(n - i, F.lit(2)))
    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + double(i) - F.when(double(i) > 9, 9).otherwise(0)), F.lit(10)) == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the fixed formats by kind; failing matches are dropped without another try."""
    none = F.array().cast(SPAN)
    # A dot outside a domain becomes a sign that only the local part can hold; a lone separator one that no card holds.
    dotted = F.regexp_replace(text, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "%")
    joined = F.regexp_replace(text, r"(?<![0-9])[ -]|[ -](?![0-9])", "\x01")
    email = matches(dotted, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")
    ip = F.filter(matches(text, r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), lambda x: x["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    card = F.filter(matches(joined, "[0-9][0-9 -]+"), lambda x: F.length(digits(x["value"])).between(16, 19))
    card = F.filter(card, lambda x: luhn(x["value"]))
    phone = F.filter(matches(text, r"\+[0-9][ ().0-9-]+[0-9]"), lambda x: F.length(digits(x["value"])).between(8, 15))
    return {"email": F.when(text.contains("@"), email).otherwise(none), "ip": F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), ip).otherwise(none),
            "card": F.when(text.rlike("[0-9][0-9 -]{14}"), card).otherwise(none), "phone": F.when(text.rlike(r"\+[0-9]"), phone).otherwise(none)}


def candidates(text: Column, base: Column) -> Column:
    """Tokens with a digit or an at-sign: place, value without outer signs, left word in letters, and whether a base span covers any of it."""
    spaced = lambda gap: F.rtrim(F.translate(gap, "\t\n\r\f\x0b", "     "))
    found = matches(text, TOKEN, lambda gap: F.regexp_replace(F.lower(F.substring_index(spaced(gap), " ", -1)), r"[^\p{L}]+", ""))
    seed = lambda x: F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    trimmed = lambda x: F.regexp_replace(x["value"], r"^[^\p{L}\p{N}+]+", "")
    value = lambda x: F.regexp_replace(trimmed(x), r"[^\p{L}\p{N}]+$", "")
    start = lambda x: x["end"] - F.length(trimmed(x))
    # The size of ``base`` is asked for outside the lambda, so that the optimizer keeps the column and does not copy its
    # expression into the lambda, where it would run for every token.
    made = F.transform(F.filter(found, lambda x: x["left"] != ""), lambda x: F.struct(
        x["left"].alias("pattern"), value(x).alias("instance"), start(x).alias("start"), (start(x) + F.length(value(x))).alias("end"), seed(x).alias("seed")))
    return F.when(text.rlike("[0-9@]") & (F.size(base) >= 0), F.filter(made, lambda x: x["instance"] != "")).otherwise(
        F.array().cast("array<struct<pattern:string,instance:string,start:int,end:int,seed:boolean>>"))


def annotate(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of docs), the key of the text, base spans by kind, and candidates."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("row", "t", F.xxhash64("t").alias("key"), *[span.alias(kind) for kind, span in base_spans(F.col("t")).items()])
    # Values were cut from blanked copies; the text has them as they are.
    return rows.withColumn("base", F.concat(*[F.transform(kind, lambda x: F.struct(x["start"], x["end"])) for kind in KINDS]))


def rank(edges: DataFrame, rounds: int = 3, smooth: float = 2.0, least: int = 5, limit: float = 0.8) -> DataFrame:
    """Iterate scores over (pattern, instance, seed) rows; pattern and instance of the pairs worth a span.

    Every round sums by pattern and by instance, so a pattern with a third of all instances is summed map-side.
    """
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + smooth)).alias("conf"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        joined = edges.join(patterns, "pattern")
        instances = joined.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.when(F.col("seeds") >= least, F.col("conf")).otherwise(0.0))))).alias("own"))
        scored = written(joined.join(instances, "instance").select("pattern", "instance", "seed", "conf", "seeds", F.when(F.col("seed"), 1.0).otherwise(F.col("own")).alias("score")))
    return scored.where((F.col("conf") >= limit) & (F.col("seeds") >= least) & (F.col("score") >= limit) & ~F.col("seed")).select("pattern", "instance")


def discover(annotated: DataFrame) -> DataFrame:
    """Key of a text and its context spans, from the candidates of all texts."""
    found = annotated.select("key", F.explode("candidates").alias("c")).select("key", "c.*")
    edges = written(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    good = rank(edges)
    return (found.where(~F.col("seed")).join(good, ["pattern", "instance"], "left_semi")
            .groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("context")))


def scanned(docs: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Written base spans and candidates of every row (kept columns, key, kinds, candidates), and the context spans by key."""
    rows = annotate(docs)
    rows = written(rows.select(*[f"row.{c}" for c in keep], "key", *KINDS, candidates(F.col("t"), F.col("base")).alias("candidates")))
    return rows, written(discover(rows))


def scan(docs: DataFrame) -> DataFrame:
    """Doc_id, counts by kind, digest of the base spans, all spans, and the number of context spans of every row."""
    rows, context = scanned(docs.select("doc_id", "text"), "doc_id")
    named = lambda kind: F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))
    base = F.concat(*[named(k) for k in KINDS])
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (rows.join(context, "key", "left").withColumn("context", F.coalesce("context", none))
            .select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                    F.array_join(F.concat(base, named("context")), ",").alias("spans"), F.size("context").cast("long").alias("n_context")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind's placeholder; n_chars, if there, follows the text.

    Overlapping spans are replaced by the first one's placeholder.
    """
    _, context = scanned(docs.select("text"))
    rows = annotate(docs).join(context, "key", "left")
    tagged = lambda kind: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(PLACEHOLDER[kind]).alias("put")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.array_sort(F.concat(*[tagged(k) for k in (*KINDS, "context")]))
    rows = rows.withColumn("context", F.coalesce("context", none)).withColumn("spans", spans)
    t = F.col("t")
    step = lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substr(t, acc["at"] + 1, x["start"] - acc["at"]), x["put"]).alias("out")))
    cut = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1, F.length(t))))
    rows = rows.select("row", F.when(F.size("spans") > 0, cut).otherwise(F.col("row.text")).alias("new"))
    return rows.select(*[F.col("new").alias("text") if c == "text" else F.length("new").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
                         for c in docs.columns])
