"""Benchmark decontamination by template canonicalisation.

White space collapses. Texts become token lists in which names, numbers and units are typed placeholders, so
a benchmark item that was re-parameterised keeps its template. Windows of ``WINDOW``
template tokens are hashed and joined: benchmark items give a window at every position,
documents one at every few positions, close enough that no leak can slip between them.
A shared window names a diagonal of document and item, on which all tokens are compared.
A stretch of equal template tokens is a leak if it is long enough and its slots are filled
consistently: equal values of the item stand for equal values of the document, and
different for different.

DataFrame functions only. Benchmark windows are broadcast where their counted number is
at most ``BROADCAST_WINDOWS``; beyond that Spark joins them by its own choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, scratch_path
from . import packed

WINDOW = 8
LEAK = 13  # tokens in a row, or the whole item where it is shorter
STRIDE = 6
LEAST = 5  # tokens of the shortest item that is searched
LITERALS = 2  # ordinary words that a window needs to be met by its template; others are met by their own values
BROADCAST_WINDOWS = 500_000
KINDS = "pnuq"  # marks of slots; q is a capitalised word that is no name inside a sentence
SIGN = -1 << 63  # codes of ordinary words are negative, those of slots the place of their mark

# Unit words, recognised after a number.
UNITS = (
    "kilometers kilometres kilometer kilometre centimeters centimetres millimeters meters metres "
    "kilograms kilogram grams gram tonnes tons pounds ounces inches feet yards miles mile "
    "liters litres liter litre gallons hours hour minutes minute seconds second days weeks months "
    "years dollars euros cents percent degrees celsius fahrenheit watts volts joules newtons "
    "km cm mm kg mg lb lbs oz ft mph kmh kwh kw ml hz khz mhz ghz kb mb gb tb"
).split()

# A look-ahead comes first where one can reject most positions cheaply.
NAME = r"(?=\p{Lu})(?<=[^.!?:\s>][)\]\"',;]?[ ])\p{Lu}\p{L}+"
NUMBER = r"(?=[+\-$€£\p{Nd}])(?<![\p{L}\p{N}<])[+-]?[$€£]?\p{Nd}+(?:[.,:/]\p{Nd}+)*%?(?![\p{N}])"
UNIT = r"(?i)(<n(?::[^>]*)?>[ ]?)(%s)(?![\p{L}\p{N}])" % "|".join(UNITS)
# Further capitalised words of a text whose names are marked.
REST = r"(?<![\p{L}\p{N}])(?<!<p:)\p{Lu}\p{L}+"
SPACES = r"(?:[^\S ]| (?=\s))\s*"  # runs of white space but for the single space
TOKEN = r"<[pqnu](?::[^>]*)?>|[\p{L}\p{N}]+"


def _plain(text: Column) -> Column:
    """The text with angle brackets as spaces, and runs of white space as one."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "<>", "  "), SPACES, " ")


def _tokens(named: Column, values: bool) -> Column:
    """Tokens of a text whose names are marked."""
    marked = F.regexp_replace(named, NUMBER, "<n:$0>" if values else "<n>")
    marked = F.regexp_replace(marked, UNIT, "$1<u:$2>" if values else "$1<u>")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def template_tokens(text: Column, values: bool = False) -> Column:
    """Tokens of a text; slots are <p>, <n> and <u>, or <p:value> and so on with ``values``.

    Both forms have the same number of tokens. Names are capitalised words inside a sentence.
    """
    return _tokens(F.regexp_replace(_plain(text), NAME, "<p:$0>" if values else "<p>"), values)


def _coded(tokens: Column) -> Column:
    """[(kind, word)] of marked tokens: the place of the mark in ``KINDS`` or 0, and a negative hash of the value."""
    def coded(t: Column) -> Column:
        kind = F.when(_is_slot(t), F.position(F.substring(t, 2, 1), F.lit(KINDS))).otherwise(F.lit(0))
        value = F.when(_is_slot(t), F.substring(t, F.lit(4), F.length(t) - 4)).otherwise(t)
        return F.struct(kind.alias("kind"), F.xxhash64(value).bitwiseOR(F.lit(SIGN)).alias("word"))

    return F.transform(tokens, coded)


def _templates(codes: Column) -> list[Column]:
    """Template codes in the three readings: a slot is its kind, an ordinary word its hash."""
    name, number, _, capital = range(1, len(KINDS) + 1)
    reading = [lambda c: F.when((c["kind"] == 0) | (c["kind"] == capital), c["word"]).otherwise(c["kind"]),
               lambda c: F.when(c["kind"] == 0, c["word"]).otherwise(F.when(c["kind"] == capital, F.lit(name)).otherwise(c["kind"])),
               lambda c: F.when(c["kind"] == number, F.lit(number)).otherwise(c["word"])]
    return [F.transform(codes, r) for r in reading]


def _fillings(tokens: Column) -> list[Column]:
    """Tokens in the three readings, slots with their values."""
    def without(kinds: str, t: Column) -> Column:
        """The value of a token marked with one of ``kinds``, other tokens as they are."""
        marked = F.substring(t, 1, 3).isin(*[f"<{k}:" for k in kinds])
        return F.when(marked, F.substring(t, F.lit(4), F.length(t) - 4)).otherwise(t)

    return [F.transform(tokens, lambda t: without("q", t)),
            F.transform(tokens, lambda t: F.when(t.startswith("<q:"), F.concat(F.lit("<p:"), F.substring(t, F.lit(4), F.length(t)))).otherwise(t)),
            F.transform(tokens, lambda t: without("pqu", t))]


def _readings(text: Column, filled: bool = True) -> Column:
    """(reading, template, word, filled): the text's tokens read in three ways, with two codes per token.

    Names are capitalised words inside sentences (0), all capitalised words (1), or none (2:
    names and units are ordinary words, whatever their case). ``template`` codes a slot by its kind, ``word``
    codes the value of every token. ``filled`` has the tokens; a search that needs codes only leaves it out.
    """
    # Capitalised words that are no names inside sentences are marked <q:...>; each reading takes them its way.
    named = F.regexp_replace(F.regexp_replace(_plain(text), NAME, "<p:$0>"), REST, "<q:$0>")

    def read(tokens: Column, codes: Column) -> Column:
        extra = [[f.alias("filled")] for f in _fillings(tokens)] if filled else [[], [], []]
        return F.array(*(F.struct(F.lit(i).alias("reading"), t.alias("template"), codes.getField("word").alias("word"), *extra[i])
                         for i, t in enumerate(_templates(codes))))

    # Arrays of one element bind the tokens and their codes, so that each is made once.
    bound = F.transform(F.array(_tokens(named, True)), lambda tokens: F.flatten(
        F.transform(F.array(_coded(tokens)), lambda codes: read(tokens, codes))))
    return F.inline(F.flatten(bound))


def _is_slot(token: Column) -> Column:
    return token.startswith("<")


def _template(filled: Column) -> Column:
    """Tokens without the values of their slots."""
    return F.transform(filled, lambda t: F.when(_is_slot(t), F.concat(F.substring(t, 1, 2), F.lit(">"))).otherwise(t))


def _window(tokens: Column, at: Column, width: int) -> Column:
    return F.slice(tokens, at + 1, F.lit(width))


def _starts(tokens: Column, width: int, stride: int) -> Column:
    last = F.size(tokens) - width
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _literals(template: Column, at: Column, width: int) -> Column:
    """Ordinary words of a window."""
    return F.size(F.filter(_window(template, at, width), lambda c: c < 0))


def _print(at: Column, width: int) -> Column:
    """Hash of a window: of its template if it has enough ordinary words, else of its own values too."""
    template, word = F.col("template"), F.col("word")
    return F.when(_literals(template, at, width) >= LITERALS, F.xxhash64("reading", _window(template, at, width))).otherwise(
        F.xxhash64("reading", _window(template, at, width), _window(word, at, width)))


def _sampled(width: int, stride: int) -> Column:
    """(from, print) every ``stride`` tokens; where the window there has too few ordinary words, at all starts around it."""
    template = F.col("template")
    last = F.size(template) - width

    def around(at: Column) -> Column:
        here = F.struct(at.alias("from"), F.xxhash64("reading", _window(template, at, width)).alias("print"))
        near = F.sequence(F.greatest(at - (stride - 1), F.lit(0)), F.least(at + (stride - 1), last))
        return F.when(_literals(template, at, width) >= LITERALS, F.array(here)).otherwise(
            F.transform(near, lambda i: F.struct(i.alias("from"), _print(i, width).alias("print"))))

    return F.flatten(F.transform(_starts(template, width, stride), around))


def benchmark_windows(items: DataFrame, width: int) -> DataFrame:
    """(item, at, print) for every window of an item in one reading."""
    placed = items.select("item", "reading", "template", "word", F.explode(_starts(F.col("filled"), width, 1)).alias("at"))
    return placed.select("item", "at", _print(F.col("at"), width).alias("print"))


def _bounded(windows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(windows) if count <= BROADCAST_WINDOWS else windows


def _stretches(same: Column) -> Column:
    """Maximal stretches (at, n) of true in an array."""
    breaks = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(same) - 1), lambda i: ~F.get(same, i)), F.array(F.size(same)))
    return F.zip_with(F.slice(breaks, F.lit(1), F.size(breaks) - 1), F.slice(breaks, F.lit(2), F.size(breaks) - 1),
                      lambda a, z: F.struct((a + 1).alias("at"), (z - a - 1).alias("n")))


def consistent_stretches(runs: DataFrame) -> DataFrame:
    """``runs`` (with token arrays ``d`` and ``i`` of equal templates) with ``leak`` (at, n, exact): a row per
    maximal stretch in which equal values of the item stand for equal ones of the document, and different for different.

    A slot is barred by the last slot before it that contradicts it. A stretch starts after
    such a slot, or with the run, and ends before the first slot that is barred by one inside.
    """
    indexed = F.transform(F.arrays_zip("d", "i"), lambda x, at: F.struct(at.alias("at"), x["d"].alias("d"), x["i"].alias("i")))
    slots = materialize(runs.withColumn("slots", F.filter(indexed, lambda x: _is_slot(x["i"]))))

    def barred(x: Column) -> Column:
        against = F.filter("slots", lambda y: (y["at"] < x["at"]) & ((y["d"] == x["d"]) != (y["i"] == x["i"])))
        return F.struct(x["at"].alias("at"), F.coalesce(F.array_max(F.transform(against, lambda y: y["at"])), F.lit(-1)).alias("by"))

    # Distinct pairs decide whether anything contradicts at all; nearly all runs stop here.
    pairs = F.array_distinct(F.transform("slots", lambda x: F.struct(x["d"], x["i"])))
    fine = ((F.size(pairs) == F.size(F.array_distinct(F.col("slots.d")))) & (F.size(pairs) == F.size(F.array_distinct(F.col("slots.i")))))
    bars = slots.withColumn("bars", F.when(fine, F.array().cast("array<struct<at:int,by:int>>"))
                            .otherwise(F.transform("slots", barred)))
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("bars", lambda b: b["by"] + 1)))
    begun = materialize(bars.withColumn("at", F.explode(starts)))
    end = F.coalesce(F.array_min(F.transform(F.filter("bars", lambda b: b["by"] >= F.col("at")), lambda b: b["at"])), F.size("d"))
    ended = begun.withColumn("end", end)
    # A start is needed if the slot before it contradicts one inside.
    needed = (F.col("at") == 0) | F.exists("bars", lambda b: (b["by"] == F.col("at") - 1) & (b["at"] < F.col("end")))
    inside = F.filter("slots", lambda x: (x["at"] >= F.col("at")) & (x["at"] < F.col("end")))
    return ended.where(needed).withColumn("leak", F.struct(
        "at", (F.col("end") - F.col("at")).alias("n"), F.forall(inside, lambda x: x["d"] == x["i"]).alias("exact"))).drop(
        "slots", "bars", "at", "end")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
               item_key: str = "item_id", item_text: str = "text", width: int = WINDOW, leak: int = LEAK,
               least: int = LEAST) -> DataFrame:
    """(key, row, item_id, start, n_tokens, exact): leaked runs, one row per document, item and start.

    ``start`` counts template tokens of the document, ``n_tokens`` is the run's length,
    ``exact`` says that all slots have the item's own values, and ``row`` identifies the
    row (key and text) for joins. A leak is a stretch of ``leak`` template tokens, or of a
    whole item that is shorter, whose slots are filled consistently. Runs are found by a window
    with two ordinary words, or by one with the item's own values. Texts are read three times:
    with names inside sentences only, with every capitalised word as a name, and without
    names, so copies in another case are found. Items of fewer than ``width`` tokens are found as
    copies word for word, whole; those of fewer than ``least``, or null, are too short to tell.

    Null and empty texts hold no leak. Rows with a null key are searched like others.
    Repeated items and repeated rows count once. Other columns are not used. An empty table on either side gives an empty result.
    """
    items = benchmark.select(F.col(f"`{item_key}`").alias("item"), _readings(F.col(f"`{item_text}`")))
    items = items.where(F.size("filled") >= least).distinct()
    path = scratch_path(docs.sparkSession, "templates")
    items.withColumn("item_row", F.xxhash64("item", "reading", "filled")).write.parquet(path)
    every = docs.sparkSession.read.parquet(path)
    items, short = every.where(F.size("filled") >= width), every.where((F.size("filled") < width) & (F.col("reading") == 2))
    windows = benchmark_windows(items.drop("item").withColumnRenamed("item_row", "item"), width)
    count, shortest = windows.count(), items.agg(F.min(F.size("filled"))).first()[0]
    stride = max(1, min(STRIDE, min(leak, shortest or leak) - width + 1))

    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = rows.withColumn("_row", F.xxhash64("_key", "_text"))
    tokens = rows.select("_row", _readings(F.col("_text"), filled=False))
    known = windows.select("print").distinct()
    near = tokens.select("_row", F.inline(_sampled(width, stride))).select("_row", "print").join(_bounded(known, count), "print").select("_row").distinct()
    path = scratch_path(docs.sparkSession, "suspects")
    near.write.parquet(path)
    suspects = docs.sparkSession.read.parquet(path)

    close = rows.join(suspects, "_row", "left_semi").dropDuplicates(["_row"])
    path = scratch_path(docs.sparkSession, "suspect-texts")
    close.select("_row", "_key", _readings(F.col("_text"))).write.parquet(path)
    close = docs.sparkSession.read.parquet(path)
    met = (close.select("_row", "reading", F.inline(_sampled(width, stride))).join(_bounded(windows, count), "print")
           .select("_row", "reading", "item", (F.col("from") - F.col("at")).alias("offset")).distinct())
    # Every diagonal that holds a leak has a met window; on it all tokens are compared.
    named = items.select(F.col("item_row").alias("item"), F.col("item").alias("item_id"), F.col("filled").alias("item_tokens"))
    both = met.join(named, "item").join(close.withColumnRenamed("filled", "doc_tokens"), ["_row", "reading"])
    first, last = F.greatest("offset", F.lit(0)), F.least(F.size("doc_tokens"), F.size("item_tokens") + F.col("offset"))
    both = both.select("_row", "_key", "item_id", first.alias("first"), F.least(F.lit(leak), F.size("item_tokens")).alias("needed"),
                       F.slice("doc_tokens", first + 1, last - first).alias("d"),
                       F.slice("item_tokens", first - F.col("offset") + 1, last - first).alias("i"))
    alike = both.withColumn("run", F.explode(_stretches(F.zip_with(_template(F.col("d")), _template(F.col("i")), lambda d, i: d == i))))
    alike = alike.where("run.n >= needed").select("_row", "_key", "item_id", "needed", (F.col("first") + F.col("run.at")).alias("first"),
                                                  F.slice("d", F.col("run.at") + 1, F.col("run.n")).alias("d"),
                                                  F.slice("i", F.col("run.at") + 1, F.col("run.n")).alias("i"))
    runs = consistent_stretches(alike).where("leak.n >= needed")
    found = runs.select(
        F.col("_key").alias(key), F.col("_row").alias("row"), "item_id", (F.col("first") + F.col("leak.at")).alias("start"),
        F.col("leak.n").alias("n_tokens"), F.col("leak.exact").alias("exact"))
    found = found.unionByName(_short_copies(rows, short, key))
    longest = found.groupBy(key, "row", "item_id", "start").agg(F.max(F.struct("n_tokens", "exact")).alias("run"))
    return longest.select(key, "row", "item_id", "start", "run.n_tokens", "run.exact")


def _short_copies(rows: DataFrame, short: DataFrame, key: str) -> DataFrame:
    """Whole copies, word for word, of items that are shorter than a window: every start of a text is compared."""
    sizes = [r[0] for r in short.select(F.size("filled")).distinct().collect()]  # below the width: a few numbers
    wanted = short.select(F.col("item").alias("item_id"), F.col("filled").alias("wanted"), F.xxhash64("template", "word").alias("print"))

    def copies(n: int) -> Column:
        return F.transform(_starts(F.col("word"), n, 1), lambda i: F.struct(
            i.alias("start"), F.lit(n).alias("n_tokens"), F.xxhash64(_window(F.col("template"), i, n), _window(F.col("word"), i, n)).alias("print"),
            _window(F.col("filled"), i, n).alias("copy")))

    none = F.array().cast("array<struct<start:int,n_tokens:int,print:bigint,copy:array<string>>>")
    plain = rows.where(F.lit(bool(sizes))).select("_row", _readings(F.col("_text"))).where(F.col("reading") == 2)
    met = plain.select("_row", F.inline(F.concat(none, *map(copies, sizes)))).join(wanted, "print").where(F.col("copy") == F.col("wanted"))
    named = rows.select("_row", "_key").distinct()
    return met.join(named, "_row").select(
        F.col("_key").alias(key), F.col("_row").alias("row"), "item_id", "start", "n_tokens", F.lit(True).alias("exact"))


def without_leaks(docs: DataFrame, leaks: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a leak; null keys and texts are kept."""
    name = packed.unused(docs, "_row")
    rows = leaks.select(F.col("row").alias(name)).distinct()
    marked = docs.withColumn(name, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")))
    return marked.join(rows, name, "left_anti").drop(name)
