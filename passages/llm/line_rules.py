"""Line-first cleaning: rules judge every line, failed lines go, and a document that loses too much text is rejected.

A line is what ``\\n`` separates; one without a word is blank and judged by no rule. A line fails

* the punctuation rule, if it does not end in a full stop, question mark, exclamation mark, ellipsis or colon (closing quotes
  and brackets may follow), or if over a fifth of its words end in doubled or mixed signs such as ``!!`` or ``%%%``;
* the navigation rule, if it has three separators or more (``|``, ``>``, guillemets, bullets, arrows) and one for every four words;
* the boilerplate rule, if it holds a phrase of ``BOILERPLATE``.

Before the lines, base rules look at the whole text: its length in words, and how many words lie in windows of
``WINDOW`` words that occur twice or more in it. Everything is DataFrame functions on the document's own row, so there is
no shuffle; windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: phrases in lower case that stand in notices and page furniture
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies",
    "accept cookies", "enable javascript", "sign up", "subscribe to", "click here", "read more", "share this", "log in",
    "lorem ipsum", "powered by", "skip to content", "back to top", "page not found", "licensed under",
)

ENDS = (".", "!", "?", ":", "…")
CLOSERS = "\"')]»“”’"
SIGNS = r"(?:[!?]{2}|[#*$%&|<>]{2})(?=[\x20\x09-\x0D]|\z)"
SEPARATORS = "|>«»•→"


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in parts])


def words_in(line: Column) -> Column:
    """Words of a line: parts between white space, without the empty ends."""
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def unfinished(line: Column) -> Column:
    bare = F.rtrim(line, F.lit(BLANKS + CLOSERS))
    return ~reduce(Column.__or__, [bare.endswith(e) for e in ENDS])


def signed(line: Column) -> Column:
    return 5 * F.regexp_count(line, F.lit(SIGNS)) > words_in(line)


def navigates(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(f"[{SEPARATORS}]"))
    return (n >= 3) & (4 * n >= words_in(line))


def furniture(line: Column) -> Column:
    return holds_any(F.lower(line), BOILERPLATE)


def fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule."""
    return unfinished(line) | signed(line) | navigates(line) | furniture(line)


def _next(runs: str, ahead: int):
    return lambda h, i: F.xxhash64(h, F.get(F.col(runs), i + ahead))


def _repeat_words(rows: DataFrame, window: int) -> DataFrame:
    """``_repeat``: how many words of ``_words`` lie in a window that occurs twice or more.

    Only rows that repeat a window sort theirs; equal neighbours in that order are the repeated ones, and each start in
    text order covers ``window`` words or as many as it is away from the start before."""
    steps = rows.withColumn("_codes", F.transform("_words", lambda w: F.xxhash64(w)))
    last, span = "_codes", 1
    while span < window:
        # a run of 2 n words is two runs of n; in a width that is no power of two the halves overlap
        ahead = min(span, window - span)
        steps = steps.withColumn(f"_runs{span}", F.transform(last, _next(last, ahead)))
        last, span = f"_runs{span}", span + ahead
    full = F.when(F.size("_codes") >= window, F.slice(last, F.lit(1), F.size("_codes") - window + 1))
    steps = steps.withColumn("_windows", F.coalesce(full, F.array().cast("array<long>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = steps.withColumn("_ordered", F.when(repeats, ordered))

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(F.col("_ordered"), i - 1)["h"], F.get(F.col("_ordered"), i + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    steps = steps.withColumn("_places", F.sort_array(F.transform(F.filter("_ordered", twice), lambda x: x["i"])))
    covers = F.transform("_places", lambda p, i: F.least(F.lit(window), p - F.coalesce(F.get(F.col("_places"), i - 1), p - window)))
    total = F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)
    return steps.withColumn("_repeat", F.coalesce(total, F.lit(0).cast("long")))


def clean_lines(
    docs: DataFrame, least_words: int = 20, repeat_percent: int = 30, lost_percent: int = 50, window: int = WINDOW, key: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs`` with its key, the counts of the text, the cleaned text and the verdict.

    Columns: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_failed_lines,
    n_words_kept (long), cleaned, base_failed, kept (boolean). ``base_failed`` says that the text has fewer than
    ``least_words`` words or that over ``repeat_percent`` of them are repeated; ``kept`` that it passes these and that
    its failed lines hold at most ``lost_percent`` of its words. ``cleaned`` has the remaining lines in their order.

    A null text counts as an empty one: no words, zeros, cleaned empty, not kept. Rows that repeat a key and rows with a null key
    are judged one by one. Other columns of ``docs`` are left out, whatever their names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), text.alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = _repeat_words(rows, window)
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD))
    rows = rows.select(
        "_key", "_text", F.size("_words").cast("long").alias("n_words"), F.col("_repeat").alias("n_repeat_words"), lines.alias("_lines"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
    )
    text, lines = F.col("_text"), F.col("_lines")
    # only a text that holds the signs, separators or phrases of the other rules has its lines searched for them
    rows = rows.withColumn("_low", F.lower(text))
    suspect = text.rlike(f"[!?]{{2}}|[{SYMBOLS}{SEPARATORS}]") | holds_any(F.col("_low"), BOILERPLATE)
    rows = rows.withColumn("_bad", F.when(suspect, F.transform(lines, fails)).otherwise(F.transform(lines, unfinished)))
    good = F.array_compact(F.zip_with(lines, "_bad", lambda line, b: F.when(~b, line)))
    bad = F.array_compact(F.zip_with(lines, "_bad", lambda line, b: F.when(b, line)))
    rows = rows.withColumn("cleaned", F.array_join(good, "\n"))
    rows = rows.withColumn("_lost", F.when(F.exists("_bad", lambda b: b), words_in(F.array_join(bad, "\n"))).otherwise(0))
    rows = rows.withColumn("n_words_kept", F.col("n_words") - F.col("_lost"))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    lost = 100 * (F.col("n_words") - F.col("n_words_kept")) > lost_percent * F.col("n_words")
    return rows.select(
        F.col("_key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_bad", lambda b: b)).cast("long").alias("n_failed_lines"),
        "n_words_kept",
        "cleaned",
        base.alias("base_failed"),
        (~base & ~lost).alias("kept"),
    )
