"""Quality rules, line first.

Every line of a text meets the line rules alone; lines that fail are removed, and a document is rejected when the
removal takes too much of it, or when it fails the base rules on its whole text. All of it is built-in column
functions, one pass over the table and no shuffle: a long text costs its own length (sorting its five-word windows
apart), and equal keys, hot sources or copies change nothing.

Defined results: a null text has no words and no lines, so it fails the base rules; an empty text likewise. Rows are
judged one by one: repeated rows give repeated results, an empty table gives an empty one. Further columns are kept;
one whose name a result column has is replaced by it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import let, plus_columns, unused, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Characters that end a sentence, closing quotes and brackets included.
SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？", ":", ";", '"', "'", "”", "’", "»", ")", "]")
#: Phrases of page furniture, in lower case.
FURNITURE = ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "javascript is disabled",
             "lorem ipsum", "click here", "sign up for our newsletter", "subscribe to our newsletter", "share this article", "skip to content", "back to top")
#: Marks between the entries of a menu or a breadcrumb trail.
TRAIL_MARKS = ("|", "›", "»", "•", "·", "→")

RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "n_words_left", "kept", "clean_text")


def _only(text: Column, kept: str) -> Column:
    """How many characters of a text are in `kept`, the inside of a character class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def symbols_in(text: Column) -> Column:
    return _only(text, SYMBOLS)


def repeated_window_words(words: Column) -> Column:
    """How many words lie in a window of five words that the text has twice or more, first occurrences included."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        # sorted starts of repeated windows: each adds five words, or what lies before the next one
        return F.aggregate(starts, F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
                           lambda acc, p: F.struct((acc["words"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("words"), p.alias("last")), lambda acc: acc["words"])

    def repeated(order: Column) -> Column:
        # in order of (window, start), a repeated window has an equal neighbour
        def start(x, i):
            same = (F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"])
            return F.when(same, x["p"])

        return F.array_sort(F.filter(F.transform(order, start), lambda p: p.isNotNull()))

    def judged(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), lambda order: covered(repeated(order))))

    return let(hashed, lambda h: F.when(F.size(h) < WINDOW + 1, F.lit(0)).otherwise(let(windows(h), judged)))


#: Longer lines are running text, whatever phrases they have.
FURNITURE_WORDS = 30


def line_fails(line: Column, words: Column, symbols: Column) -> Column:
    """Whether a line with words fails the line rules.

    Punctuation: it does not end as a sentence ends, or more than a tenth of its characters are symbols.
    Navigation: three or more trail marks. Boilerplate: at most 30 words with a phrase of page furniture.
    """
    furniture = let(F.lower(line), lambda x: reduce(or_, [F.contains(x, F.lit(phrase)) for phrase in FURNITURE]))
    # the exact count of marks only where a line has one
    marked = reduce(or_, [F.contains(line, F.lit(mark)) for mark in TRAIL_MARKS])
    return (~F.right(F.element_at(words, -1), F.lit(1)).isin(*SENTENCE_ENDS) | (symbols * 10 > F.length(line))
            | F.when(marked, _only(line, "".join(TRAIL_MARKS)) >= 3).otherwise(False) | F.when(F.size(words) <= FURNITURE_WORDS, furniture).otherwise(False))


def quality_rules(docs: DataFrame, text: str = "text", least_words: int = 10, most_repeat_percent: int = 20, most_lost_percent: int = 50) -> DataFrame:
    """Base counts, the verdict of the line rules and the cleaned text of every document.

    `clean_text` has the lines that pass, in order; lines without a word are dropped with the failing ones and count
    as neither. A document stays when it passes the base rules and loses at most `most_lost_percent` of its words.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def judged(lines: Column) -> Column:
        words = F.flatten(F.transform(lines, lambda x: x["words"]))
        passed = F.filter(lines, lambda x: ~line_fails(x["line"], x["words"], x["symbols"]))
        return let(words, lambda w: let(passed, lambda p: F.struct(
            F.size(w).cast("bigint").alias("n"), repeated_window_words(w).cast("bigint").alias("repeat"),
            F.length(F.concat_ws("", w)).cast("bigint").alias("chars"), F.aggregate(lines, F.lit(0).cast("bigint"), lambda acc, x: acc + x["symbols"]).alias("symbols"),
            (F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda x: x["line"])))).cast("bigint").alias("dup"),
            F.size(lines).cast("bigint").alias("lines"), (F.size(lines) - F.size(p)).cast("bigint").alias("failed"),
            F.aggregate(p, F.lit(0).cast("bigint"), lambda acc, x: acc + F.size(x["words"])).alias("left"),
            F.concat_ws("\n", F.transform(p, lambda x: x["line"])).alias("text"))))

    with_word = F.filter(F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("words"), symbols_in(x).alias("symbols"))), lambda x: F.size(x["words"]) > 0)
    (found,) = unused(docs.columns, "_judged")
    out = docs.withColumn(found, let(with_word, judged))
    x = {k: F.col(found)[k] for k in ("n", "repeat", "chars", "symbols", "dup", "lines", "failed", "left", "text")}
    base_failed = (x["n"] < least_words) | (100 * x["repeat"] > most_repeat_percent * x["n"])
    kept = ~base_failed & (100 * (x["n"] - x["left"]) <= most_lost_percent * x["n"])
    result = dict(zip(RESULT, (x["n"], x["chars"], x["symbols"], x["dup"], x["repeat"], base_failed, x["lines"], x["failed"], x["left"], kept, x["text"])))
    return out.select(*[F.col(f"`{c}`") for c in plus_columns(docs.columns, list(RESULT))], *[v.alias(k) for k, v in result.items()])
