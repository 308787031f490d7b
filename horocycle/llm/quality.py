"""Quality rules over whole texts and cross-document line frequency, in built-in expressions only.

Lines are normalised (lower case, white space collapsed) and hashed; per host, the distinct documents with a line are counted, where
documents of equal text count once, so that copies do not make a text boilerplate.  Lines that enough of a host's documents
share are above the limits and are removed; a document of which such lines make up too much is depleted and rejected.

Only hashes are shuffled, and both aggregations combine before the shuffle, so a host with a third of all rows is no
hot spot.  The lines above the limits are a bounded list per host (a share s leaves at most 1/s times the lines of a
document), which meets the documents as an array; texts stay in their partition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horocycle.llm import shared

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: What white space that is not one blank between words, or \n, shows itself by.
_ODD = ("  ", "\t", "\r", "\x0b", "\x0c")
#: Distinct documents of a host, and percent of its distinct documents, from which a line is above the limits.
LINE_DOCS, LINE_PERCENT = 10, 5
#: Percent of a document's words in removed lines above which it is depleted.
DEPLETED_PERCENT = 80


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _odd(text: Column, blanks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in blanks))


def normal_line(line: Column) -> Column:
    """Lower case, white space collapsed and trimmed; the regular expression runs only on lines that need it."""
    return F.trim(F.lower(F.when(_odd(line, (*_ODD, "\n")), F.regexp_replace(line, BLANKS, " ")).otherwise(line)))


def normal_lines(text: Column, min_chars: int) -> Column:
    """``normal_line`` of each \\n-split line of ``text``, null for those of fewer than ``min_chars`` characters.

    Texts without odd white space, looked for once in the whole of them, skip its search in each line.
    """
    lines = F.split(text, "\n")
    long = lambda f: F.transform(lines, lambda x: F.when(F.length(x) >= min_chars, f(x)))
    return F.when(_odd(text, _ODD), long(normal_line)).otherwise(long(lambda x: F.trim(F.lower(x))))


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows which the text has twice or more."""

    def covered(grams: Column) -> Column:
        places = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            equal = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, i: equal(x, i - 1) | equal(x, i + 1))

        at = F.sort_array(F.transform(let(places, twice), lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"))
        total = F.aggregate(at, start, add, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), total).otherwise(F.lit(0).cast("long"))

    def of(w: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window), covered)

    return F.when(F.size(words) >= 3, let(words, of)).otherwise(F.lit(0).cast("long"))


def base_rules(text: Column) -> Column:
    """The figures of a single text as a struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def _hashed_lines(docs: DataFrame) -> DataFrame:
    """``source, t, l``: digest of a text and hash of a line of it, each once."""
    lines = F.transform(F.filter(F.transform(F.split("text", "\n"), normal_line), lambda x: x != ""), lambda x: F.xxhash64(x))
    hashed = docs.where("text is not null").select("source", F.xxhash64("text").alias("t"), F.array_distinct(lines).alias("l"))
    return hashed.select("source", "t", F.explode("l").alias("l")).distinct()


def lines_above_limits(docs: DataFrame, least: int = LINE_DOCS, percent: int = LINE_PERCENT) -> DataFrame:
    """``source, lines``: per host the hashes of its normalised lines in at least ``least`` and ``percent`` of its distinct documents."""
    often = _hashed_lines(docs).groupBy("source", "l").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    size = docs.where("text is not null").select("source", F.xxhash64("text").alias("t")).distinct().groupBy("source").agg(F.count("*").alias("docs"))
    above = often.join(size.withColumnRenamed("source", "_host"), F.col("source").eqNullSafe(F.col("_host")))
    above = above.where(F.expr(f"100 * n >= {percent} * docs"))
    return shared.written(above.groupBy("source").agg(F.sort_array(F.collect_list("l")).alias("lines")), "lines-above-limits")


def with_lines_above(docs: DataFrame, least: int, percent: int) -> DataFrame:
    """``docs(text, source, ...)`` with ``lines``, the hashes of its host's lines above the limits (null: none).

    Where the lists of all hosts are too large to broadcast, ``lines`` holds those that the text itself has: only hashes meet the lists.
    """
    own = docs.select("source", "text")
    above = lines_above_limits(own, least, percent)
    if shared.is_small(above):
        return shared.looked_up(docs, above, ["source"], "left")
    single = shared.written(above.select("source", F.explode("lines").alias("l")), "line-of-host")
    found = shared.looked_up(_hashed_lines(own), single, ["source", "l"], "left_semi").groupBy("source", "t").agg(F.collect_list("l").alias("lines"))
    found = shared.written(found, "lines-above-of-texts")
    return shared.looked_up(docs.withColumn("t", F.xxhash64("text")), found, ["source", "t"], "left").drop("t")


def judged(depleted: int, text: Column, above: Column) -> Column:
    """All figures of ``text``, its verdict and ``rest``, the text without removed lines, as an array of one struct.

    Queries take it apart with ``inline``: a generator is evaluated once a row, where a filter or several columns of it
    would each evaluate it again.  Null counts as a text without words.
    """
    text = F.coalesce(text, F.lit(""))
    over = lambda x: let(normal_line(x), lambda n: (n != "") & F.array_contains(above, F.xxhash64(n)))

    def cut(lines: Column) -> Column:
        left = F.when(above.isNotNull(), F.filter(lines, lambda x: ~over(x))).otherwise(lines)
        return let(left, lambda x: F.struct((F.size(lines) - F.size(x)).cast("long").alias("n"), F.array_join(x, "\n").alias("rest")))

    def verdict(b: Column, c: Column) -> Column:
        failed = (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
        gone = F.when(c["n"] > 0, b["n_words"] - F.size(words_of(c["rest"]))).otherwise(0).cast("long")
        return let(
            gone,
            lambda words: F.struct(
                *(b[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                failed.alias("base_failed"),
                (~failed & (100 * words <= depleted * b["n_words"])).alias("kept"),
                c["n"].alias("n_removed_lines"),
                words.alias("n_removed_words"),
                c["rest"].alias("rest"),
            ),
        )

    return F.array(let(base_rules(text), lambda b: let(let(F.split(text, "\n"), cut), lambda c: verdict(b, c))))


def quality_rules(docs: DataFrame, least: int = LINE_DOCS, percent: int = LINE_PERCENT, depleted: int = DEPLETED_PERCENT) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)`` with the rules' figures and the verdict ``kept``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines,
    n_removed_words.  ``base_failed`` documents are rejected, and so are documents of whose words more than
    ``depleted`` percent stand in lines above the limits.  Null or blank text has no words and is rejected; a null
    source is a host of its own; a null doc_id stays null; repeated rows are judged alike; other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "source")
    found = with_lines_above(docs, least, percent).select("doc_id", F.inline(judged(depleted, F.col("text"), F.col("lines"))))
    return found.drop("rest")


def apply_rules(docs: DataFrame, least: int = LINE_DOCS, percent: int = LINE_PERCENT, depleted: int = DEPLETED_PERCENT) -> DataFrame:
    """The kept rows of ``docs`` with its own columns: lines above the limits are gone from ``text``, and ``n_chars`` follows.

    Columns of any name pass unchanged; see ``quality_rules`` for nulls and repeated rows.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars"))).alias("_own")
    rows = with_lines_above(docs.select(own, F.col("text").cast("string").alias("text"), "source"), least, percent)
    found = rows.select("_own", F.inline(F.filter(judged(depleted, F.col("text"), F.col("lines")), lambda v: v["kept"])))
    new = {"text": F.col("rest").alias("text"), "n_chars": F.length("rest").cast("long").alias("n_chars")}
    return found.select(*(new[c] if c in new else F.col("_own").getField(c).alias(c) for c in docs.columns))
