"""Removal of repeated and nearly repeated lines, in built-in expressions only.

Lines are normalised; those of at least ``min_chars`` characters take part.  An occurrence is removed if an earlier one (by doc_id,
then line number, then the text's digest) has an equal line or one within ``threshold`` edits.  Near lines are found by a segment-partition
edit join: a line of length l is indexed by its threshold + 1 segments under (length, segment number, segment), so
any line within the threshold contains one of them unchanged; a line probes the indexes of the lengths up to the
threshold below its own, at the few places that the multi-match-aware rule leaves.  Candidates that agree in letter
counts are verified by banded bit-parallel edit distance.

Only hashes are shuffled until few lines are left: a key that one line alone has goes no further, and texts are
fetched for the rest.  A line that many documents share sends its keys once.

A key that very many lines share (a template's segment) would let all of them meet.  Its rows are dealt by salt instead of gathered, its
lines are first held against a few pivots of the key, and two lines meet again only where one of them is still undecided
and they share, under that key, a second key as well: a segment of what is left of them without the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horocycle.llm import shared
from horocycle.llm.quality import DEPLETED_PERCENT, let, normal_lines, words_of

THRESHOLD, MIN_CHARS = 2, 40
_LETTERS = "etaonisrhdlucmfw"


#: Index rows of a key above which it is a hot one, and index rows of one task's share of a key.
HOT_LINES, SHARE = 64, 1024
#: Of the documents, one in this many is looked at to tell which keys get salts; results do not depend on it.
SAMPLE, SALTS = 128, 64


def _codes(threshold: int) -> Column:
    """The keys of a line as one array of numbers, each a segment, how much shorter the indexed line is, and a shift.

    Shift and difference 0 are the line's own segments, which index it; the others are what the multi-match-aware rule leaves.
    """
    out = []
    for delta in range(threshold + 1):
        for i in range(threshold + 1):
            for shift in range(max(-i, delta - (threshold - i)), min(i, delta + (threshold - i)) + 1):
                out.append(F.lit((i << 16) | (delta << 8) | (shift + 128)))
    return F.array(*out)


def _placed(lines: DataFrame, threshold: int) -> DataFrame:
    """``lines(line, n, ...)`` once for each of its keys, with ``i, delta, shift, start, size`` of the segment (start from 1).

    Segments are as even as can be, the longer ones last.  One small expression a row stays within compiled code.
    """
    rows = lines.select("*", F.explode(_codes(threshold)).alias("code"))
    rows = rows.selectExpr("* except (code)", "shiftright(code, 16) as i", "shiftright(code, 8) & 255 as delta", "(code & 255) - 128 as shift")
    k = threshold + 1
    return rows.selectExpr(
        "*", f"i * ((n - delta) div {k}) + greatest(0, i - {k} + (n - delta) % {k}) + 1 + shift as start", f"(n - delta) div {k} + if(i >= {k} - (n - delta) % {k}, 1, 0) as size"
    )


def _keys(lines: DataFrame, threshold: int) -> DataFrame:
    """``h, key, probe``: rows that only probe, and rows (not ``probe``) that also index their line.

    Where each character is one byte, the segment is cut from the bytes, which need no counting and have the same hash.
    """
    of = lambda line: f"xxhash64(n - delta, i, substring({line}, start, size))"
    key = f"if(octet_length(line) = n, {of('cast(line as binary)')}, {of('line')}) as key"
    return _placed(lines, threshold).selectExpr("h", key, "delta <> 0 or shift <> 0 as probe")


def _letters(line: Column) -> Column:
    """Counts modulo 16 of the commonest letters, four bits each."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(_LETTERS):
        count = (F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))) % 16
        out = out.bitwiseOR(F.shiftleft(count.cast("long"), 4 * k))
    return out


def _apart(a: str, b: str) -> str:
    """SQL for a lower bound of the summed differences of letter counts."""
    terms = []
    for k in range(len(_LETTERS)):
        d = f"(((shiftrightunsigned({a}, {4 * k}) & 15) - (shiftrightunsigned({b}, {4 * k}) & 15)) & 15)"
        terms.append(f"least({d}, 16 - {d})")
    return " + ".join(terms)


def edit_distance_within(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of two strings whose lengths differ by ``threshold`` at most, if it is within it (else something larger).

    Hyyrö's banded bit-vector method: bit t of a word stands for row j - threshold + t of column j, so the band slides
    along the diagonal; the distance is followed on the band's lowest row, and along the last row once that is reached.
    Strings must be at least ``threshold`` long.
    """
    k = threshold
    mask = (1 << (2 * k + 1)) - 1
    inv = lambda x: F.bitwise_not(x).bitwiseAND(F.lit(mask).cast("long"))
    num = lambda x: F.lit(x).cast("long")

    def over(s: Column) -> Column:
        x, y, m = s["x"], s["y"], F.size(s["x"])
        n = F.size(y)

        def matches(ch: Column, j: Column) -> Column:  # j from 0
            bits = num(0)
            for t in range(2 * k + 1):
                bits = bits + F.when(F.coalesce(F.get(x, j - k + t) == ch, F.lit(False)), num(1 << t)).otherwise(num(0))
            return bits

        def step(acc: Column, pm: Column) -> Column:
            vp, vn, j = acc["vp"], acc["vn"], acc["j"]
            d0 = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(num(mask))

            def rest(d: Column) -> Column:
                hp = vn.bitwiseOR(inv(d.bitwiseOR(vp)))
                hn = d.bitwiseAND(vp)
                low = F.shiftright(d, 1)
                row = m - j + k  # the last row's bit in column j
                at = F.pow(F.lit(2.0), F.greatest(row, F.lit(0))).cast("long")
                diagonal = F.when(d.bitwiseAND(num(1 << (2 * k))) == 0, 1).otherwise(0)
                flat = F.when(hp.bitwiseAND(at) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(at) != 0, 1).otherwise(0)
                return F.struct(
                    hn.bitwiseOR(inv(low.bitwiseOR(hp))).alias("vp"),
                    low.bitwiseAND(hp).alias("vn"),
                    (acc["d"] + F.when(j <= m - k, diagonal).otherwise(flat)).cast("int").alias("d"),
                    (j + 1).alias("j"),
                )

            return let(d0, rest)

        first = sum(1 << t for t in range(k, 2 * k + 1))
        start = F.struct(num(first).alias("vp"), num(0).alias("vn"), F.lit(k).alias("d"), F.lit(1).alias("j"))
        return F.when(F.abs(m - n) <= k, F.aggregate(F.transform(y, matches), start, step, lambda acc: acc["d"])).otherwise(F.lit(k + 1))

    return let(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")), over)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, t, pos, line, n, h``; ``t`` is the digest of the text, which tells rows of one or no id apart.

    Lines become normal before they are rows: a filter on such a column would compute it a second time.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(normal_lines(F.col("text"), min_chars)).alias("pos", "line"))
    return lines.withColumn("n", F.length("line")).where(F.col("n") >= min_chars).withColumn("h", F.xxhash64("line"))


def _line_table(docs: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(occurrences ``doc_id, t, pos, h``; ``h, first, times``), both written."""
    lines = shared.written(_occurrences(docs, min_chars).select("doc_id", "t", "pos", "h"), "lines")
    return lines, shared.written(lines.groupBy("h").agg(F.min(F.struct("doc_id", "pos", "t")).alias("first"), F.count("*").alias("times")), "line-firsts")


def _once(docs: DataFrame, firsts: DataFrame, min_chars: int) -> DataFrame:
    """``h, line, n`` of the occurrences that send keys: all but the later ones of lines that occur often."""
    total = firsts.agg(F.sum("times")).first()[0] or 0
    # Lines with more than 1 in 100,000 of the occurrences, so fewer than 100,000 lines.
    often = firsts.where(F.col("times") > max(8, total // 100_000)).select(F.col("h").alias("_h"), "first")
    once = _occurrences(docs, min_chars).join(F.broadcast(often), F.col("h") == F.col("_h"), "left")
    return once.where(F.col("first").isNull() | (F.struct("doc_id", "pos", "t") == F.col("first"))).select("h", "line", "n")


def _contested(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``h, key, probe, hot`` of ``rows(h, key, probe)`` whose key another line has too, one of the two as index.

    Rows of ``heavy(key)`` stay unseen: they are known to be shared and are spread by salts.
    """
    rows = rows.join(F.broadcast(heavy.select("key", F.lit(True).alias("heavy"))), "key", "left").withColumn("heavy", F.col("heavy").isNotNull())
    own = Window.partitionBy("key", F.expr(f"if(heavy, pmod(h, {SALTS}), -1)"))
    rows = rows.select("*", F.min("h").over(own).alias("lo"), F.max("h").over(own).alias("hi"), F.count(F.expr("if(probe, null, 1)")).over(own).alias("indexed"))
    return rows.where("heavy or (lo <> hi and indexed > 0)").select("h", "key", "probe", F.expr(f"heavy or indexed > {HOT_LINES}").alias("hot")).distinct()


def _heavy(rows: DataFrame) -> DataFrame:
    """``key`` of a share of rows that very many of these have; at most 10,000."""
    sampled = shared.written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n >= 16"), "sampled-keys")
    total = sampled.agg(F.sum("n")).first()[0] or 0
    return sampled.where(F.col("n") > max(64, total // 10_000)).select("key")


def _close(threshold: int) -> str:
    return f"a.h <> b.h and b.n >= a.n and b.n - a.n <= {threshold} and {_apart('a.letters', 'b.letters')} <= {2 * threshold}"


def _pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """``a, b`` of ``rows(h, key, probe, n, letters, ...)`` that share a key and may be near; a large key's index rows are dealt to several tasks."""
    rows = rows.withColumn("shares", F.expr(f"if(hot, {SALTS}, 1)"))
    index = rows.where("not probe").selectExpr("*", "pmod(h, shares) as share").alias("a")
    probes = rows.selectExpr("*", "explode(sequence(0, shares - 1)) as share").alias("b")
    both = index.join(probes, F.expr(f"a.key = b.key and a.share = b.share and {_close(threshold)} and not (a.decided and b.decided)"))
    return both.select(F.least("a.h", "b.h").alias("a"), F.greatest("a.h", "b.h").alias("b")).distinct()


def _later(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """``h`` of the later line of each of ``pairs(a, b)`` that is within ``threshold`` edits."""
    x = texts.select(F.col("h").alias("a"), F.col("line").alias("x"), F.col("first").alias("p"))
    y = texts.select(F.col("h").alias("b"), F.col("line").alias("y"), F.col("first").alias("q"))
    near = pairs.join(x, "a").join(y, "b").where(edit_distance_within(F.col("x"), F.col("y"), threshold) <= threshold)
    return near.select(F.expr("if(p < q, b, a)").alias("h")).distinct()


def _under_hot_keys(rows: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """``h`` of lines with an earlier near line, by the hot ones of ``rows(h, key, probe, hot)``; see the module's text."""
    hot = shared.written(rows.where("hot").join(texts.select("h", "n", "letters", "first"), "h"), "hot-line-keys")
    pivots = hot.where("not probe").groupBy("key", F.pmod("h", F.lit(8)).alias("s")).agg(F.min(F.struct("first", "h", "n", "letters")).alias("p"))
    pivots = pivots.select("key", "p.h", "p.n", "p.letters").alias("a")
    pivots = shared.written(pivots.selectExpr("*", f"explode(sequence(0, {SALTS - 1})) as share"), "line-pivots").alias("a")
    probes = hot.selectExpr("*", f"pmod(h, {SALTS}) as share").alias("b")
    met = probes.join(pivots, F.expr(f"a.key = b.key and a.share = b.share and {_close(threshold)}"))
    met = shared.written(met.select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct(), "line-pivot-pairs")
    decided = shared.written(_later(met, texts, threshold), "lines-by-pivot")

    keys = shared.written(hot.select("key").distinct(), "hot-keys")
    lines = texts.join(hot.select("h").distinct(), "h", "left_semi").select("h", "line", "n")
    under = _placed(lines, threshold).selectExpr("*", "xxhash64(n - delta, i, substring(line, start, size)) as key", "delta <> 0 or shift <> 0 as probe")
    under = shared.looked_up(under, keys, ["key"], "left_semi")
    # What is left of both lines is as near as the lines are, and its lengths differ by as much.
    under = under.selectExpr("h", "key", "probe", "delta as d", "concat(substring(line, 1, start - 1), substring(line, start + size, n)) as line", "n - size as n")
    again = _placed(under, threshold).where("delta = d")
    again = again.selectExpr("h", "xxhash64(key, n - delta, i, substring(line, start, size)) as key", "probe or shift <> 0 as probe")
    again = shared.written(_contested(again, _heavy(again.where(F.pmod("h", F.lit(SAMPLE)) == 0))), "line-second-keys")
    again = shared.looked_up(again.join(texts.select("h", "n", "letters"), "h"), decided.withColumn("decided", F.lit(True)), ["h"], "left").withColumn("decided", F.col("decided").isNotNull())
    pairs = shared.written(_pairs(again, threshold), "line-pairs")
    return decided.unionByName(_later(pairs, texts, threshold)).distinct()


def near_lines(docs: DataFrame, firsts: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h``: hashes of normalised lines of ``docs(doc_id, text, t)`` of which an earlier, different line is within ``threshold`` edits."""
    some = docs.where(F.pmod("t", F.lit(SAMPLE)) == 0)
    heavy = _heavy(_keys(_occurrences(some, min_chars), threshold))
    rows = shared.written(_contested(_keys(_once(docs, firsts, min_chars), threshold), heavy), "line-keys")
    wanted = rows.select("h").distinct().join(firsts.select("h", "first"), "h")
    wanted = shared.written(wanted.select("h", "first.doc_id", "first.pos", "first.t"), "line-places")
    lines = _occurrences(shared.possible(docs, wanted, ["doc_id", "t"]), min_chars).select("doc_id", "t", "pos", "line")
    texts = shared.looked_up(lines, wanted, ["doc_id", "t", "pos"], "inner").select("h", F.struct("doc_id", "pos", "t").alias("first"), "line")
    texts = texts.where(F.xxhash64("line") == F.col("h"))
    texts = shared.written(texts.dropDuplicates(["h"]).select("h", "line", "first", F.length("line").alias("n"), _letters(F.col("line")).alias("letters")), "line-texts")
    cold = rows.where("not hot").join(texts.select("h", "n", "letters"), "h").withColumn("decided", F.lit(False))
    out = _later(shared.written(_pairs(cold, threshold), "line-pairs"), texts, threshold)
    if rows.where("hot").isEmpty():
        return out
    return out.unionByName(_under_hot_keys(rows, texts, threshold)).distinct()


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, t, removed``: the numbers (from 0, ascending) of the removed lines of each id and text digest that loses any."""
    with shared.scratch(docs.sparkSession) as held:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
        occurrences, firsts = _line_table(docs, min_chars)
        near = shared.written(near_lines(docs, firsts, threshold, min_chars).withColumn("near", F.lit(True)), "near-lines")
        acts = shared.looked_up(firsts, near, ["h"], "left").where("times > 1 or near")
        acts = shared.written(acts.select("h", F.expr("if(near, null, first)").alias("stays")), "line-acts")
        hit = shared.looked_up(occurrences, acts, ["h"], "inner").where(~F.struct("doc_id", "pos", "t").eqNullSafe(F.col("stays")))
        return held.kept(hit.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("pos")).alias("removed")), "removed-lines")


def _cut(docs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """``own, text, n_lines, removed, new_text``: the rows of ``docs``, columns but the text in a struct, with the removed line numbers (null: none)."""
    gone = removed_lines(docs, threshold, min_chars)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own"), text.alias("text"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"),
    )
    stays = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("removed"), i)), "\n")
    out = shared.looked_up(rows, gone, ["doc_id", "t"], "left")
    return out.select("own", "text", "n_lines", "removed", F.when(F.col("removed").isNull(), F.col("text")).otherwise(stays).alias("new_text"))


def _own(column: str) -> Column:
    return F.col("text") if column == "text" else F.col("own").getField(column).alias(column)


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Add ``n_lines, n_removed, removed`` (line numbers joined by commas) and ``new_text`` to the rows of ``docs(doc_id, text)``.

    Lines are split at \\n and normalised (lower case, white space collapsed); shorter ones than ``min_chars`` stay, whatever
    they repeat.  The earliest occurrence stays, by doc_id (null first), then by line; of several rows of one id (or none)
    with different texts, by the text's digest.  Repeated rows count as one document and lose the same lines.  Null text stays null with no lines; an empty text is one line.  Other columns
    are passed on, but for those named as the added ones, which the added ones replace.
    """
    out = _cut(docs, threshold, min_chars)
    added = {
        "n_lines": F.col("n_lines"),
        "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long"),
        "removed": F.coalesce(F.array_join("removed", ","), F.lit("")),
        "new_text": F.col("new_text"),
    }
    return out.select(*(_own(c) for c in docs.columns if c not in added), *(x.alias(c) for c, x in added.items()))


def deduped(docs: DataFrame, depleted: int = DEPLETED_PERCENT) -> DataFrame:
    """The rows of ``docs`` with its own columns, without the removed lines; ``n_chars`` follows.

    A row goes if lines were removed and no word is left, or if more than ``depleted`` percent of its words were in them: what
    stays of a near copy is a few changed lines, no document.  Columns of any name pass unchanged; see ``line_dedup`` for
    nulls and repeated rows.
    """
    out = _cut(docs, THRESHOLD, MIN_CHARS)
    had, left = F.size(words_of(F.col("text"))), F.size(words_of(F.col("new_text")))
    out = out.where(F.col("removed").isNull() | ((left > 0) & (100 * (had - left) <= depleted * had)))
    size = F.length("new_text").cast("long")
    return out.select(*(F.col("new_text").alias("text") if c == "text" else size.alias(c) if c == "n_chars" else _own(c) for c in docs.columns))
