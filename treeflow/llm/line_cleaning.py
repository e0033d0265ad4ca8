"""Line-first cleaning with DataFrame functions alone.

Lines are judged before documents: a line fails for its punctuation, as navigation or as boilerplate; failing lines are
removed, and the document is rejected if too little of it is left. One map over rows, no shuffle, no Python.

Line rules (a line has at least one word; its characters are counted without the white space around it):

* punctuation: more than 1/10 of its characters are symbols; or runs of ``!!``/``??`` after at least a third of its
  words; or under 5 words and no closing mark at its end, in a line of under 200 characters (longer ones of few words, such
  as base64 or long addresses, pass this rule and their characters count as kept);
* navigation: at least 2 separators, and at most 4 words a separated item on average;
* boilerplate: equal to an earlier line; or at most 12 words with one of ``PHRASES``.

The document is kept if its base rules pass and at least ``KEEP`` of its line characters survive.

Defined results: null and empty texts have all counts 0 and fail the base rule (under 20 words); repeated rows give
repeated results; an empty table gives no rows; a text of one long line is one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP = 0.5

# White space between words, symbols, separators, closing marks, phrases of page furniture.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
SYMBOL_RE = r"[#*$%&|<>]"
SEPARATOR_RE = r"[|»›·•]"
CLOSING_RE = r"""[.!?…:;,][\x22'”’»)\]]*$"""
SHOUT_RE = r"(!!|\?\?)"
PHRASES = "all rights reserved|privacy policy|terms of (use|service)|cookie|click here|read more|sign (in|up)|log ?in|subscribe|newsletter|enable javascript|powered by|share (on|this)|follow us|back to top|copyright ©|©"


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda variable can't be inlined and so computed again per element."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more, first occurrences included."""

    def covered(h: Column) -> Column:
        def starts(s: Column) -> Column:
            again = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        places = _bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), starts)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(places, first, step, lambda a: a["n"]))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, _bind(hashes, covered)).otherwise(F.lit(0))


def _word_count(line: Column) -> Column:
    return F.size(F.split(line, SPACE_RE))


def line_fails(line: Column) -> Column:
    """``line``: without white space around it. Cheap tests come first."""
    n = F.char_length(line)
    symbols = n - F.char_length(F.regexp_replace(line, SYMBOL_RE, ""))
    shouts = F.size(F.split(line, SHOUT_RE)) - 1
    separators = n - F.char_length(F.regexp_replace(line, SEPARATOR_RE, ""))
    return (
        (symbols * 10 > n)
        | (line.rlike(SHOUT_RE) & (shouts * 3 >= _word_count(line)))
        | ((n < 200) & ~line.rlike(CLOSING_RE) & (_word_count(line) < 5))
        | ((separators >= 2) & (_word_count(line) <= 4 * (separators + 1) + separators))
        | (line.rlike(f"(?i)({PHRASES})") & (_word_count(line) <= 12))
    )


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the counts, the verdicts, and ``clean_text``, its surviving lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def lines(every: Column) -> Column:
        def judged(unique: Column) -> Column:
            bare = F.transform(unique, lambda x: F.btrim(x, F.lit(SPACES)))
            return F.struct(
                (F.size(every) - F.size(unique)).cast("long").alias("n_dup_lines"),
                F.size(every).cast("long").alias("n_lines"),
                F.char_length(F.array_join(F.transform(every, lambda x: F.btrim(x, F.lit(SPACES))), "")).cast("long").alias("line_chars"),
                _bind(F.filter(bare, lambda x: ~line_fails(x)), lambda good: F.struct(F.size(good).cast("long").alias("n"), F.array_join(good, "\n").alias("text"))).alias("good"),
            )

        return _bind(F.array_distinct(every), judged)

    with_word = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        _bind(words_of(text), counts).alias("w"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOL_RE, ""))).cast("long").alias("n_symbols"),
        _bind(with_word, lines).alias("l"),
    )
    kept_chars = (F.char_length("l.good.text") - F.greatest(F.col("l.good.n") - 1, F.lit(0))).cast("long")
    failed = (F.col("w.n_words") < MIN_WORDS) | (F.col("w.n_repeat_words") * 100 > F.col("w.n_words") * MAX_REPEAT_PERCENT)
    return out.select(
        "doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (kept_chars >= F.col("l.line_chars") * KEEP)).alias("kept"),
        (F.col("l.n_lines") - F.col("l.good.n")).alias("n_lines_removed"),
        kept_chars.alias("kept_chars"),
        F.col("l.good.text").alias("clean_text"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    ws, trim = r"[\x20\x09-\x0D]+", "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    n_words = "len(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'))"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS s FROM documents),
w AS (SELECT k, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM g) WHERE c > 1),
v AS (SELECT k, sum(least(8, d)) AS n FROM (SELECT k, i - lag(i, 1, -100) OVER (PARTITION BY k ORDER BY i) AS d FROM r) GROUP BY k),
l AS (SELECT k, j, {trim.format('raw')} AS x, raw, row_number() OVER (PARTITION BY k, raw ORDER BY j) AS nth
      FROM (SELECT k, unnest(string_split(s, chr(10))) AS raw, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM t)
      WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
f AS (SELECT *, len(x) AS n, {n_words} AS nw,
             len(x) - len(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS sym,
             len(x) - len(regexp_replace(x, '[|»›·•]', '', 'g')) AS sep,
             len(regexp_extract_all(x, '!!|\?\?')) AS shouts FROM l),
q AS (SELECT k, x, nth, nth > 1 OR sym * 10 > n OR (shouts > 0 AND shouts * 3 >= nw)
             OR (n < 200 AND NOT regexp_matches(x, '[.!?…:;,]["''”’»)\]]*$') AND nw < 5)
             OR (sep >= 2 AND nw <= 4 * (sep + 1) + sep)
             OR (regexp_matches(x, '(?i)({PHRASES})') AND nw <= 12) AS bad, n FROM f),
a AS (SELECT k, count(*) FILTER (nth > 1) AS dup, sum(n) AS chars, coalesce(sum(n) FILTER (NOT bad), 0) AS good, count(*) FILTER (bad) AS removed FROM q GROUP BY k),
b AS (SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(s) - len(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(chars, 0) AS chars, CAST(coalesce(good, 0) AS BIGINT) AS kept_chars, CAST(coalesce(removed, 0) AS BIGINT) AS n_lines_removed
      FROM t JOIN w USING (k) LEFT JOIN v USING (k) LEFT JOIN a USING (k)),
c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_chars >= chars * 0.5 AS kept, n_lines_removed, kept_chars FROM c
"""
