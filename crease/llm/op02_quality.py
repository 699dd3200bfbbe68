"""Line-first cleaning of documents, then rejection of documents that lose too much.

A line with a word is removed if no sentence ends in it, if it has many symbols for its length, is a row of
navigation links, or is a short line of boilerplate, whose phrases are whole words. Lines without a word stay. A document is
rejected if base rules fail (few words, many repeated three-word windows) or if the lines removed hold
more than ``most_lost`` percent of the characters of its lines. Boilerplate phrases are those of four languages; a line in another
language is judged by the other rules alone.

Defined results: a null text is an empty one (no words, rejected); rows are judged one by one, so
repeated rows get equal results and an empty table gives none; further columns stay. Windows of three words
are compared by a 64-bit hash of the three words within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPLIT, free_name, let, table

SYMBOLS, BARS = "#*$%&|<>", "|»›·•"
#: A word that may end a sentence or clause.
LATIN_END = r"""[.!?…:;"”'’)\]»]([\x20\x09-\x0D]|\z)"""
#: The same with the ends of other scripts; Chinese and Japanese have no space after them.
SENTENCE_END = LATIN_END.replace("»]", "»।॥۔؟؛։።፧፨」』）：；]") + "|[。．！？｡]"
#: Fixed value: boilerplate phrases in English, German, French and Spanish; other languages have none.
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
               "uses cookies", "enable javascript", "click here", "sign up", "log in", "read more", "share this",
               "alle rechte vorbehalten", "verwendet cookies", "hier klicken", "jetzt anmelden", "mehr lesen",
               "tous droits réservés", "politique de confidentialité", "utilise des cookies", "cliquez ici", "lire la suite",
               "todos los derechos reservados", "política de privacidad", "utiliza cookies", "haga clic aquí", "leer más")
PHRASES = rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(BOILERPLATE)})([^\p{{L}}\p{{N}}_]|\z)"
MOST_SYMBOLS, LEAST_BARS, BOILERPLATE_WORDS, MOST_LOST, LEAST_WORDS, MOST_REPEATED = 5, 3, 30, 30, 50, 50


def _count(line: Column, chars: str) -> Column:
    return F.length(line) - F.length(F.translate(line, chars, ""))


def _line(line: Column) -> Column:
    def judged(words: Column) -> Column:
        symbols = _count(line, SYMBOLS)
        low = F.lower(line)
        phrase = F.rlike(low, F.lit(PHRASES))
        fails = (F.size(words) > 0) & (
            ~F.rlike(line, F.lit(SENTENCE_END)) | (symbols * 100 > F.length(line) * MOST_SYMBOLS)
            | (_count(line, BARS) >= LEAST_BARS) | ((F.size(words) <= BOILERPLATE_WORDS) & phrase))
        return F.struct(line.alias("line"), words.alias("words"), symbols.alias("symbols"), fails.alias("fails"))
    return let(F.filter(F.split(line, SPLIT), lambda w: w != ""), judged)


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, r: acc + value(r).cast("long"))


def repeated_words(words: Column) -> Column:
    """Number of words in three-word windows that occur twice or more in ``words``."""
    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))

    def among(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                             lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), among)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(windows(words))


def judge(text: Column, most_lost: int = MOST_LOST) -> Column:
    """Struct of the counts, ``base_failed``, ``kept`` and the cleaned text."""
    def summed(rows: Column) -> Column:
        texts = F.transform(F.filter(rows, lambda r: F.size(r["words"]) > 0), lambda r: r["line"])
        return F.struct(
            _total(rows, lambda r: F.size(r["words"])).alias("n_words"),
            _total(rows, lambda r: F.length(F.array_join(r["words"], ""))).alias("word_chars"),
            _total(rows, lambda r: r["symbols"]).alias("n_symbols"),
            let(texts, lambda t: F.size(t) - F.size(F.array_distinct(t))).cast("long").alias("n_dup_lines"),
            let(F.flatten(F.transform(rows, lambda r: r["words"])), repeated_words).alias("n_repeat_words"),
            _total(rows, lambda r: F.length(r["line"])).alias("all_chars"),
            _total(rows, lambda r: F.when(r["fails"], F.length(r["line"])).otherwise(0)).alias("lost_chars"),
            F.array_join(F.transform(F.filter(rows, lambda r: ~r["fails"]), lambda r: r["line"]), "\n").alias("text"))

    def ruled(s: Column) -> Column:
        base = (s["n_words"] < LEAST_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MOST_REPEATED)
        kept = ~base & (s["lost_chars"] * 100 <= s["all_chars"] * most_lost)
        return F.struct(*[s[c].alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "all_chars", "lost_chars", "text")],
            base.alias("base_failed"), kept.alias("kept"))

    rows = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _line)
    return let(let(rows, summed), ruled)


def clean(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """The documents kept, with the failing lines removed from ``text``."""
    j = free_name(docs, "_judged")
    # Exploded rather than filtered: a filter would be pushed below the projection and every text judged twice.
    judged = docs.select("*", F.explode(F.filter(F.array(judge(F.col(text), **params)), lambda x: x["kept"])).alias(j))
    return judged.withColumn(text, F.col(f"{j}.text")).drop(j)


def op2_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with the characters that line rules removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", judge(F.col("text")).alias("j"))
    return docs.select("doc_id", *[F.col(f"j.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")])


_WORDS = r"[w for w in string_split_regex(line, '[\x20\x09-\x0D]+') if w <> '']"
_SQL_END = SENTENCE_END.replace("'", "''")
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT r, generate_subscripts(s, 1) AS k, unnest(s) AS line FROM (SELECT r, string_split(text, chr(10)) AS s FROM d)),
l AS (SELECT r, k, line, {_WORDS} AS words,
             length(line) - length(translate(line, '{SYMBOLS}', '')) AS symbols,
             length(line) - length(translate(line, '{BARS}', '')) AS bars FROM a),
v AS (SELECT *, len(words) > 0 AND (NOT regexp_matches(line, '{_SQL_END}') OR symbols * 100 > length(line) * {MOST_SYMBOLS}
             OR bars >= {LEAST_BARS} OR (len(words) <= {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{PHRASES}'))) AS fails
      FROM l),
c AS (SELECT r, sum(len(words))::BIGINT AS n_words, sum(length(array_to_string(words, '')))::BIGINT AS word_chars,
             sum(symbols)::BIGINT AS n_symbols,
             (count(*) FILTER (len(words) > 0) - count(DISTINCT line) FILTER (len(words) > 0))::BIGINT AS n_dup_lines,
             sum(length(line))::BIGINT AS all_chars,
             coalesce(sum(length(line)) FILTER (fails), 0)::BIGINT AS lost_chars FROM v GROUP BY r),
w AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k, j) AS i, word
      FROM (SELECT r, k, generate_subscripts(words, 1) AS j, unnest(words) AS word FROM l)),
g AS (SELECT r, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT r, count(DISTINCT i)::BIGINT AS n_repeat_words
      FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM t WHERE n > 1) GROUP BY r),
f AS (SELECT d.doc_id, c.*, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d JOIN c USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_chars * 100 <= all_chars * {MOST_LOST} AS kept, lost_chars
FROM b
"""
