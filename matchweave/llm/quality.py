"""Quality rules: line-first cleaning, in DataFrame functions only.

Every line with a word is judged by itself: *boilerplate* (stock phrases),
*navigation* (menus and tables of short cells), *punctuation* (symbols instead
of prose, shouting, short scraps without an end mark).  Lines that fail are removed,
and a document that loses too much of its text is rejected.

Before that, a base check on the whole text: too few words, or too many words
inside repeated five-word windows.  Windows are compared by 64-bit hashes of
their words within one document; two different windows of a document of n words
have equal hashes with a probability below n**2 / 2**65.

A null text has no words: it fails the base check, all counts are 0.  Repeated rows and null ids are judged row by row.  An empty table
gives an empty result, texts and lines of any length are judged whole in the memory of one row, and columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.llm.shared import let

SPACES = " \t\n\x0b\f\r"
#: Stock phrases of pages, in lower case, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "we use cookies", "uses cookies", "enable javascript", "skip to content",
    "subscribe to our newsletter", "sign up for our newsletter", "click here to", "share on facebook", "share on twitter", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "wir verwenden cookies", "zum inhalt springen", "tous droits réservés", "politique de confidentialité",
    "nous utilisons des cookies", "aller au contenu", "todos los derechos reservados", "política de privacidad", "utilizamos cookies", "saltar al contenido",
)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+``; none for null."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) > 0, F.split(inner, r"[ \t\n\x0B\f\r]+", -1)).otherwise(F.array().cast("array<string>"))


def repeated_words(tokens: Column, n: int = 5) -> Column:
    """Words inside n-word windows that the document holds twice or more, the first included; linear unless there is such a window, then one sort."""

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(places, i + 1) - p, F.lit(n))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(let(ordered, twice), lambda x: x["p"]))

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(places(windows), covered))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(n))))

    return F.when(F.size(tokens) > n, let(let(F.transform(tokens, lambda w: F.xxhash64(w)), windows), count)).otherwise(F.lit(0).cast("long"))


def line_passes(line: Column, symbols: float = 0.1, shouting: float = 0.34, scrap: int = 4) -> Column:
    """Whether a line with a word passes the three rules."""
    text = F.btrim(line, F.lit(SPACES))
    n_words = F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))
    cells = F.regexp_count(text, F.lit(r"[|»›·•]| > "))
    marks = F.regexp_count(text, F.lit(r"[#*$%&|<>{}\\^~=]"))
    cries = F.regexp_count(text, F.lit(r"[!?]{2,}"))
    boilerplate = F.lower(text).rlike("|".join(BOILERPLATE))
    navigation = (cells >= 2) & (n_words <= 5 * (cells + 1))
    odd_marks = (marks > symbols * F.length(text)) | (cries > F.greatest(F.lit(1), shouting * n_words))
    scraps = (n_words < scrap) & ~text.rlike(r"[.!?…。！？।؟:;][\"'”“’‘»«)\]]*$")
    return ~(boilerplate | navigation | odd_marks | scraps)


def judge(docs: DataFrame, most_lost: float = 0.5, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_failed.

    ``kept`` is false if the base check fails or if the failed lines hold more than
    ``most_lost`` of the characters of all lines with a word.  ``with_text`` adds ``clean_text``: the
    lines that pass (and those without a word) in order; null for a null text.  ``keep`` names columns to hand on.
    """
    source = F.col(text)
    counted = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def by_line(flagged: Column) -> Column:
        pick = lambda test: F.transform(F.filter(flagged, test), lambda x: x["line"])
        chars = lambda test: F.aggregate(flagged, F.lit(0).cast("long"), lambda a, x: a + F.when(test(x), F.length(x["line"])).otherwise(0))
        count = lambda test: F.size(F.filter(flagged, test))
        word, good, bad = (lambda x: x["word"]), (lambda x: x["word"] & x["good"]), (lambda x: x["word"] & ~x["good"])
        fields = [(count(word) - F.size(F.array_distinct(pick(word)))).cast("long").alias("n_dup_lines"), count(word).alias("n_lines"), count(bad).alias("n_lines_failed"), chars(word).alias("chars"), chars(good).alias("good_chars")]
        if with_text:
            fields.append(F.array_join(pick(lambda x: ~x["word"] | x["good"]), "\n").alias("clean_text"))
        return F.struct(*fields)

    def flags(line: Column) -> Column:
        word = F.length(F.btrim(line, F.lit(SPACES))) > 0
        return F.struct(line.alias("line"), word.alias("word"), F.when(word, line_passes(line)).otherwise(False).alias("good"))

    lines = F.transform(F.split(F.coalesce(source, F.lit("")), "\n", -1), flags)
    columns = [F.col(doc_id).alias("doc_id"), let(words(source), counted).alias("w"), let(lines, by_line).alias("l"), F.coalesce(F.length(F.regexp_replace(source, r"[^#*$%&|<>]+", "")), F.lit(0)).cast("long").alias("n_symbols")]
    if with_text:
        columns.append(source.isNull().alias("no_text"))
    found = docs.select(*columns, *keep)
    failed = (F.col("w.n_words") < 10) | (100 * F.col("w.n_repeat_words") > 20 * F.col("w.n_words"))
    enough = F.col("l.chars") - F.col("l.good_chars") <= most_lost * F.col("l.chars")
    out = found.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), (~failed & enough).alias("kept"), "l.n_lines", "l.n_lines_failed", *[F.when(~F.col("no_text"), F.col("l.clean_text")).alias("clean_text")] * with_text, *keep)
    return out.withColumnRenamed("doc_id", doc_id)
