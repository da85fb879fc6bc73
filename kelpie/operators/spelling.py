"""Corrections of typed words by the words of a catalogue, without a service.

Words that lie one edit apart (a letter more, less, another, or two swapped) share a word with one letter deleted from
each, so candidates meet in an equi-join on deletions (symmetric deletes), never all pairs. Accents are deleted first:
words that differ in accents only meet whole. Of the candidates the least weighted distance wins, then the frequent word.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a wrong accent costs against a wrong letter; the least letters of a word in which letters are corrected.
ACCENT, SHORT = 0.1, 4
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x1F00) if unicodedata.normalize("NFD", chr(c))[0] < "\x80"} | {"đ": "d", "Đ": "D"}
WORD = r"[\p{L}\p{N}]"


def plain(c: Column) -> Column:
    """Letters without their accents."""
    return F.translate(c, "".join(_MARKED), "".join(_MARKED.values()))


def deletions(c: Column) -> Column:
    """A word and all that are left of it without one letter."""
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), less))


def edits(a: Column, b: Column) -> Column:
    """Edits between two words, where a swap of neighbours is one; exact up to one edit, else at least two."""
    apart = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    at = F.try_element_at(apart, F.lit(1))
    swapped = (F.length(a) == F.length(b)) & (F.size(apart) == 2) & (F.try_element_at(apart, F.lit(2)) == at + 1) & (F.substring(a, at, F.lit(2)) == F.reverse(F.substring(b, at, F.lit(2))))
    return F.when(F.coalesce(swapped, F.lit(False)), 1).otherwise(F.levenshtein(a, b))


def corrections(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows (word, correction, cost) for those words (word) that a lexicon (word, freq) lacks but has one nearby.

    Words and lexicon are in lower case; a word that comes twice counts once, null and empty ones don't.
    """
    known = lexicon.where("word <> ''").groupBy("word").agg(F.sum("freq").alias("freq"))
    asked = words.where("word <> ''").select("word").distinct().join(known, "word", "left_anti")
    index = known.select(F.col("word").alias("candidate"), "freq", F.explode(deletions(plain(F.col("word")))).alias("part"))
    pairs = asked.select("word", F.explode(deletions(plain(F.col("word")))).alias("part")).join(index, "part").select("word", "candidate", "freq").distinct()
    a, b = plain(F.col("word")), plain(F.col("candidate"))
    near = pairs.withColumn("edits", edits(a, b)).where((F.col("edits") == 0) | (F.col("edits") == 1) & (F.length("word") >= SHORT))
    cost = F.col("edits") + ACCENT * F.greatest(F.levenshtein("word", "candidate") - F.levenshtein(a, b), F.lit(0))
    return near.withColumn("cost", cost).groupBy("word").agg(F.min_by("candidate", F.struct("cost", -F.col("freq"), "candidate")).alias("correction"), F.min("cost").alias("cost"))


def corrected(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """queries (query_id, query) with unknown words replaced by their corrections; all else in a query stays as it is."""
    parts = F.split("query", f"(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD})", -1)
    rows = queries.select("query_id", parts.alias("parts"))
    words = rows.select("query_id", F.explode("parts").alias("part")).select("query_id", F.lower("part").alias("word")).where(F.col("word").rlike(f"^{WORD}+$"))
    found = words.join(corrections(words.where(F.col("word").rlike(r"\p{L}")), lexicon), "word").groupBy("query_id").agg(F.collect_set(F.struct("word", "correction")).alias("set"))
    own = rows.join(found, "query_id", "left").withColumn("map", F.map_from_entries(F.coalesce("set", F.array().cast("array<struct<word:string,correction:string>>"))))
    text = F.array_join(F.transform("parts", lambda p: F.coalesce(F.try_element_at("map", F.lower(p)), p)), "")
    return queries.drop("query").join(own.select("query_id", text.alias("query")), "query_id")


def catalogue_words(texts: DataFrame) -> DataFrame:
    """A lexicon (word, freq) of texts (text)."""
    words = texts.select(F.explode(F.split(F.lower("text"), rf"[^\p{{L}}\p{{N}}]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("freq"))
