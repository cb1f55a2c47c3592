"""Batch builders of the lexicon tables: dictionary classes, shorter synonyms, shortest glosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import estimate_tokens

#: Frequencies (Zipf scale): a word's least, a synonym's least, and how much rarer than the word it may be. Words cheaper than this gain nothing.
WORD_ZIPF, LEAST_ZIPF, RARER, LEAST_COST = 1.5, 3.0, 1.0, 2


def word_class(tag) -> Column:
    """The class of a dictionary's word-type tag, null if it tells none."""
    t = F.trim(F.col(tag) if isinstance(tag, str) else tag)
    verb = t.startswith("v.") | t.startswith("p. p.") | t.startswith("imp.") | t.startswith("p. pr.")
    return (
        F.when(verb, "verb")
        .when(t.isin("a.", "superl."), "adj")
        .when(t.isin("adv.", "adv"), "adv")
        .when(t.isin("prep.", "conj."), "prep")
        .when((t == "n.") | t.startswith("n. pl"), "noun")
    )


def classes(dictionary: DataFrame) -> DataFrame:
    """(word, class): the first row of each word, in the order of ``line``, whose type tells a class."""
    rows = dictionary.select(F.lower(F.trim("word")).alias("word"), word_class("wordtype").alias("class"), "line").where("word <> '' and class is not null")
    return rows.groupBy("word").agg(F.min_by("class", "line").alias("class"))


def headwords(dictionary: DataFrame) -> DataFrame:
    """Distinct lower-case words of letters, four at least."""
    return dictionary.select(F.lower(F.trim("word")).alias("word")).where(F.col("word").rlike("^[a-z]{4,}$")).distinct()


def glosses(dictionary: DataFrame, cost=estimate_tokens) -> DataFrame:
    """(word, gloss): the cheapest word of the same class in a word's definition that costs less than the word.

    Ties go to the shorter, then to the alphabetically first word. Definition words meet the
    dictionary by word and class, an equi-join with a residual.
    """
    first = Window.partitionBy("word").orderBy("line")
    coarse = F.when(word_class("wordtype").isin("adv", "prep"), "rest").otherwise(word_class("wordtype"))
    tagged = dictionary.select(F.lower(F.trim("word")).alias("word"), coarse.alias("class"), F.lower("definition").alias("definition"), "line")
    tagged = tagged.where(F.col("word").rlike("^[a-z]+$") & F.col("class").isNotNull()).withColumn("n", F.row_number().over(first)).where("n = 1")
    priced = tagged.select("word", "class", "definition", cost(F.col("word")).alias("cost")).where(F.col("cost") >= LEAST_COST)
    offers = priced.select("word", "class", "cost", F.explode(F.array_distinct(F.regexp_extract_all("definition", F.lit("[a-z]+"), F.lit(0)))).alias("gloss"))
    offers = offers.where((F.length("gloss") >= 3) & (F.col("gloss") != F.col("word")))
    known = tagged.select(F.col("word").alias("gloss"), "class")
    cheap = offers.join(known, ["gloss", "class"]).withColumn("price", cost(F.col("gloss"))).where("price < cost")
    return cheap.groupBy("word").agg(F.min(F.struct("price", F.length("gloss").alias("size"), "gloss")).alias("best")).select("word", F.col("best.gloss").alias("gloss"))


def synonyms(words: DataFrame, offers: DataFrame, prices: DataFrame) -> DataFrame:
    """(word, synonym): the cheapest sufficiently frequent synonym that costs less than the word.

    ``words``: (word, pos); ``offers``: (word, pos, synonym); ``prices``: (word, zipf, cost). Among
    all parts of speech of a word one synonym wins: fewest tokens, then most frequent, shortest, first.
    """
    own = prices.select("word", F.col("zipf").alias("zw"), F.col("cost").alias("tw")).where((F.col("tw") >= LEAST_COST) & (F.col("zipf") >= WORD_ZIPF))
    other = prices.select(F.col("word").alias("synonym"), F.col("zipf").alias("zs"), F.col("cost").alias("ts"))
    pairs = words.join(offers, ["word", "pos"]).where("synonym <> word").join(own, "word").join(other, "synonym")
    fit = pairs.where((F.col("zs") >= LEAST_ZIPF) & (F.col("zs") >= F.col("zw") - RARER) & (F.col("ts") < F.col("tw")))
    key = F.struct("ts", (-F.col("zs")).alias("z"), F.length("synonym").alias("size"), "synonym")
    return fit.groupBy("word").agg(F.min(key).alias("best")).select("word", F.col("best.synonym").alias("synonym"))
