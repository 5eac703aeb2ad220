"""Names of a dictionary in free texts, and removal of those that a report's result does not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.lineage import cut

#: Where a word begins or ends.
BORDER = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])|(?<=[\p{L}\p{N}])(?![\p{L}\p{N}])"


def pieces(text: Column) -> Column:
    """Words and what stands between them, in order; together they are the text."""
    return F.split(F.coalesce(text, F.lit("")), BORDER)


def _dictionary(names: DataFrame) -> DataFrame:
    """key, l, name: the pieces of each name in lower case, from its first word to its last one, and the first two words
    (one, if there are no more) with what stands between them."""
    trimmed = F.regexp_replace("name", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    own = names.select(F.lower(trimmed).alias("name"), F.filter(F.transform(pieces(trimmed), F.lower), lambda x: x != "").alias("l")).filter("name <> ''").distinct()
    return own.withColumn("key", F.array_join(F.slice("l", 1, 3), ""))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(report, at, n, name) from texts (report, text) and names (name): names in any case that stand in a text as whole words,
    with the piece where they begin and the number of their pieces. From left to right, the longest name is taken at each
    place, and the next one begins after it.

    The first two words of names of two and more words, and the word of the others, are joined with those of the texts;
    what follows is compared then. A text's rows carry as many pieces as the longest name has.
    """
    known = cut(_dictionary(names))
    most = known.agg(F.max(F.size("l"))).first()[0] or 1
    words = texts.select("report", F.transform(pieces(F.col("text")), F.lower).alias("l")).select("report", "l", F.posexplode("l").alias("at", "w")).filter(F.col("w").rlike(r"^[\p{L}\p{N}]"))
    ahead = words.select("report", "at", F.slice("l", F.col("at") + 1, F.lit(most)).alias("ahead"))
    keyed = ahead.select("*", F.explode(F.array_distinct(F.array(F.get("ahead", F.lit(0)), F.array_join(F.slice("ahead", 1, 3), "")))).alias("key"))
    hits = keyed.join(known, "key").filter(F.slice("ahead", F.lit(1), F.size("l")) == F.col("l")).select("report", "at", F.size("l").alias("n"), "name").distinct()
    order = F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "name")))
    none = F.array().cast("array<struct<at: int, m: int, name: string>>")
    start = F.struct(F.lit(0).alias("end"), none.alias("taken"))
    take = lambda s, x: F.when(x["at"] < s["end"], s).otherwise(F.struct((x["at"] - x["m"]).alias("end"), F.array_append(s["taken"], x).alias("taken")))
    taken = hits.groupBy("report").agg(order.alias("x")).select("report", F.explode(F.aggregate("x", start, take)["taken"]).alias("x"))
    return taken.select("report", "x.at", (-F.col("x.m")).alias("n"), "x.name")


def stripped(texts: DataFrame, names: DataFrame, results: DataFrame) -> DataFrame:
    """report, text, n_mentions, ungrounded: the texts (report, text) without the names of the dictionary that the report's
    result (report, name) does not hold, and these names by place. Reports are unique; a null text stays null."""
    found = cut(mentions(texts.filter("text IS NOT NULL"), names))
    held = results.select("report", F.lower(F.regexp_replace("name", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("name")).distinct().withColumn("held", F.lit(True))
    told = found.join(held, ["report", "name"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    gone = F.array_sort(F.collect_list(F.when(~F.col("held"), F.struct("at", "n", "name"))))
    spans = told.groupBy("report").agg(F.count(F.lit(1)).alias("n_mentions"), gone.alias("gone"))
    out = texts.select("report", "text").join(spans, "report", "left").withColumns({"n_mentions": F.coalesce("n_mentions", F.lit(0)), "gone": F.coalesce("gone", F.array().cast("array<struct<at: int, n: int, name: string>>"))})
    places = F.flatten(F.transform("gone", lambda g: F.sequence(g["at"], g["at"] + g["n"] - 1)))
    kept = F.array_join(F.transform(F.filter(F.transform(pieces(F.col("text")), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("places"), s["i"])), lambda s: s["x"]), "")
    out = out.withColumn("places", places)
    return out.select("report", F.when(F.size("gone") > 0, kept).otherwise(F.col("text")).alias("text"), "n_mentions", F.col("gone.name").alias("ungrounded"))
