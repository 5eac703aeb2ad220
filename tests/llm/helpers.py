"""Documents with the cases that every operator has to take."""

DOCS = "doc_id long, text string, lang string, kept string, n_tokens int"

CASES = [
    (1, "Plain words, it's 42 of them.\nSecond line", "en", "x", 1),
    (2, None, "en", None, None),
    (3, "", None, None, None),
    (4, "tabs\tand  double  blanks \n\n end ", "en", "x", 1),
    (5, "Ångström naïve ﬁligree İstanbul 日本語 é   \x1c ½", "fr", "x", 1),
    (6, "special <|endoftext|> inside<|startoftext|>x", "en", "x", 1),
    (7, "same text", "en", "x", 1),
    (8, "same text", "en", "x", 1),
    (8, "same text", "en", "x", 1),
    (None, "same  text", None, "x", 1),
    (9, "long " + "wörd number " * 30_000, "de", "x", 1),
    (10, "x" * 50_000, "en", "x", 1),
]


def cases(spark):
    return spark.createDataFrame(CASES, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
