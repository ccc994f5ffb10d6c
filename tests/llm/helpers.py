import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(seed, n, size=6):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, size))) for _ in range(n)]


def prose(seed, n):
    return " ".join(words(seed, n))


def odd_texts():
    """Nulls, empty, repeated, long, spaces of many kinds, letters of many kinds."""
    long = prose(99, 4000)
    return [
        (5, None), (7, ""), (None, "no id at all"), (3, "same text here"), (3, "same text here"), (9, "same text here"), (None, None), (1, long), (2, long + " tail"),
        (4, "Ünïcödé ĶELVİN K ΣΑΣ é 日本語 \x85\xa0 x\n\n y\t\tz  <|endoftext|> it's 12²½"), (6, "\n\n  \n"), (8, "#$%&*|<> \x00\x1c\x1f"), (10, "a"),
    ]
