import random

LONG = " ".join(f"w{i}" for i in range(4000))


def docs(spark, rows):
    """(doc_id, text) as a documents table, with columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, count int, h string")


def labels(spark, rows):
    return spark.createDataFrame([(d, q, 0) for d, q in rows], "doc_id long, quality int, toxic int")


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    return [rng.choice(words) for _ in range(n)]


def text(seed, n):
    w = prose(seed, n)
    return "\n".join(" ".join(w[i : i + 12]) + "." for i in range(0, n, 12))


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (6, LONG), (7, LONG), (8, text(1, 300)), (9, text(1, 300)), (None, "b c d e f g")]
