"""Small tables with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, changes):
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def texts():
    base = prose(1, 120)
    passage = prose(2, 140)
    out = [base, base, base.upper(), *[edited(base, s, k) for s, k in ((3, 1), (4, 2), (5, 3), (6, 6), (7, 20))]]
    out += [f"{prose(20 + i, 90)} {passage} {prose(40 + i, 70)}" for i in range(5)]
    out += [None, None, "", "", " ", "\n\n", "one", "one", "One two three", "one two three four five", "... !!! 123", "é" * 500, "a" * 1500, "ab" * 700]
    out += [prose(60, 30000), edited(prose(60, 30000), 61, 40), "\n".join([prose(70, 12), prose(71, 12), prose(70, 12), edited(prose(72, 40), 1, 1), prose(72, 40)]), prose(70, 12), "漢字 かな 😀 \x00 \t x", "mit license, MIT  License; the Apache-License 2.0 and GNU General Public License v3"]
    return out


def rows():
    return [(i, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts())]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def odd(spark):
    """Null ids, repeated rows, and columns whose names an operator might use itself."""
    data = [(None, "same text of some words here", "en"), (None, None, None), (7, "same text of some words here", None), (7, "same text of some words here", None), (8, None, "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("sig", "doc", "pos", "line", "token", "key", "h", "d", "spans", "rank", "size")})
