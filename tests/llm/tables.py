"""Small tables with everything that is awkward in them."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id int, fp string, shard string, _tie int, host string"
EXTRA = ("r", 1, "f", "s", 2, "h")


def docs(spark, rows):
    """Documents from (doc_id, text, source), with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in rows], DOCS)


def awkward(spark):
    return docs(
        spark,
        [
            (1, None, "a"), (2, "", "a"), (None, "no id here at all", None), (3, "x", None), (4, "same words again", "b"),
            (4, "same words again", "b"), (5, "é ü\tß\nline two\n\n", "b"), (6, "long " * 20_000, "a"), (7, "y" * 50_000, "a"),
            (8, "Same words again", "c"), (9, " \n\t ", "c"),
        ],
    )


def empty(spark):
    return docs(spark, [])


def prose(seed, n, vocabulary=4_000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]
