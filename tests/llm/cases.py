"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with those the operators use."""

import random

WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ab", "eno", "ira", "olu", "unte")]
CLASHING = "n_words long, key string, size int, hash string, label string, vid long, shard int, score double"
SCHEMA = f"doc_id long, text string, {CLASHING}"


def prose(seed, words, lines=1):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(max(1, words // lines))) for _ in range(lines))


def with_clashes(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, "h", "l", 3, 4, 0.5) for i, t in rows], SCHEMA).repartition(3)


def odd_rows():
    long = prose(1, 6000, 300)
    base = prose(2, 300, 12)
    near = base.replace(base.split()[40], "changed", 1)
    shared = prose(3, 120, 6)
    return [
        (1, base),
        (2, near),
        (3, base),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, long),
        (9, prose(4, 90, 5) + "\n" + shared + "\n" + prose(5, 60, 4)),
        (10, prose(6, 70, 5) + "\n" + shared + "\n" + prose(7, 80, 3)),
        (11, "ab " * 400),
        (11, "ab " * 400),
        (12, "One TWO"),
        (13, "ñandú über ǅ 日本語 x#$% !!! http://x"),
        (None, prose(8, 100, 2)),
        (None, base),
        (14, long[: len(long) // 2]),
    ]


def odd(spark):
    return with_clashes(spark, odd_rows())


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Ids that a double cannot hold, beside a null id.
LARGE = [(1 << 60) + 1, (1 << 60) + 3, None]
