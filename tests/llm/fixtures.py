"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import random

WORDS = "stone mill river wheel grain flour water dust bread oven night morning field plough seed harvest barn roof nail rope".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = prose(rng, rng.choice([1, 3, 5, 40, 120]))
        rows.append([i, t, "en", "hot" if i % 3 == 0 else f"s{i % 4}", len(t)])
    base = prose(rng, 150).split()
    for j in range(12):  # near copies: a few words differ
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 8])):
            w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 9))
        rows.append([n + j, " ".join(w), "en", "hot", 0])
    rows += [[n + 20, rows[3][1], "en", None, 0], [n + 21, rows[3][1].replace(" ", "\n  "), None, "s1", 0]]  # copies, one in other blanks
    rows += [[n + 22, None, None, None, None], [n + 23, "", "en", "s1", 0], [n + 24, " \t\n", "en", "s1", 3], [n + 25, "12 34 !?", None, "s1", 0]]
    rows += [[n + 26, "été ÀÉ ñandú über straße 漢字 \U0001f600 é ﬁ Σίσυφος", "fr", "s2", 0], [n + 27, prose(rng, 9000), "en", "hot", 0]]
    rows += [list(rows[5]), [rows[5][0], rows[7][1] + " other", "en", "s3", 0], [None, rows[9][1], "en", "s1", 0], [None, "no id here at all", "en", "s1", 0]]
    return [tuple(r) for r in rows]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # clashing names
        df = df.selectExpr("*", "1 as n_links", "'z' as bin", "2 as bucket", "3 as sig", "4 as n", "5 as node", "6 as digest", "array(1) as spans", "7 as d", "8 as turns", "9 as phases", "'q' as keep_id")
    return df.repartition(3)
