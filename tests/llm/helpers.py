"""Small tables with the awkward cases, and plain Python versions."""

import random

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return (text.translate(LOWER) if lower else text).encode().split()


def awkward_rows(seed=3):
    """(doc_id, text, lang, source, n_chars) with nulls in every column, empty
    and blank texts, copies, near copies, shared passages, repeated rows, odd
    white space and one long text."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["Ünï", "漢字", "it's", "THE", "the", "a"]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = draw(60)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "", 0),
        (3, " \t\n\x0b\x0c\r ", None, "src1", 7),
        (4, "one", "en", "src1", 3),
        (5, "one", "en", None, 3),
        (6, "one two", "en", "src1", 7),
        (None, "null id text " + " ".join(draw(40)), "en", "src2", 1),
        (7, "x" * 5000, "en", "src2", 5000),
    ]
    for i in range(10, 30):
        rows.append((i, " ".join(draw(rng.randrange(5, 120))), rng.choice(["en", "de", None]), "src%d" % (i % 3), 1))
    for i in range(30, 40):
        a, b = draw(rng.randrange(0, 40)), draw(rng.randrange(0, 40))
        rows.append((i, "  ".join(a + passage + b), "en", "hot", 1))
    base = draw(200)
    for i in range(40, 60):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((i, "\n".join(w), "en", "hot", 1))
    rows += [(60 + i, " ".join(base), "en", "hot", 1) for i in range(5)]
    rows += [rows[10], rows[10], rows[25]]  # repeated rows
    rows.append((70, " ".join(draw(30) * 4), "en", "src1", 1))  # repeats itself
    rows.append((71, " ".join(draw(4000)), "en", "src1", 1))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, extra=False):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    if extra:  # names that operators use inside
        for c in ("k", "t", "d", "n", "h", "at", "row", "key", "copy", "first", "ids", "part", "bin", "rank", "x", "train", "rows", "declared", "host"):
            df = df.withColumn(c, df.n_chars)
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
