"""Small documents with the cases every operator has to stand: nulls, blanks, ties, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghijklmno"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))][0].split()


def corpus(seed=0, n=60):
    """Rows of documents: random texts, exact and near copies, blanks, nulls, a long one."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = rng.random()
        texts = [r[1] for r in rows if (r[1] or "").split()]
        if kind < 0.5 or not texts:
            text = " ".join(words(rng, rng.choice([1, 3, 4, 5, 6, 30, 80])))
        elif kind < 0.65:
            text = rng.choice(texts).replace(" ", rng.choice([" ", "  ", "\n"]))
        elif kind < 0.9:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "ZZ"])
            text = " ".join(w)
        else:
            text = rng.choice([None, "", " \t\n", "é ü 　 ß", "A b c d"])
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None))
    rows.append((n, " ".join(words(rng, 6000)), "en", "s0", 1))
    rows.append(rows[3])
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """df with columns that differ from its own, or from what operators make, by case alone."""
    from pyspark.sql import functions as F

    extra = ["DOC_ID", "Text", "n", "h", "host", "a", "b", "p", "q", "digest", "rows", "shard", "base", "bytes", "line", "spans", "id"]
    keep = [c for c in extra if c not in df.columns]
    return df.select("*", *[F.lit(1).alias(c) for c in keep])
