"""Documents with the awkward cases, and brute-force versions."""

import random

WORDS = "the of and tion er ing onenerth theable lesser stanend würde éclair naïve x y zz 12 3.5 don't we'll HTML".split()


def text_of(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", ". ", ", "]) for _ in range(n))


def rows(seed=1, n=40):
    """(doc_id, text): random ones, then nulls, empties, ties, repeats and a long one."""
    rng = random.Random(seed)
    out = [(i, text_of(rng, rng.randint(1, 200))) for i in range(n)]
    out += [(100, None), (101, ""), (102, "   \n\t"), (103, "one two three"), (104, "one two three"), (104, "one two three")]
    out += [(None, "no id here but words"), (105, "a" * 4000), (106, "<|endoftext|> inside <|startoftext|> it's"), (107, "日本語 текст 𝔘 é̀ ½")]
    out += [(108, text_of(rng, 9000))]
    return out


def frame(spark, data, extra=True):
    """With further columns, whose names the operators use themselves."""
    df = spark.createDataFrame(data, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "spans", "key", "_id", "_text", "ids", "n_words", "bucket", "start"):
            df = df.withColumn(name, F.lit("other"))
    return df.withColumn("source", df["doc_id"].cast("string").substr(1, 1))


def collect(df):
    return [r.asDict(recursive=True) for r in df.collect()]
