"""Small documents with the cases that the operators define."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("score", "predicted", "_text", "_t", "_id", "_h", "_key", "owned", "leaks", "text_hash", "fp", "shard", "length", "_at", "f_id", "kept")


def words(rng, n):
    return " ".join(rng.choice("the of and to in data model small river stone window garden paper orange yellow system report number".split()) for _ in range(n))


def documents(spark, n=60, clashing=False, seed=3):
    """Random texts, and: a null text, an empty one, blanks alone, a null id, null columns, a long text, repeated rows."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(5, 80)), rng.choice(["en", "fr"]), f"src{i % 5}", 1) for i in range(n)]
    rows += [(n, None, "en", "src1", None), (n + 1, "", None, None, 0), (n + 2, " \n\t ", "en", "src1", 4), (None, "a row without an id", "en", "src1", 1), (n + 3, words(rng, 9000), None, "src2", 1)]
    rows += [rows[0], rows[0], (rows[1][0], "same id, other text", "en", "src1", 1), (n + 4, rows[2][1], "en", "src4", 1)]
    df = spark.createDataFrame(rows, DOC)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    return df


def empty(spark):
    return spark.createDataFrame([], DOC)


def labels(spark, n=60):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(n)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")


def save(tmp_path, spark, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"
