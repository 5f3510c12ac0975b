"""Small tables shared by the tests."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


def odd_texts(seed=0, n=40):
    """Empty, null, white, very long, repeated and random texts."""
    rng = random.Random(seed)
    alphabet = "abcdeABC   .,\n\t\x0b\r!?#|é漢▁<>0A'’  \x1f"
    texts = [None, "", " ", "\n", "\n\n a \n", "one", "one two three four", "x" * 3000, "a b " * 4000, " \t\r\n" * 50,
             "<|endoftext|> a<|startoftext|>b <s> </s> <0x0A>", "é ́x İ Σας ΣΑΣ", "\U0001f600 zwj‍\U0001f600"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)]
    return texts + texts[3:9]


def with_clashes(df):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ["id", "row", "th", "pos", "key", "h1", "words", "lines", "ids", "n_words", "kept", "a.b"]
    return df.select("*", *[F.lit(7).alias(n) for n in names])
