"""Small tables with nulls, empty and long texts, repeats and clashing columns."""

SF = "/root/testdata/sf0.001"

LONG = "alpha beta gamma delta " * 4000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (None, "no name"),
    (None, "no name"),
    (7, "naïve café ÀÉ — 日本語 \x00 é"),
    (8, "<|endoftext|> and </s>[INST] marks"),
    (9, "word"),
    (10, "two words"),
    (11, ""),
]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def clashing(df):
    """With columns that operators use inside."""
    from pyspark.sql import functions as F

    names = ("score", "fp", "key", "n", "a", "b", "v", "dk", "th", "lang_pred", "labels", "spans", "ids", "length", "shard", "_gone", "id", "_own_th", "_own_doc_id", "_sha", "_n", "_quality", "node", "root")
    return df.withColumns({c: F.lit(7) for c in names if c not in df.columns})
