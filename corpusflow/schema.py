"""Row types of the package."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
#: One search result: the chunk that was hit and its score, ranked from 1 per request.
HITS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("relevance", T.DoubleType()),
    ]
)
TRAIN_RECORD = T.StructType(
    [
        T.StructField("Query", T.StringType()),
        T.StructField("Candidate", T.StringType()),
        T.StructField("Label", T.DoubleType()),
    ]
)


def require(df, **columns: str) -> None:
    """Raise unless ``df`` has these columns with these type names."""
    have = dict(df.dtypes)
    for name, kind in columns.items():
        if have.get(name) != kind:
            raise TypeError(f"column {name!r} must be {kind}, got {have.get(name)}")
