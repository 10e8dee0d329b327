"""Training examples: parsing, labels, and model-ready token features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators.scale import each, salted_join, small_enough, with_position
from corpusflow.session import materialize

# Feature length and segment id of padding (0, or 4 for the xlnet variant).
MAX_LENGTH = 256
PAD_SEGMENT = {"default": 0, "xlnet": 4}
#: Token ids kept for padding, unknown tokens, and the marks around the texts of a pair.
PAD, UNKNOWN, START, SEPARATOR = 0, 1, 2, 3
SPECIALS = 4


def parse_train_records(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split JSON training records into typed pairs and rejects.

    A label may be a JSON number or a numeric string.  Rejected: broken JSON, a missing query or
    candidate, a label that is not a number.
    """
    raw = "Query string, Candidate string, Label string"
    parsed = df.withColumn("_r", F.from_json(value, raw)).withColumns(
        {"query": F.col("_r.Query"), "candidate": F.col("_r.Candidate"), "label": F.expr("try_cast(_r.Label AS double)")}
    )
    good = F.col("query").isNotNull() & F.col("candidate").isNotNull() & F.col("label").isNotNull()
    keep = [c for c in df.columns if c != value]
    pairs = parsed.filter(good).select(*keep, "query", "candidate", "label")
    return pairs, parsed.filter(~good).select(*df.columns)


def examples(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """First column is text_a, last the label; with exactly three columns the second is text_b."""
    text_b = F.col(columns[1]) if len(columns) == 3 else F.lit(None)
    return df.select(
        *keep,
        F.col(columns[0]).alias("text_a"),
        text_b.cast("string").alias("text_b"),
        F.col(columns[-1]).cast("string").alias("label"),
    )


def index_labels(df: DataFrame, labels: Sequence[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Add ``label_index``; rows whose label is not listed go to the second frame."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    indexed = df.withColumn("label_index", (F.nullif(position, F.lit(0)) - 1).cast("int"))
    return indexed.filter("label_index is not null"), indexed.filter("label_index is null").drop("label_index")


def numeric_labels(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Regression labels: add ``target``; rows whose label is not a number go to the second frame."""
    typed = df.withColumn("target", F.expr(f"try_cast({label} AS double)"))
    return typed.filter("target is not null"), typed.filter("target is null").drop("target")


def vocabulary(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """(term, term_id): all distinct tokens in byte order, numbered after the special ids."""
    words = [each(df, X.tokens(F.col(t)), "term", []) for t in texts]
    terms = words[0]
    for other in words[1:]:
        terms = terms.unionByName(other)
    return with_position(terms.distinct(), ["term"], "term_id", SPECIALS)


def pair_tokens(df: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Add ``_a`` and ``_b``: token lists that fit ``[start] a [sep] b [sep]`` (or ``[start] a [sep]``).

    The first text is shortened first, the second only when nothing of the first is left.
    """
    has_b = F.col("text_b").isNotNull()
    room = F.when(has_b, max_length - 3).otherwise(max_length - 2)
    b_all = F.coalesce(X.tokens(F.col("text_b")), F.array().cast("array<string>"))
    tokens = df.withColumns({"_a": X.tokens(F.col("text_a")), "_b": b_all})
    tokens = tokens.withColumn("_b", F.slice("_b", F.lit(1), room))
    return tokens.withColumn("_a", F.slice("_a", F.lit(1), F.greatest(room - F.size("_b"), F.lit(0))))


def sequence_features(
    df: DataFrame,
    key: str,
    vocab: DataFrame,
    max_length: int = MAX_LENGTH,
    pad_left: bool = True,
    variant: str = "default",
) -> DataFrame:
    """Fixed-length ``input_ids``, ``attention_mask`` and ``token_type_ids`` of (text_a, text_b).

    Only the tokens that fit are looked up.  The vocabulary is broadcast when it is proven small,
    else joined with its hot terms spread; a list brought back together has at most ``max_length`` ids.
    """
    tokens = pair_tokens(df.select(key, "text_a", "text_b"), max_length)
    has_b = F.col("text_b").isNotNull()
    tail = F.when(has_b, F.concat("_b", F.array(F.lit("\u0003")))).otherwise(F.array().cast("array<string>"))
    layout = F.concat(F.array(F.lit("\u0002")), F.col("_a"), F.array(F.lit("\u0003")), tail)
    cells = each(tokens.withColumn("_n_a", F.size("_a")), layout, "term", [key, "_n_a"], "_at")
    # Tokens hold letters and digits only, so control characters can stand for the marks.
    marks = F.when(F.col("term") == "\u0002", START).when(F.col("term") == "\u0003", SEPARATOR)
    if small_enough(vocab, "term"):
        found = cells.join(F.broadcast(vocab), "term", "left")
    else:
        found = salted_join(materialize(cells, "tokens"), vocab, "term", "left")
    cells = found.select(
        key,
        "_at",
        F.coalesce(marks.cast("long"), F.col("term_id"), F.lit(UNKNOWN)).cast("int").alias("_id"),
        F.when(F.col("_at") <= F.col("_n_a") + 1, 0).otherwise(1).alias("_segment"),
    )
    lists = cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "_id", "_segment"))).alias("_c"))
    short = max_length - F.size("_c")

    def padded(values, filler: int):
        pad = F.array_repeat(F.lit(filler), short)
        return F.concat(pad, values) if pad_left else F.concat(values, pad)

    ones = F.transform("_c", lambda c: F.lit(1))
    return lists.select(
        key,
        padded(F.col("_c._id"), PAD).alias("input_ids"),
        padded(ones, 0).alias("attention_mask"),
        padded(F.col("_c._segment"), PAD_SEGMENT.get(variant, 0)).alias("token_type_ids"),
    )
