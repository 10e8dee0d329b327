"""Queries for chunking, encoding and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from catalog.sql import PAIRS, sentence_rows, sentences, tokens
from corpusflow.functions import text as X
from corpusflow.operators import chunks as C
from corpusflow.operators import examples as E
from corpusflow.operators.scale import each


@query("unary_chunks", """SELECT doc_id, 0::INT AS "offset", text, 1.0::DOUBLE AS weight, 1::INT AS doc_type FROM documents""")
def unary_chunks(spark, folder):
    return C.unary_chunks(table(spark, folder, "documents"))


SENTENCES = f"SELECT *, 1.0::DOUBLE AS weight FROM ({sentence_rows('documents', 'doc_id')})"


@query("sentence_chunks", SENTENCES)
def sentence_chunks(spark, folder):
    return C.sentence_chunks(table(spark, folder, "documents"))


@query("json_chunks", SENTENCES)
def json_chunks(spark, folder):
    docs = table(spark, folder, "documents")
    payload = F.to_json(F.struct(F.col("lang"), F.col("text").alias("data")))
    return C.json_chunks(docs.select("doc_id", payload.alias("payload")))


def conversation_pairs(spark, folder):
    """(conv_id, turn, query, candidate, label): see ``catalog.sql.PAIRS``."""
    turns = table(spark, folder, "conversations")
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    replies = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("candidate"))
    wanted = users.select("*", F.explode(F.array(F.col("turn") + 1, F.col("turn") + 3)).alias("at"))
    label = F.when(F.col("at") == F.col("turn") + 1, 1.0).otherwise(0.0)
    return wanted.join(replies, ["conv_id", "at"]).select("conv_id", "turn", "query", "candidate", label.alias("label"))


@query(
    "train_records",
    f"""WITH {PAIRS} SELECT conv_id, turn, query, candidate, label, false AS rejected FROM pairs
        UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, true FROM conversations WHERE role = 'system'""",
)
def train_records(spark, folder):
    pairs = conversation_pairs(spark, folder)
    record = F.to_json(F.struct(F.col("query").alias("Query"), F.col("candidate").alias("Candidate"), F.col("label").alias("Label")))
    broken = table(spark, folder, "conversations").filter("role = 'system'").select("conv_id", "turn", F.concat(F.lit("{"), "text").alias("value"))
    good, bad = E.parse_train_records(pairs.select("conv_id", "turn", record.alias("value")).unionByName(broken))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("query", "string"), ("candidate", "string"), ("label", "double"))]
    return good.withColumn("rejected", F.lit(False)).unionByName(
        bad.select("conv_id", "turn", *empty, F.lit(True).alias("rejected"))
    )


@query(
    "examples",
    f"""WITH {PAIRS}
        SELECT 'pair' AS form, query AS text_a, candidate AS text_b, CASE label WHEN 1 THEN '1.0' ELSE '0.0' END AS label FROM pairs
        UNION ALL SELECT 'single', text, NULL, quality::VARCHAR FROM documents JOIN labels USING (doc_id)""",
)
def examples(spark, folder):
    pairs = E.examples(conversation_pairs(spark, folder), ["query", "candidate", "label"])
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    single = E.examples(docs, ["text", "quality"])
    return pairs.select(F.lit("pair").alias("form"), "*").unionByName(single.select(F.lit("single").alias("form"), "*"))


@query(
    "label_index",
    """SELECT doc_id, label, CASE label WHEN 'low' THEN 0 WHEN 'high' THEN 1 END::INT AS label_index, label = 'toxic' AS rejected
       FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' ELSE 'low' END AS label FROM labels)""",
)
def label_index(spark, folder):
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")
    known, unknown = E.index_labels(table(spark, folder, "labels").select("doc_id", name.alias("label")), ["low", "high"])
    return known.withColumn("rejected", F.lit(False)).unionByName(
        unknown.select("doc_id", "label", F.lit(None).cast("int").alias("label_index"), F.lit(True).alias("rejected"))
    )


_LAYOUT = f"""
  WITH {PAIRS},
  words AS (SELECT conv_id, turn, label, {tokens('query')} AS a, {tokens('candidate')} AS b FROM pairs),
  vocab AS (SELECT term, row_number() OVER (ORDER BY term) + 3 AS term_id
            FROM (SELECT unnest(a) AS term FROM words UNION SELECT unnest(b) FROM words)),
  cut_b AS (SELECT *, b[1:253] AS b2 FROM words),
  cut AS (SELECT *, a[1:greatest(253 - len(b2), 0)] AS a2 FROM cut_b),
  cells AS (SELECT conv_id, turn, label, i, CASE WHEN i = 1 OR i = len(a2) + 2 OR i = len(a2) + len(b2) + 3 THEN NULL
                WHEN i <= len(a2) + 1 THEN a2[i - 1] ELSE b2[i - len(a2) - 2] END AS term,
              CASE WHEN i = 1 THEN 2 WHEN i = len(a2) + 2 OR i = len(a2) + len(b2) + 3 THEN 3 END AS mark,
              CASE WHEN i <= len(a2) + 2 THEN 0 ELSE 1 END AS segment
            FROM (SELECT *, unnest(range(1, len(a2) + len(b2) + 4)) AS i FROM cut)),
  ids AS (SELECT conv_id, turn, label, list(coalesce(mark, term_id, 1) ORDER BY i) AS ids, list(segment ORDER BY i) AS segments
          FROM cells LEFT JOIN vocab USING (term) GROUP BY ALL)
"""


@query(
    "sequence_features",
    _LAYOUT
    + """SELECT conv_id, turn, label,
           array_to_string(list_concat(list_resize([]::BIGINT[], 256 - len(ids), 0), ids), ' ') AS input_ids,
           array_to_string(list_concat(list_resize([]::BIGINT[], 256 - len(ids), 0), list_resize([]::BIGINT[], len(ids), 1)), ' ') AS attention_mask,
           array_to_string(list_concat(list_resize([]::INT[], 256 - len(ids), 0), segments), ' ') AS token_type_ids
         FROM ids""",
)
def sequence_features(spark, folder):
    pairs = conversation_pairs(spark, folder)
    vocab = E.vocabulary(pairs, ["query", "candidate"])
    key = F.struct("conv_id", "turn", "label").alias("key")
    data = E.examples(pairs.withColumn("key", key), ["query", "candidate", "label"], keep=["key"])
    rows = E.sequence_features(data, "key", vocab)
    lists = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "attention_mask", "token_type_ids")]
    return rows.select("key.conv_id", "key.turn", "key.label", *lists)


_BATCHED = f"""
  SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id,
         (row_number() OVER (ORDER BY doc_id) - 1) % 32 AS slot, {tokens('text')} AS words FROM documents"""


@query(
    "pad_batch",
    f"""SELECT doc_id, batch_id, len(words)::INT AS n, max(len(words)) OVER (PARTITION BY batch_id)::INT AS padded_size,
        coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS total FROM ({_BATCHED})""",
)
def pad_batch(spark, folder):
    lengths = F.transform(X.tokens(F.col("text")), lambda t: F.length(t))
    docs = table(spark, folder, "documents", spread=True).select("doc_id", lengths.alias("cells"))
    padded = C.pad_to_batch(C.batch_ids(docs, ["doc_id"], 32), "batch_id", "cells")
    total = F.aggregate("padded", F.lit(0).cast("long"), lambda s, x: s + x)
    return padded.select("doc_id", "batch_id", F.size("cells").alias("n"), F.size("padded").alias("padded_size"), total.alias("total"))


@query(
    "batches",
    f"""SELECT batch_id, count(*)::INT AS n, string_agg(doc_id::VARCHAR, ' ' ORDER BY slot) AS doc_ids,
        string_agg(lang, ' ' ORDER BY slot) AS langs FROM (SELECT b.*, d.lang FROM ({_BATCHED}) b JOIN documents d USING (doc_id)) GROUP BY 1""",
)
def batches(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    rows = C.batches(docs, ["doc_id"], 32, ["doc_id", "lang"])
    ids = F.array_join(F.col("doc_id").cast("array<string>"), " ")
    return rows.select("batch_id", "n", ids.alias("doc_ids"), F.array_join("lang", " ").alias("langs"))


def _bytes_sql(n: int) -> str:
    """CTE bytes(doc_id, text, h, cut): hex of the UTF-8 bytes and where to cut them."""

    def inside(position: int) -> str:
        return f"substr(h, {2 * position - 1}, 2) BETWEEN '80' AND 'BF'"

    return f"""
      bytes AS (SELECT doc_id, text, h, CASE WHEN length(h) <= {2 * n} THEN length(h) // 2
                  WHEN NOT {inside(n + 1)} THEN {n} WHEN NOT {inside(n)} THEN {n - 1}
                  WHEN NOT {inside(n - 1)} THEN {n - 2} ELSE {n - 3} END AS cut
                FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents))"""


def _byte_query(n: int):
    @query(
        f"byte_encode_{n}",
        f"WITH {_bytes_sql(n)} SELECT doc_id, cut::INT AS cut, md5(rpad(substr(h, 1, 2 * cut), {2 * n}, '0')) AS digest FROM bytes",
    )
    def byte_encode(spark, folder):
        docs = table(spark, folder, "documents")
        digest = F.md5(F.hex(X.byte_encode(F.col("text"), n)))
        return docs.select("doc_id", X.byte_cut(F.col("text"), n).alias("cut"), digest.alias("digest"))

    return byte_encode


byte_encode_256 = _byte_query(256)
byte_encode_1024 = _byte_query(1024)


@query(
    "byte_decode",
    f"WITH {_bytes_sql(1024)} SELECT doc_id, rtrim(decode(unhex(substr(h, 1, 2 * cut))), chr(0)) AS text FROM bytes",
)
def byte_decode(spark, folder):
    vectors = table(spark, folder, "documents").select("doc_id", X.byte_encode(F.col("text"), 1024).alias("vector"))
    return vectors.select("doc_id", X.byte_decode(F.col("vector")).alias("text"))


@query(
    "char_embed_64",
    """WITH letters AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM documents),
       grams AS (SELECT doc_id, unnest(list_transform(range(1, len(l) - 1), lambda i: (((unicode(l[i]) * 131 + unicode(l[i + 1])) * 131 + unicode(l[i + 2])) * 40503::BIGINT >> 16) % 64)) AS cell FROM letters),
       counts AS (SELECT doc_id, cell, count(*) AS n FROM grams GROUP BY 1, 2),
       norms AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM counts GROUP BY 1),
       cells AS (SELECT doc_id, unnest(range(64)) AS cell FROM documents)
       SELECT doc_id, cell::INT AS cell, coalesce(round(n / len, 6), 0.0)::DOUBLE AS value
       FROM cells LEFT JOIN counts USING (doc_id, cell) LEFT JOIN norms USING (doc_id)""",
)
def char_embed_64(spark, folder):
    vector = X.char_embedding(F.col("text"))
    cells = each(table(spark, folder, "documents", spread=True), vector, "value", ["doc_id"], "cell")
    return cells.withColumn("value", F.round("value", 6))
