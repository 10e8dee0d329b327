"""Queries for scans, request texts, files and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from catalog.sql import KEYWORD_HITS
from corpusflow.operators import chunks as C
from corpusflow.operators import keyword
from corpusflow.session import scratch_path
from corpusflow.sources import delimited, requests, tables


@query("table_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def table_scan(spark, folder):
    return tables.scan(table(spark, folder, "orders"), "o_orderkey", ["o_custkey", "o_totalprice"])


@query("table_scan_limit", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def table_scan_limit(spark, folder):
    return tables.scan(table(spark, folder, "orders"), "o_orderkey", ["o_custkey", "o_totalprice"], 100)


def _contract_sql(name: str, key: str, start: int) -> str:
    return f"""SELECT '{name}' AS source, n, min_id, max_id, n_distinct, n - n_inside AS n_missing,
        n = n_distinct AND min_id = {start} AND max_id = {start} + n - 1 AS ok
        FROM (SELECT count(*) AS n, min({key}) AS min_id, max({key}) AS max_id, count(DISTINCT {key}) AS n_distinct,
              count(DISTINCT CASE WHEN {key} BETWEEN {start} AND {start} + total - 1 THEN {key} END) AS n_inside
              FROM {name}, (SELECT count(*) AS total FROM {name}))"""


#: Tables whose ids start where they should, earlier and later, with gaps and with repeats.
CONTRACTS = (("documents", "doc_id", 0), ("labels", "doc_id", 0), ("conversations", "conv_id", 0), ("orders", "o_orderkey", 1), ("nation", "n_nationkey", 3), ("region", "r_regionkey", -2))


@query(
    "id_contract",
    " UNION ALL ".join(
        _contract_sql(*t) for t in CONTRACTS
    ),
)
def id_contract(spark, folder):
    rows = None
    for name, key, start in CONTRACTS:
        report = tables.id_contract(table(spark, folder, name), key, start).select(F.lit(name).alias("source"), "*")
        rows = report if rows is None else rows.unionByName(report)
    return rows


@query(
    "rows_to_json",
    """SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":' || to_json(p_name) || ',"p_brand":' || to_json(p_brand)
       || ',"p_size":' || p_size || '}' AS value FROM part""",
)
def rows_to_json(spark, folder):
    rows = requests.rows_to_json(table(spark, folder, "part"), ["p_partkey", "p_name", "p_brand", "p_size"])
    return rows.select("p_partkey", "value")


@query("rows_to_raw", "SELECT p_partkey, p_name || p_brand || p_size AS value FROM part")
def rows_to_raw(spark, folder):
    return requests.rows_to_raw(table(spark, folder, "part"), ["p_name", "p_brand", "p_size"]).select("p_partkey", "value")


@query(
    "csv_scan",
    "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations",
)
def csv_scan(spark, folder):
    path = scratch_path(spark, "csv")
    delimited.write_csv(table(spark, folder, "conversations"), path)
    return delimited.read_csv(spark, path)


@query("tsv_scan", "SELECT item_id::VARCHAR AS _c0, text AS _c1 FROM benchmark")
def tsv_scan(spark, folder):
    path = scratch_path(spark, "rows") + ".tsv"
    delimited.write_rows(table(spark, folder, "benchmark").select("item_id", "text"), path)
    return delimited.read_rows(spark, path)


@query(
    "req_index",
    """SELECT doc_id, '{"data":' || to_json(text) || ',"doc_id":' || doc_id || ',"text":' || to_json(text)
       || ',"lang":' || to_json(lang) || '}' AS value FROM documents""",
)
def req_index(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return requests.requests(rows, "index").select("doc_id", "value")


@query(
    "req_train",
    """SELECT conv_id, turn, '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":' || to_json(role)
       || ',"text":' || to_json(text) || '}' AS value FROM conversations""",
)
def req_train(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return requests.requests(rows, "train").select("conv_id", "turn", "value")


@query("req_query", "SELECT item_id, text AS value FROM benchmark")
def req_query(spark, folder):
    rows = table(spark, folder, "benchmark").select("text", "item_id")
    return requests.requests(rows, "query").select("item_id", "value")


@query(
    "req_export",
    r"""SELECT replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r') AS value FROM conversations""",
)
def req_export(spark, folder):
    rows = table(spark, folder, "conversations").select("text", "conv_id")
    lines = requests.requests(rows, "query").select(requests.framed(F.col("value")).alias("value"))
    path = scratch_path(spark, "requests")
    requests.export_requests(lines, path)
    return spark.read.text(path)


@query(
    "answer_text",
    "SELECT conv_id, turn, text AS answer FROM conversations",
)
def answer_text(spark, folder):
    rows = table(spark, folder, "conversations")
    chunk = F.struct(F.col("text"), F.lit(0).alias("offset"))
    doc = F.struct(F.col("conv_id").alias("docId"), F.array(chunk).alias("chunks"))
    hit = F.struct(F.struct(F.lit(1.0).alias("value")).alias("score"), doc.alias("doc"))
    body = F.to_json(F.struct(F.struct(F.array(hit).alias("topkResults")).alias("search")))
    wrapped = F.to_json(F.struct(F.array(body).alias("res")))
    answer = requests.answer_text(F.when(F.col("role") == "assistant", wrapped).otherwise(body))
    return rows.select("conv_id", "turn", answer.alias("answer"))


@query(
    "top1_text",
    f"WITH {KEYWORD_HITS} SELECT r.request_id, r.doc_id, b.text FROM ranked r JOIN benchmark b ON b.item_id = r.doc_id WHERE rank = 1",
)
def top1_text(spark, folder):
    items = table(spark, folder, "benchmark").withColumnRenamed("item_id", "doc_id")
    chunks = C.unary_chunks(items)
    queries = table(spark, folder, "documents").select(F.col("doc_id").alias("request_id"), "text")
    hits = keyword.search(queries, keyword.build_index(chunks), 1)
    return requests.top_answers(hits, chunks)


@query(
    "chunk_fetch",
    """SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS page, (row_number() OVER (ORDER BY o_orderkey) - 1) % 1000 AS slot
       FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000)""",
)
def chunk_fetch(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    names, fetched = tables.fetch(rows, "o_orderkey", 1000, "o_totalprice > 1000")
    return fetched.select(*names, "page", "slot")


@query("bulk_insert", "SELECT * FROM labels UNION ALL SELECT doc_id, 1 - quality, toxic FROM labels")
def bulk_insert(spark, folder):
    labels = table(spark, folder, "labels")
    path = scratch_path(spark, "insert")
    tables.insert_rows(labels.select("doc_id", "toxic", "quality"), path)
    tables.insert_rows(labels, path, truncate=True)
    tables.insert_rows(labels.withColumn("quality", 1 - F.col("quality")), path)
    return spark.read.parquet(path)


@query("prediction_sink", "SELECT doc_id::VARCHAR AS _c0, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS _c1 FROM documents")
def prediction_sink(spark, folder):
    path = scratch_path(spark, "predictions") + ".csv"
    rule = F.when(F.col("n_chars") > 1000, "long").otherwise("short")
    delimited.write_rows(table(spark, folder, "documents").select("doc_id", rule.alias("prediction")), path)
    return delimited.read_rows(spark, path)


@query(
    "shuffled_scan",
    "SELECT doc_id, lang, row_number() OVER (ORDER BY md5(doc_id || '#7'), doc_id) - 1 AS position FROM documents",
)
def shuffled_scan(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    return tables.shuffled_positions(rows, "doc_id", seed=7)


@query(
    "doc_ids",
    "SELECT row_number() OVER (ORDER BY url, page_id) AS doc_id, page_id, url FROM pages",
)
def doc_ids(spark, folder):
    return tables.assign_doc_ids(table(spark, folder, "pages").select("page_id", "url"), ["url", "page_id"])
