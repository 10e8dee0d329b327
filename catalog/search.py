"""Queries for the keyword, full-text and vector indexes and the document store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import query, table
from catalog.sql import ALL, ANY, KEYWORD_HITS, fulltext as ft, ranked, sentence_rows, starts, tokens
from corpusflow.functions import text as X
from corpusflow.operators import chunks as C
from corpusflow.operators import docstore, fulltext, keyword, pivots, quantised, vectors
from corpusflow.operators.segments import Folder
from corpusflow.session import materialize, scratch_path
from corpusflow.sources import tables


def documents(spark, folder):
    return table(spark, folder, "documents", spread=True)


def whole_docs(spark, folder):
    return C.unary_chunks(documents(spark, folder))


def doc_queries(spark, folder):
    return documents(spark, folder).select(F.col("doc_id").alias("request_id"), "text")


def items(spark, folder):
    """Benchmark texts as search queries."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("request_id"), "text")


def item_chunks(spark, folder):
    return C.unary_chunks(table(spark, folder, "benchmark").withColumnRenamed("item_id", "doc_id"))


def item_index(spark, folder):
    return keyword.build_index(item_chunks(spark, folder))


_INDEXES: dict[tuple, fulltext.TextIndex] = {}


def _stamp(spark, path):
    """Size and last change of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(at).getLength(), files.getFileStatus(at).getModificationTime()


def standing(spark, folder, name, build):
    """The standing index of that name over a folder's documents, built by the first query that asks for it.

    It is built again when the table has changed or the index has been deleted.
    """
    key = (spark.sparkContext.applicationId, folder, name, _stamp(spark, f"{folder}/documents.parquet"))
    if key not in _INDEXES or not Folder(spark, _INDEXES[key].path).manifest().version:
        _INDEXES[key] = build()
    return _INDEXES[key]


def indexed_docs(spark, folder, name="plain", **analysis):
    return standing(spark, folder, name, lambda: fulltext.build(whole_docs(spark, folder), **analysis))


def asked_items(spark, folder):
    """Benchmark texts as search requests, each with a number of hits of its own."""
    return items(spark, folder).withColumn("top_k", (F.col("request_id") % 5 + 1).cast("int"))


# ---- keyword ------------------------------------------------------------------------------------

_INDEX = f"""
  WITH chunks AS ({sentence_rows('documents', 'doc_id')}),
  latest AS (SELECT text, max(doc_id) AS doc_id, count(*) AS added FROM chunks GROUP BY text)
  SELECT l.text, l.doc_id, max(c."offset")::INT AS "offset", l.added
  FROM latest l JOIN chunks c USING (text, doc_id) GROUP BY ALL"""


@query("keyword_index", _INDEX)
def keyword_index(spark, folder):
    return keyword.build_index(C.sentence_chunks(documents(spark, folder)))


@query("keyword_stats", f"SELECT count(*) AS patterns, sum(added)::BIGINT AS size FROM ({_INDEX})")
def keyword_stats(spark, folder):
    return keyword.index_stats(keyword_index(spark, folder))


_MATCH = f"WITH {KEYWORD_HITS} SELECT * FROM hits"


@query("keyword_match_grams", _MATCH)
@query("keyword_match", _MATCH)
def keyword_match(spark, folder):
    return keyword.match(doc_queries(spark, folder), item_index(spark, folder))


@query(
    "keyword_topk",
    f'WITH {KEYWORD_HITS} SELECT request_id, rank, doc_id, "offset", weight, relevance FROM ranked WHERE rank <= 1 + request_id % 3',
)
def keyword_topk(spark, folder):
    asked = doc_queries(spark, folder).withColumn("top_k", (1 + F.col("request_id") % 3).cast("int"))
    return keyword.search(asked, item_index(spark, folder))


@query(
    "keyword_match_short",
    f"""WITH patterns AS (SELECT DISTINCT substr(p_name, 1 + (p_partkey % 3)::INT, 1 + (p_partkey % 7)::INT) AS text FROM part),
        named AS (SELECT text, hash_id FROM (SELECT text, row_number() OVER (ORDER BY text) - 1 AS hash_id FROM patterns) WHERE text <> ''),
        asked AS (SELECT s_nationkey AS request_id, s_suppkey, s_name || s_name || coalesce(s_name[1:9], '') AS text FROM supplier
                  UNION ALL SELECT n_nationkey, -1, n_name || ' ' || n_name FROM nation
                  UNION ALL SELECT p_partkey % 50, p_partkey, p_name FROM part WHERE p_partkey % 5 = 0),
        found AS (SELECT a.request_id::BIGINT AS request_id, p.hash_id AS doc_id, {starts('a.text', 'p.text')} AS pos, length(p.text)::INT AS pattern_length
                  FROM asked a JOIN named p ON contains(a.text, p.text))
        SELECT request_id, doc_id, sum(len(pos))::DOUBLE AS relevance, min(pos[1] - 1 + pattern_length)::BIGINT AS first_end,
               min(pattern_length) AS pattern_length FROM found GROUP BY ALL""",
)
def keyword_match_short(spark, folder):
    """Short patterns that overlap themselves and each other, and several texts under one request id."""
    return _match_short(spark, folder, table(spark, folder, "part").filter("p_partkey % 5 = 0"))


@query("keyword_match_short_all")
def keyword_match_short_all(spark, folder):
    """The same patterns in the names of all parts."""
    return _match_short(spark, folder, table(spark, folder, "part"))


def _match_short(spark, folder, asked):
    part, supplier, nation = (table(spark, folder, n) for n in ("part", "supplier", "nation"))
    cut = F.expr("substring(p_name, cast(1 + p_partkey % 3 as int), cast(1 + p_partkey % 7 as int))")
    patterns = part.select(cut.alias("text")).distinct()
    numbered = tables.assign_doc_ids(patterns, ["text"], start=0).filter("text <> ''")
    index = keyword.build_index(numbered.select("doc_id", F.lit(0).alias("offset"), "text"))
    names = supplier.select(F.col("s_nationkey").cast("long").alias("request_id"), F.expr("s_name || s_name || substring(s_name, 1, 9)").alias("text"))
    names = names.unionByName(nation.select(F.col("n_nationkey").cast("long").alias("request_id"), F.expr("n_name || ' ' || n_name").alias("text")))
    parts = asked.select((F.col("p_partkey") % 50).cast("long").alias("request_id"), F.col("p_name").alias("text"))
    hits = keyword.match(names.unionByName(parts), index)
    return hits.select("request_id", "doc_id", "relevance", "first_end", "pattern_length")


def _refused(build) -> bool:
    try:
        build()
    except TypeError:
        return True
    return False


@query(
    "index_guards",
    f"""WITH {KEYWORD_HITS}, counts AS (SELECT request_id, count(*) AS n FROM hits WHERE doc_id % 2 = 0 GROUP BY 1)
        SELECT d.doc_id AS request_id, 0::BIGINT AS hits_in_empty, coalesce(n, 0)::BIGINT AS hits_in_mixed, true AS refuses_numbers, true AS refuses_binary
        FROM documents d LEFT JOIN counts c ON c.request_id = d.doc_id""",
)
def index_guards(spark, folder):
    """An index of empty texts finds nothing; one of empty and other texts finds the others; wrong types are refused."""
    asked, chunks = doc_queries(spark, folder), item_chunks(spark, folder)
    blank = chunks.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit("")))
    counted = []
    for name, rows in (("hits_in_empty", blank.withColumn("text", F.lit(""))), ("hits_in_mixed", blank)):
        counted.append(keyword.match(asked, keyword.build_index(rows)).groupBy("request_id").agg(F.count(F.lit(1)).alias(name)))
    result = asked.select("request_id")
    for counts in counted:
        result = result.join(counts, "request_id", "left")
    numbers = _refused(lambda: keyword.build_index(chunks.withColumn("text", F.length("text"))))
    binary = _refused(lambda: keyword.match(asked.withColumn("text", F.encode("text", "utf-8")), keyword.build_index(chunks)))
    result = result.fillna(0, ["hits_in_empty", "hits_in_mixed"])
    return result.withColumns({"refuses_numbers": F.lit(numbers), "refuses_binary": F.lit(binary)})


# ---- full text ----------------------------------------------------------------------------------


@query(
    "postings",
    f"""SELECT term, doc_id, 0::INT AS "offset", count(*)::INT AS tf, string_agg((i - 1)::VARCHAR, ' ' ORDER BY i) AS positions
        FROM (SELECT doc_id, unnest({tokens('text')}) AS term, unnest(range(1, len({tokens('text')}) + 1)) AS i FROM documents)
        GROUP BY 1, 2""",
)
def postings(spark, folder):
    rows = fulltext.build(whole_docs(spark, folder)).postings()
    return rows.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query("term_stats", f"WITH {ft()} SELECT term, df FROM dfs")
def term_stats(spark, folder):
    return indexed_docs(spark, folder).term_stats().select("term", "df")


@query("search_all_by_term", f"WITH {ft()}, {ranked(ALL, 5)} SELECT * FROM best")
@query("search_all", f"WITH {ft()}, {ranked(ALL, 5)} SELECT * FROM best")
def search_all(spark, folder):
    return fulltext.search(indexed_docs(spark, folder), items(spark, folder), 5)


@query("search_any", f"WITH {ft()}, {ranked(ANY, '1 + request_id % 5')} SELECT * FROM best")
def search_any(spark, folder):
    return fulltext.search(indexed_docs(spark, folder), asked_items(spark, folder), match="any")


@query("search_any_bounds", f"WITH {ft()}, {ranked(ANY, '1 + request_id % 5')} SELECT * FROM best")
def search_any_bounds(spark, folder):
    """The same hits by thresholds, which leave most postings of common terms unread."""
    return fulltext.search(indexed_docs(spark, folder), asked_items(spark, folder), match="any", plan="bounds")


_LATER = f"""WITH {ft().replace("FROM documents)", "FROM later)", 1).replace("FROM documents)", "FROM later)")}, {ranked(ANY, 5)} SELECT * FROM best""".replace(
    "WITH", "WITH later AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'updated ' || lang || ' ' || source ELSE text END AS text FROM documents),", 1
)


def _updated(spark, folder):
    """An index of half of the documents, to which the rest and then updates are added."""
    docs = documents(spark, folder)
    index = fulltext.build(C.unary_chunks(docs.filter("doc_id % 2 = 0")))
    index = index.add(C.unary_chunks(docs.filter("doc_id % 2 = 1")))
    updates = docs.filter("doc_id % 10 = 0").withColumn("text", F.concat_ws(" ", F.lit("updated"), "lang", "source"))
    return index.add(C.unary_chunks(updates))


@query("index_add_search", _LATER)
def index_add_search(spark, folder):
    """Search of an index with several segments and replaced chunks."""
    return fulltext.search(_updated(spark, folder), items(spark, folder), 5, match="any")


@query("index_compact_search", _LATER)
def index_compact_search(spark, folder):
    """The same after all segments were merged into one and older files deleted."""
    index = _updated(spark, folder).compact()
    index.vacuum()
    return fulltext.search(index, items(spark, folder), 5, match="any")


STEM = """CASE WHEN suffix(term, 'ies') AND NOT suffix(term, 'eies') AND NOT suffix(term, 'aies') THEN left(term, length(term) - 3) || 'y'
  WHEN suffix(term, 'es') AND NOT suffix(term, 'aes') AND NOT suffix(term, 'ees') AND NOT suffix(term, 'oes') THEN left(term, length(term) - 1)
  WHEN suffix(term, 's') AND NOT suffix(term, 'us') AND NOT suffix(term, 'ss') THEN left(term, length(term) - 1) ELSE term END"""


@query("search_stemmed", f"WITH {ft(STEM)}, {ranked(ANY, 5)} SELECT * FROM best")
def search_stemmed(spark, folder):
    index = indexed_docs(spark, folder, "s-stem", stem=X.s_stem)
    return fulltext.search(index, items(spark, folder), 5, match="any", stem=X.s_stem)


@query("search_porter")
def search_porter(spark, folder):
    index = standing(
        spark, folder, "porter", lambda: fulltext.build_terms(fulltext.porter_terms(fulltext.chunk_terms(whole_docs(spark, folder))))
    )
    queries = items(spark, folder).select(F.col("request_id").alias("doc_id"), F.lit(0).alias("offset"), "text")
    stems = fulltext.porter_terms(fulltext.chunk_terms(queries))
    clauses = stems.select(F.col("doc_id").alias("request_id"), F.explode(F.array_distinct("terms")).alias("term"))
    return fulltext.bool_search(index, clauses.withColumn("clause", F.lit("should")), 5)


_CLAUSES = f"""
  words AS (SELECT item_id AS request_id, {tokens('text')} AS w FROM benchmark),
  clauses AS (
    SELECT 2 * request_id AS request_id, 'must' AS clause, w[1] AS term FROM words
    UNION SELECT 2 * request_id, 'must', w[2] FROM words
    UNION SELECT 2 * request_id + v, 'should', unnest(w[3:]) FROM words, (VALUES (0), (1)) variant(v)
    UNION SELECT 2 * request_id + v, 'must_not', w[len(w)] FROM words, (VALUES (0), (1)) variant(v))"""


def bool_clauses(spark, folder):
    """Two requests per benchmark text.  Both: should = all words but the first two, must_not = the last word.
    The first one also: must = the first two words."""
    words = items(spark, folder).select("request_id", X.tokens(F.col("text")).alias("w"))
    first, second = (words.withColumn("request_id", 2 * F.col("request_id") + v) for v in (0, 1))
    must = first.select("request_id", F.lit("must").alias("clause"), F.explode(F.slice("w", 1, 2)).alias("term"))
    words = first.unionByName(second)
    rest = F.slice("w", F.lit(3), F.greatest(F.size("w") - 2, F.lit(0)))
    should = words.select("request_id", F.lit("should").alias("clause"), F.explode(rest).alias("term"))
    must_not = words.select("request_id", F.lit("must_not").alias("clause"), F.element_at("w", -1).alias("term"))
    return must.unionByName(should).unionByName(must_not)


_BOOL = f"""
  WITH {ft()}, {_CLAUSES},
  weighted AS (SELECT c.request_id, c.clause, p.doc_id, p."offset", p.tf * ln((nn.n + 1) / (d.df + 1)) AS part
               FROM clauses c JOIN post p ON p.term = c.term JOIN dfs d ON d.term = c.term CROSS JOIN nn),
  sums AS (SELECT request_id, doc_id, "offset", count(*) FILTER (clause = 'must') AS have, count(*) FILTER (clause = 'should') AS extra,
                  count(*) FILTER (clause = 'must_not') AS banned, sum(part) FILTER (clause <> 'must_not') AS raw_score
           FROM weighted GROUP BY ALL),
  needed AS (SELECT request_id, count(*) FILTER (clause = 'must') AS need FROM clauses GROUP BY 1),
  {ranked('SELECT s.* FROM sums s JOIN needed USING (request_id) WHERE have = need AND banned = 0 AND (need > 0 OR extra > 0)', 5)}
  SELECT * FROM best"""


@query("search_bool_by_term", _BOOL)
@query("search_bool", _BOOL)
def search_bool(spark, folder):
    return fulltext.bool_search(indexed_docs(spark, folder), bool_clauses(spark, folder), 5)


@query("search_bool_bounds", _BOOL)
def search_bool_bounds(spark, folder):
    return fulltext.bool_search(indexed_docs(spark, folder), bool_clauses(spark, folder), 5, plan="bounds")


@query(
    "search_phrase",
    f"""WITH {ft()},
        lines AS (SELECT doc_id, ' ' || array_to_string({tokens('text')}, ' ') || ' ' AS line FROM documents),
        phrases AS (SELECT item_id AS request_id, ' ' || array_to_string({tokens('text')}, ' ') || ' ' AS phrase FROM benchmark),
        {ranked(f"SELECT a.* FROM ({ALL}) a JOIN lines USING (doc_id) JOIN phrases USING (request_id) WHERE contains(line, phrase)", 5)}
        SELECT * FROM best""",
)
def search_phrase(spark, folder):
    return fulltext.phrase_search(indexed_docs(spark, folder), items(spark, folder), 5)


@query(
    "joint_search",
    f"""WITH {ft()}, {ranked(ANY, 5)} SELECT request_id, rank, doc_id, score, lang, text, s.doc_id IS NOT NULL AS found
        FROM best LEFT JOIN (SELECT * FROM documents WHERE doc_id % 7 <> 0) s USING (doc_id)""",
)
def joint_search(spark, folder):
    """Hits with their documents, one document in seven not being stored."""
    hits = search_items(spark, folder).select("request_id", "rank", "doc_id", "score")
    stored = table(spark, folder, "documents").filter("doc_id % 7 <> 0").select("doc_id", "lang", "text")
    return docstore.joint_search(hits, stored)


def search_items(spark, folder):
    return fulltext.search(indexed_docs(spark, folder), items(spark, folder), 5, match="any")


# ---- document store -----------------------------------------------------------------------------


def _writes(spark, folder):
    """Documents, then conversation turns written over them: the last turn stays."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.lit(0).cast("long").alias("seq"))
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), "text", (F.col("turn") + 1).alias("seq"))
    return docs, turns


_UPSERT = """SELECT doc_id, arg_max(text, seq) AS text, max(seq) AS seq FROM (
  SELECT doc_id, text, 0 AS seq FROM documents UNION ALL SELECT conv_id, text, turn + 1 FROM conversations) GROUP BY 1"""


@query("doc_upsert", _UPSERT)
def doc_upsert(spark, folder):
    return docstore.upsert(*_writes(spark, folder))


@query("doc_store_scan", _UPSERT)
def doc_store_scan(spark, folder):
    path = scratch_path(spark, "store")
    docs, turns = _writes(spark, folder)
    docstore.write_store(docs, path, buckets=8)
    docstore.write_store(turns, path, buckets=8)
    return docstore.read_store(spark, path).select("doc_id", "text", "seq")


@query("doc_get", "SELECT doc_id, text, source FROM documents WHERE doc_id IN (1, 7, 42, 99, 150, 151, 152, 180, 190, 199, 500, 4321, 99999999)")
def doc_get(spark, folder):
    """A few documents by key from the stored form, some of them not there."""
    path = scratch_path(spark, "store")
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", F.lit(1).alias("seq"))
    docstore.write_store(docs, path, buckets=8)
    found = docstore.get(spark, path, [1, 7, 42, 99, 150, 151, 152, 180, 190, 199, 500, 4321, 99999999], buckets=8)
    return found.select("doc_id", "text", "source")


@query(
    "doc_lookup",
    """SELECT e.event_id, e.user_id * 10 AS doc_id, md5(d.text) AS digest, d.doc_id IS NOT NULL AS found
       FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id * 10""",
)
def doc_lookup(spark, folder):
    requests = table(spark, folder, "events").select("event_id", (F.col("user_id") * 10).alias("doc_id"))
    store = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("digest"))
    return docstore.lookup(requests, store).select("event_id", "doc_id", "digest", "found")


# ---- vectors ------------------------------------------------------------------------------------


def vector_table(spark, folder):
    return table(spark, folder, "embeddings", spread=True).select("vec_id", F.col("embedding").alias("vector"))


def vector_queries(spark, folder):
    return vector_table(spark, folder).withColumnRenamed("vec_id", "request_id")


def _nearest_sql(distance: str) -> str:
    return f"""
      WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
      pairs AS (SELECT q.vec_id AS request_id, v.vec_id, round({distance}, 6) + 0.0 AS distance FROM v q CROSS JOIN v)
      SELECT * FROM (SELECT request_id, vec_id, distance,
        row_number() OVER (PARTITION BY request_id ORDER BY distance, vec_id)::INT AS rank FROM pairs) WHERE rank <= 5"""


_L2 = _nearest_sql("list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))")
_COSINE = _nearest_sql("1 - list_cosine_similarity(q.e, v.e)")


@query("vector_topk", _L2)
def vector_topk(spark, folder):
    return vectors.nearest(vector_queries(spark, folder), vector_table(spark, folder), 5)


@query("vector_topk_own_k", _L2.replace("WHERE rank <= 5", "WHERE rank <= request_id % 6"))
def vector_topk_own_k(spark, folder):
    """The same with a number of hits per request, none for some."""
    return vectors.nearest(_own_k(spark, folder), vector_table(spark, folder), None)


def _own_k(spark, folder):
    return vector_queries(spark, folder).withColumn("top_k", (F.col("request_id") % 6).cast("int"))


@query("vector_topk_pivots", _L2)
def vector_topk_pivots(spark, folder):
    return pivots.PivotIndex.build(vector_table(spark, folder)).search(vector_queries(spark, folder), 5)


@query("vector_topk_blocks", _L2)
def vector_topk_blocks(spark, folder):
    return vectors.nearest(vector_queries(spark, folder), vector_table(spark, folder), 5, plan="blocks")


@query("vector_topk_cosine", _COSINE)
def vector_topk_cosine(spark, folder):
    return vectors.nearest(vector_queries(spark, folder), vector_table(spark, folder), 5, metric="cosine")


#: Share of the exact nearest neighbours that the approximate search must find.
ENOUGH = 0.9


@query("vector_ann", "SELECT vec_id AS request_id, least(5, (SELECT count(*) FROM embeddings))::BIGINT AS n, true AS exact_distances, true AS in_order, true AS enough_recall FROM embeddings")
def vector_ann(spark, folder):
    """Per request: its number of hits, whether their distances and order are right; and whether the recall over all is 0.9 at least."""
    return _approximate(spark, folder, vector_queries(spark, folder), 5)


@query("vector_ann_own_k", "SELECT vec_id AS request_id, least(vec_id % 6, (SELECT count(*) FROM embeddings))::BIGINT AS n, true AS exact_distances, true AS in_order, true AS enough_recall FROM embeddings WHERE vec_id % 6 > 0")
def vector_ann_own_k(spark, folder):
    """The same with a number of hits per request, none for some."""
    return _approximate(spark, folder, _own_k(spark, folder), None)


def _approximate(spark, folder, asked, k):
    stored = vector_table(spark, folder)
    found = materialize(vectors.nearest_approximate(asked, stored, k), "approximate")
    both = found.join(asked.select("request_id", F.col("vector").alias("q")), "request_id").join(stored, "vec_id")
    right = F.round(vectors.distance(F.col("q"), F.col("vector")), 6) == F.col("distance")
    exact = materialize(vectors.nearest(asked, stored, k).select("request_id", "vec_id"), "exact")  # all pairs are compared once
    recall = found.join(exact, ["request_id", "vec_id"]).count() / max(1, exact.count())
    earlier = F.lag("distance").over(Window.partitionBy("request_id").orderBy("rank"))
    rows = both.withColumns({"right": right, "earlier": earlier})
    summed = rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.every("right").alias("exact_distances"), F.every(F.coalesce(F.col("earlier") <= F.col("distance"), F.lit(True))).alias("in_order")
    )
    return summed.withColumn("enough_recall", F.lit(recall >= ENOUGH))


@query("vector_quantised", "SELECT vec_id AS request_id, least(5, (SELECT count(*) FROM embeddings))::BIGINT AS n, true AS enough_recall FROM embeddings")
def vector_quantised(spark, folder):
    """Per request its number of hits by product quantisation, and whether their recall over all is 0.9 at least."""
    asked, stored = vector_queries(spark, folder), vector_table(spark, folder)
    found = materialize(quantised.QuantisedIndex.build(stored, 5).search(asked, 5), "quantised")
    exact = materialize(vectors.nearest(asked, stored, 5).select("request_id", "vec_id"), "exact")  # all pairs are compared once
    recall = found.join(exact, ["request_id", "vec_id"]).count() / max(1, exact.count())
    return found.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).withColumn("enough_recall", F.lit(recall >= ENOUGH))
