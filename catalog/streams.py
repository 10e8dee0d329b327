"""Queries for the streaming forms: each runs its stream over the rows available now and reads the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import SQL, query, table
from catalog.flows import INDEXED_SQL, index_messages, index_summary
from catalog.routing import FITTED, _idf, _parts
from catalog.search import indexed_docs, items
from catalog.sql import ALL, ANY, fulltext as ft, ranked, tokens
from catalog.texts import conversation_pairs
from corpusflow.operators import chunks as C
from corpusflow.operators import examples, fulltext, packed
from corpusflow.session import freed_shuffles, scratch_path
from corpusflow.streaming import jobs, state


#: Rows of a file, on the mean and at least, of a part that is written by several tasks.
FILE_ROWS = 5_000


def stream(spark, folder, name):
    """A given table, one file or a folder of them, as a stream of its files."""
    at, schema = f"{folder}/{name}.parquet", table(spark, folder, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return jobs.read_files(spark, at, schema)
    return jobs.read_files(spark, folder, schema, f"{name}.parquet")


def batches(spark, rows, parts):
    """A table as a stream of several micro-batches, in order of its ``part`` column.

    Large parts are written by several tasks.  All parts but the last have equally many files, of at least ``FILE_ROWS`` rows on the
    mean, as a micro-batch is told by its number of files.
    """
    path = scratch_path(spark, "stream")
    held = dict(rows.filter(F.col("part") < parts - 1).groupBy("part").count().collect())  # a row per part
    files = max(1, min(held.get(part, 0) for part in range(parts - 1)) // FILE_ROWS)
    for part in range(parts):
        some = rows.filter(F.col("part") == part).drop("part")
        with freed_shuffles(spark):
            (packed.spread(some, files) if files > 1 else some.coalesce(1)).write.mode("append").option("compression", "zstd").parquet(path)
    return jobs.read_files(spark, path, rows.drop("part").schema, "*.parquet", per_batch=files)


def sent_at(conversation=None):
    """An event time for a turn, as conversations hold none: turns are seconds apart, conversations minutes, or all begin at once.

    Both numbers wrap, so that any ids and numbers of turns give a time, and two turns of a conversation are less than ten minutes apart.
    """
    minutes = F.pmod(F.col(conversation), F.lit(1_000_000)) if conversation else F.lit(0)
    return F.timestamp_seconds(1_700_000_000 + minutes * 60 + F.pmod(F.col("turn"), F.lit(600)))


def finish(running):
    running.awaitTermination()
    if running.exception():
        raise running.exception()


@query("stream_ingest", INDEXED_SQL)
def stream_ingest(spark, folder):
    path, state = scratch_path(spark, "index"), scratch_path(spark, "state")
    finish(jobs.ingest(index_messages(stream(spark, folder, "documents")), path, state))
    return index_summary(*jobs.read_index(spark, path))


@query(
    "stream_ingest_search",
    f"""WITH later AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'updated ' || lang || ' ' || source ELSE text END AS text FROM documents),
        {ft().replace("FROM documents)", "FROM later)")}, {ranked(ANY, 5)} SELECT * FROM best""",
)
def stream_ingest_search(spark, folder):
    """Documents in two micro-batches, each write there twice; updates of some in a later one, which also
    brings back an older write; then a search of the streamed index."""
    docs = table(spark, folder, "documents").select(F.lit("index").alias("kind"), "doc_id", "text", "lang", "source")
    first = docs.withColumns({"seq": F.lit(1), "part": (F.col("doc_id") % 2).cast("int")})
    older = first.withColumns({"seq": F.lit(0), "text": F.concat(F.lit("an older text "), "text")})
    some = docs.filter("doc_id % 10 = 0").withColumn("part", F.lit(2))
    update = some.withColumns({"seq": F.lit(5), "text": F.concat_ws(" ", F.lit("updated"), "lang", "source")})
    stale = some.withColumns({"seq": F.lit(2), "text": F.lit("between the two")})
    rows = first.unionByName(older).unionByName(update).unionByName(stale).drop("lang", "source")
    path, state = scratch_path(spark, "index"), scratch_path(spark, "state")
    finish(jobs.ingest(batches(spark, rows, 3), path, state))
    index, _ = jobs.read_index(spark, path)
    return fulltext.search(index, items(spark, folder), 5, match="any")


@query("stream_block", "SELECT event_id, event_type AS kind, value FROM events WHERE event_type <> 'view'")
def stream_block(spark, folder):
    path, state = scratch_path(spark, "kept"), scratch_path(spark, "state")
    messages = stream(spark, folder, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    finish(jobs.block(messages, ["view"], path, state))
    return spark.read.parquet(path)


@query("stream_search", f"WITH {ft()}, {ranked(ALL, 5)} SELECT * FROM best")
def stream_search(spark, folder):
    path, state = scratch_path(spark, "hits"), scratch_path(spark, "state")
    asked = stream(spark, folder, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    finish(jobs.search(asked, indexed_docs(spark, folder), 5, path, state))
    return spark.read.parquet(path).drop("batch_id")


@query(
    "stream_rendezvous",
    """SELECT u.conv_id || '#' || u.turn AS request_id, md5(u.text) AS query, md5(a.text) AS answer FROM conversations u
       JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
)
def stream_rendezvous(spark, folder):
    path, state = scratch_path(spark, "pairs"), scratch_path(spark, "state")

    def side(role: str, shift: int, name: str):
        turns = stream(spark, folder, "conversations").filter(F.col("role") == role)
        key = F.concat_ws("#", F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string"))
        return turns.select(key.alias("request_id"), sent_at("conv_id").alias("ts"), F.md5("text").alias(name))

    paired = jobs.rendezvous(side("user", 0, "query"), side("assistant", 1, "answer"), "10 minutes")
    finish(jobs.write_stream(paired.select("request_id", "query", "answer"), path, state))
    return spark.read.parquet(path)


@query(
    "stream_rendezvous_hits",
    """SELECT u.conv_id || '#' || u.turn AS request_id, md5(u.text) AS query, (a.turn - u.turn)::INT AS rank, md5(a.text) AS answer
       FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - u.turn BETWEEN 1 AND 3 WHERE u.role = 'user'""",
)
def stream_rendezvous_hits(spark, folder):
    """Up to three hits a request, in two micro-batches: of half of the conversations the requests come first, of the others the
    responses; what came in the first comes again in the second."""
    turns = table(spark, folder, "conversations")
    key = F.concat_ws("#", F.col("conv_id").cast("string"), (F.col("turn") - F.col("rank")).cast("string"))
    when = sent_at()
    asked = turns.filter("role = 'user'").withColumn("rank", F.lit(0)).select(key.alias("request_id"), when.alias("ts"), F.md5("text").alias("query"), (F.col("conv_id") % 2).cast("int").alias("part"))
    heard = turns.withColumn("rank", F.explode(F.array(*map(F.lit, (1, 2, 3))))).filter("turn >= rank")
    heard = heard.select(key.alias("request_id"), when.alias("ts"), "rank", F.md5("text").alias("answer"), ((F.col("conv_id") + 1) % 2).cast("int").alias("part"))
    sides = [side.unionByName(side.filter("part = 0").withColumn("part", F.lit(1))) for side in (asked, heard)]
    path, at = scratch_path(spark, "pairs"), scratch_path(spark, "state")
    requests, responses = (batches(spark, side, 2) for side in sides)
    finish(jobs.write_stream(state.rendezvous(requests, responses, "10 minutes", ["rank"]), path, at))
    return spark.read.parquet(path).select("request_id", "query", "rank", "answer")


def _streamed_parts(spark, folder, last):
    """Partial results in three micro-batches, a request's parts spread over all of them; with ``last``, a much later message."""
    rows = _parts(spark, folder).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows = rows.withColumn("part_no", F.pmod(F.xxhash64("request_id", "part"), F.lit(3)).cast("int"))
    if last:
        later = rows.limit(1).withColumns({"request_id": F.lit(-1).cast("long"), "ts": F.timestamp_seconds(F.lit(1_800_000_000)), "part_no": F.lit(3)})
        rows = rows.unionByName(later)
    path, at = scratch_path(spark, "merged"), scratch_path(spark, "state")
    source = batches(spark, rows.withColumnsRenamed({"part": "name", "part_no": "part"}), 4).withColumnRenamed("name", "part")
    finish(jobs.write_stream(state.reduce_parts(source, 5, 3, "10 minutes"), path, at))
    return spark.read.parquet(path)


@query("stream_reduce", SQL["reduce_parts"])
def stream_reduce(spark, folder):
    return _streamed_parts(spark, folder, False).filter("arrived is null").drop("arrived")


@query("stream_reduce_pending", SQL["reduce_pending"])
def stream_reduce_pending(spark, folder):
    """Requests of which parts are missing when their time is over."""
    return _streamed_parts(spark, folder, True).filter("arrived is not null").select("request_id", "arrived")


@query(
    "stream_search_newest",
    f"""WITH {ft()}, old AS (SELECT item_id AS request_id FROM benchmark WHERE item_id % 2 = 0),
        early AS (SELECT * FROM documents WHERE doc_id % 2 = 0),
        raw1 AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM early),
        post1 AS (SELECT term, doc_id, 0::INT AS "offset", count(*) AS tf FROM raw1 GROUP BY 1, 2),
        dfs1 AS (SELECT term, count(*) AS df FROM post1 GROUP BY 1), n1 AS (SELECT count(*) AS n FROM early),
        scored1 AS (SELECT q.request_id, p.doc_id, p."offset", sum(p.tf * ln((n1.n + 1) / (d.df + 1))) AS raw_score
                    FROM qt q JOIN post1 p ON q.term = p.term JOIN dfs1 d ON d.term = p.term CROSS JOIN n1 GROUP BY ALL),
        both_ AS (SELECT request_id, doc_id, "offset", raw_score FROM scored1 WHERE request_id IN (SELECT request_id FROM old)
                  UNION ALL SELECT request_id, doc_id, "offset", raw_score FROM scored WHERE request_id NOT IN (SELECT request_id FROM old)),
        {ranked("SELECT * FROM both_", 5)} SELECT * FROM best""",
)
def stream_search_newest(spark, folder):
    """Requests in two micro-batches; between them half of the documents are added, which only the second one finds."""
    docs = table(spark, folder, "documents", spread=True)
    path, hits, at = (scratch_path(spark, p) for p in ("growing", "hits", "state"))
    fulltext.build(C.unary_chunks(docs.filter("doc_id % 2 = 0")), path)
    asked = items(spark, folder).withColumn("part", (F.col("request_id") % 2).cast("int"))
    source = scratch_path(spark, "asked")
    for part in (0, 1):
        asked.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
        queries = jobs.read_files(spark, source, asked.drop("part").schema, "*.parquet")
        finish(jobs.search(queries, path, 5, hits, at, match="any"))
        if part == 0:
            fulltext.TextIndex(spark, path).add(C.unary_chunks(docs.filter("doc_id % 2 = 1")))
    return spark.read.parquet(hits).drop("batch_id")


@query("stream_train", f"{FITTED} SELECT 'SUCCESS' AS status, examples, round(intercept, 6) AS intercept, 'jaccard' AS feature, round(slope, 6) AS weight FROM line")
def stream_train(spark, folder):
    """The scorer after the last micro-batch, fitted to one feature without a penalty."""
    rows = _streamed_scorer(spark, folder, features=["jaccard"], reg=0.0)
    return rows.withColumns({c: F.round(c, 6) for c in ("intercept", "weight")})


@query("stream_train_all")
def stream_train_all(spark, folder):
    """The scorer after the last micro-batch, fitted to all features, term statistics among them, with the ridge."""
    return _streamed_scorer(spark, folder, stats=_idf(spark, folder))


def _streamed_scorer(spark, folder, **options):
    source, path, state = (scratch_path(spark, p) for p in ("records", "scorer", "state"))
    pairs = conversation_pairs(spark, folder)
    record = F.to_json(F.struct(F.col("query").alias("Query"), F.col("candidate").alias("Candidate"), F.col("label").alias("Label")))
    pairs.select(record.alias("value")).write.text(source)
    good, _ = examples.parse_train_records(spark.readStream.text(source))
    finish(jobs.train_scorer(good, path, state, **options))
    last = spark.read.parquet(f"{path}/status").orderBy(F.desc("step")).limit(1)
    return last.select("status", "examples", "intercept", F.explode("weights").alias("feature", "weight"))
