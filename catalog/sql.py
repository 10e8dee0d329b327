"""Pieces shared by the SQL side of the queries."""


def tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '([\p{{L}}\p{{N}}]+)', 1)"


def sentences(text: str) -> str:
    split = rf"string_split_regex(regexp_replace({text}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')"
    return f"list_filter(list_transform({split}, lambda s: trim(s)), lambda s: s <> '')"


def sentence_rows(table: str, key: str, text: str = "text") -> str:
    """(key, offset, text): one row per sentence."""
    return f"""SELECT {key}, (i - 1)::INT AS "offset", ss[i] AS text
        FROM (SELECT {key}, ss, unnest(range(1, len(ss) + 1)) AS i
              FROM (SELECT {key}, {sentences(text)} AS ss FROM {table}))"""


#: Occurrences of pattern p in text t, overlapping ones included: a list of 1-based starts.
def starts(text: str, pattern: str) -> str:
    return (
        f"list_filter(range(1, length({text}) - length({pattern}) + 2), "
        f"lambda i: substr({text}, i, length({pattern})) = {pattern})"
    )


#: Benchmark items found in whole documents.
KEYWORD_HITS = f"""
  found AS (
    SELECT d.doc_id AS request_id, b.item_id AS doc_id, 0::INT AS "offset", 1.0::DOUBLE AS weight,
           length(b.text)::INT AS pattern_length, {starts('d.text', 'b.text')} AS pos
    FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
  hits AS (
    SELECT request_id, doc_id, "offset", weight, len(pos)::DOUBLE AS relevance,
           (pos[1] - 1 + pattern_length)::BIGINT AS first_end, pattern_length
    FROM found),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY request_id
      ORDER BY relevance DESC, first_end, pattern_length DESC, doc_id, "offset")::INT AS rank FROM hits)"""


def fulltext(terms: str = "term") -> str:
    """CTEs: postings of whole documents, df, benchmark query terms, and tf-idf of every shared chunk.

    ``terms`` is an expression over a raw token ``term``.
    """
    return f"""
  raw AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents),
  post AS (SELECT {terms} AS term, doc_id, 0::INT AS "offset", count(*) AS tf FROM raw GROUP BY 1, 2),
  dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
  nn AS (SELECT count(*) AS n FROM documents),
  qraw AS (SELECT item_id AS request_id, unnest({tokens('text')}) AS term FROM benchmark),
  qt AS (SELECT DISTINCT request_id, {terms} AS term FROM qraw),
  need AS (SELECT request_id, count(*) AS need FROM qt GROUP BY 1),
  scored AS (
    SELECT q.request_id, p.doc_id, p."offset", count(*) AS have,
           sum(p.tf * ln((nn.n + 1) / (d.df + 1))) AS raw_score
    FROM qt q JOIN post p ON q.term = p.term JOIN dfs d ON d.term = p.term CROSS JOIN nn
    GROUP BY ALL)"""


def ranked(source: str, k: int | str, name: str = "best") -> str:
    """CTE: top k (a number or an expression over request_id) of (request_id, doc_id, offset, raw_score)."""
    return f"""
  {name} AS (
    SELECT request_id, rank, doc_id, "offset", 1.0::DOUBLE AS weight, score FROM (
      SELECT *, round(raw_score, 6) AS score, row_number() OVER (PARTITION BY request_id
        ORDER BY round(raw_score, 6) DESC, doc_id, "offset")::INT AS rank FROM ({source}))
    WHERE rank <= {k})"""


ALL = "SELECT s.* FROM scored s JOIN need USING (request_id) WHERE have = need"
ANY = "SELECT * FROM scored"

#: Question-answer pairs of a conversation: the next turn is right (1), the third next is not (0).
PAIRS = """
  pairs AS (
    SELECT u.conv_id, u.turn, u.text AS query, a.text AS candidate,
           CASE WHEN a.turn = u.turn + 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS label
    FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn IN (u.turn + 1, u.turn + 3)
    WHERE u.role = 'user' AND a.role = 'assistant')"""
