"""Quality rules: repetition limits, and divergence of a text's letter classes and common words from its language.

Only DataFrame functions: a text's measures are array expressions over its own row, so nothing is exploded and
nothing is shuffled but one row of sums per language and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize

#: Common words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was as be with by",
    "fr": "de la le et les des en un une du dans est que qui pour par",
    "de": "der die und in den von zu das mit sich des auf für ist im dem",
    "es": "de la que el en y a los del se las por un para con no",
}
#: All of them once, the most frequent of each language first; a word counts as listed or with a capital.
WORDS = list(dict.fromkeys(w for ranked in zip(*[words.split() for words in COMMON_WORDS.values()]) for w in ranked))
FORMS = WORDS + [w.capitalize() for w in WORDS]

#: Blanks between words, as in the pattern ``[^\x20\x09-\x0D]+`` for words.
BLANKS = r"[ \x09-\x0D]+"
#: The other ASCII characters (neither letters, digits, blanks nor symbols), one by one: a pattern of single characters is
#: looked up in a table, one of ranges is compared range by range.
MARKS = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum() and chr(c) not in "#*$%&|<> \t\n\x0b\x0c\r")
WINDOW = 8
#: Largest Jensen-Shannon distance (0 to 1) to the nearest language, of letter classes and of common words, and the
#: number of words from which on each is judged: the histograms of shorter texts say too little.
MOST_CLASSES, CLASSES_FROM = 0.30, 50
MOST_WORDS, WORDS_FROM = 0.33, 100


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """One row per row: ``key``, ``lang``, counts for the rules, and the two histograms.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` are whole-text counts.
    ``classes`` counts letters a-z, A-Z, digits, blanks, symbols, other ASCII and other characters; ``common`` counts
    each of ``WORDS`` and, last, all other words.  Null texts count as empty; null keys and languages stay null.
    """
    base = docs.select(F.col(key).alias("key"), F.col(language).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    cut = base.withColumn("words", F.when(F.length(trimmed) > 0, F.split(trimmed, BLANKS)).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \x09-\x0D]"))
    found = cut.withColumns({"lines": lines, "n": F.size("words"), "runs": F.transform("words", lambda w: F.xxhash64(w))})
    # Hashes of one word, then of two, four and eight from each place on: a run and the one that follows it make the next.
    size = 1
    while size < WINDOW:
        rest = F.slice("runs", size + 1, F.greatest(F.col("n") - size, F.lit(0)))
        found = found.withColumn("runs", F.zip_with("runs", rest, lambda a, b: F.xxhash64(a, b)))
        size *= 2
    at = lambda array, i: F.get(F.col(array), i)
    windows = F.when(F.col("n") >= WINDOW, F.slice("runs", F.lit(1), F.col("n") - (WINDOW - 1)))
    found = found.withColumn("windows", windows).drop("runs")
    # Windows by hash, with their places: equal neighbours after sorting are the repeated ones.
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = found.withColumn(
        "placed", F.when(repeated, F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("code"), i.alias("at")))))
    )
    again = F.filter(
        "placed",
        lambda x, i: (x["code"] == at("placed", i - 1)["code"]) | (x["code"] == at("placed", i + 1)["code"]),
    )
    starts = placed.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["at"])))
    # A repeated window covers its words up to the next repeated window's first.
    covered = F.aggregate(
        F.transform("starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(at("starts", i + 1) - s, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    # Each listed word becomes one letter, so that counting a word is counting a letter.
    number = lambda w: F.pmod(F.array_position(F.array(*map(F.lit, FORMS)), w) - 1, F.lit(len(WORDS)))
    known = F.transform(F.filter("words", lambda w: w.isin(FORMS)), lambda w: F.char(number(w) + 32))
    counted = starts.withColumn("known", F.array_join(known, ""))
    per_word = [F.length("known") - F.length(F.replace(F.col("known"), F.lit(chr(32 + i)), F.lit(""))) for i in range(len(WORDS))]
    kept = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    counts = counted.select(
        "key",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        # What is rare in a text is counted, so that a pattern matches a few long runs; lower-case letters are the rest.
        kept(f"[^{MARKS}]+").alias("marks"),
        kept("[^A-Z]+").alias("upper"),
        kept("[^0-9]+").alias("digits"),
        kept(r"[\x00-\x7F]+").alias("other"),
        F.array(*[c.cast("long") for c in per_word]).alias("per_word"),
    )
    blanks = F.col("n_chars") - F.col("word_chars")
    lower = F.col("word_chars") - F.col("marks") - F.col("upper") - F.col("digits") - F.col("n_symbols") - F.col("other")
    listed = F.aggregate("per_word", F.lit(0).cast("long"), lambda total, x: total + x)
    return counts.select(
        F.col("key").alias(key),
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.array(lower, "upper", "digits", blanks, "n_symbols", "marks", "other").alias("classes"),
        F.concat("per_word", F.array(F.col("n_words") - listed)).alias("common"),
    )


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Histograms of all rows of each language with a word list, as shares: letter classes, common words.

    Rows with equal histograms (copies) count once, so a large group of copies does not become the reference.
    Languages without rows, or without words, are left out.
    """
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(7)] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    known = measured.filter(F.col("lang").isin(list(COMMON_WORDS))).select("lang", "classes", "common").distinct()
    found = {}
    for row in known.groupBy("lang").agg(*sums).collect():  # at most one row per word list
        classes, common = [row[f"c{i}"] for i in range(7)], [row[f"w{i}"] for i in range(len(WORDS) + 1)]
        if sum(classes) and sum(common):
            found[row["lang"]] = ([c / sum(classes) for c in classes], [c / sum(common) for c in common])
    return dict(sorted(found.items()))


def distance(histogram: str, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram of counts to shares; null for an empty histogram."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda s, x: s + x)
    shares = F.transform(histogram, lambda x: x / total)

    def part(p: Column, q: Column) -> Column:
        middle = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)

    terms = F.zip_with(shares, F.array(*[F.lit(x) for x in reference]), part)
    return F.when(total > 0, F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0))))


def judge(measured: DataFrame, known: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """The measures with ``class_distance`` and ``word_distance`` to the nearest language, ``base_failed`` and ``kept``.

    A text is kept if it passes the base rules and both distances, each from its number of words on.  The language of a
    row is not used: the nearest reference counts, for each distance by itself.
    """
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    nearest = lambda name, i: F.array_min(F.array(*[distance(name, r[i]) for r in known.values()])) if known else F.lit(None).cast("double")
    judged = measured.withColumns({"class_distance": nearest("classes", 0), "word_distance": nearest("common", 1), "base_failed": base_failed})
    far = lambda name, most, least: F.coalesce((F.col(name) > most) & (F.col("n_words") >= least), F.lit(False))
    verdict = ~F.col("base_failed") & ~far("class_distance", MOST_CLASSES, CLASSES_FROM) & ~far("word_distance", MOST_WORDS, WORDS_FROM)
    return judged.withColumn("kept", verdict)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """Measure all rows once, sum the languages' references over all of them, and judge every row.

    Empty tables give no rows; repeated rows are judged one by one; other columns are ignored.
    """
    measured = materialize(measures(docs, key, text, language), "rules")
    return judge(measured, references(measured))


#: The same in SQL: windows by their words, references and distances by bins.
SQL = rf"""
WITH cut AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), token AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM cut
), windowed AS (
  SELECT doc_id, place, string_agg(word, ' ') OVER ahead AS run, count(*) OVER ahead AS size FROM token
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), repeated AS (
  SELECT doc_id, place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS times FROM windowed WHERE size = {WINDOW}) WHERE times > 1
), covered AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(following - place, {WINDOW})))::BIGINT AS n
  FROM (SELECT *, lead(place) OVER (PARTITION BY doc_id ORDER BY place) AS following FROM repeated) GROUP BY 1
), counted AS (
  SELECT c.doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]'))) AS n_lines,
         len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')))) AS n_distinct,
         coalesce(v.n, 0) AS n_repeat_words, length(text) AS n_chars, length(regexp_replace(text, '[^a-z]+', '', 'g')) AS low, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS up,
         length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digit, length(regexp_replace(text, '[\x00-\x7F]+', '', 'g')) AS other,
         list_transform({WORDS!r}, lambda x: len(list_filter(words, lambda y: y = x OR y = upper(x[1]) || x[2:]))) AS listed
  FROM cut c LEFT JOIN covered v ON v.doc_id = c.doc_id
), histograms AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         [low, up, digit, n_chars - word_chars, n_symbols, word_chars - low - up - digit - n_symbols - other, other] AS classes,
         list_append(listed, n_words - list_sum(listed)) AS common FROM counted
), bins AS (
  SELECT doc_id, 'classes' AS kind, unnest(classes) AS c, unnest(range(len(classes))) AS bin FROM histograms
  UNION ALL SELECT doc_id, 'common', unnest(common), unnest(range(len(common))) FROM histograms
), known AS (
  SELECT DISTINCT lang, classes, common FROM histograms WHERE lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)})
), pieces AS (
  SELECT lang, 'classes' AS kind, unnest(classes) AS c, unnest(range(len(classes))) AS bin FROM known
  UNION ALL SELECT lang, 'common', unnest(common), unnest(range(len(common))) FROM known
), reference AS (
  SELECT lang, kind, bin, sum(c) / sum(sum(c)) OVER (PARTITION BY lang, kind) AS q FROM pieces GROUP BY lang, kind, bin
), shares AS (
  SELECT doc_id, kind, bin, c / nullif(sum(c) OVER (PARTITION BY doc_id, kind), 0) AS p FROM bins
), parts AS (
  SELECT doc_id, s.kind, lang, CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END AS part
  FROM shares s JOIN reference r ON r.kind = s.kind AND r.bin = s.bin WHERE p IS NOT NULL
), nearest AS (
  SELECT doc_id, min(d) FILTER (kind = 'classes') AS class_distance, min(d) FILTER (kind = 'common') AS word_distance
  FROM (SELECT doc_id, kind, lang, sqrt(greatest(sum(part) / 2, 0)) AS d FROM parts GROUP BY ALL) GROUP BY 1
)
SELECT h.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (n_lines - n_distinct)::BIGINT AS n_dup_lines, n_repeat_words,
       base_failed, NOT base_failed AND NOT coalesce(class_distance > {MOST_CLASSES} AND n_words >= {CLASSES_FROM}, false)
       AND NOT coalesce(word_distance > {MOST_WORDS} AND n_words >= {WORDS_FROM}, false) AS kept
FROM histograms h LEFT JOIN nearest d ON d.doc_id = h.doc_id
"""
