"""Grouping spelling variants by a bidirectional FM-index.

The vocabulary's words are written one after another between delimiters, and once more with every word reversed; both texts get an
FM-index (suffix ranks), which extends matches to the left in one and to the right in the other.  A word with one
error has either half intact.  The search schemes therefore match a half exactly, starting at its delimiter, and go on across
the other half allowing one error; what reaches the other delimiter is one word.

The vocabulary is dealt to shards by the intact half, so a word meets only shards that can hold its neighbours; a shard is one
task's index, of bounded size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import sliced
from corpusflow.session import materialize

#: Maximal runs of these letters are words (fixed by contract).
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Distinct words a task counts before it passes its counts on.
HELD_WORDS = 200_000
#: Index entries of a shard, about; a half shared by more words is split into cells of this size.
SHARD_WORDS = 40_000
#: Queries that are searched side by side.
QUERIES = 20_000

_LOWER = {c: c + 32 for c in range(65, 91)}


# ---------------------------------------------------------------------------------------------- words


def word_counts(docs: DataFrame, damage: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the occurrences of all words of whole texts, with A-Z lower-cased.

    With ``damage`` d, a word loses one letter in every document where d divides h, the crc32 of ``<key>:<word>``: its letter
    h % length.  Null texts have no words, null keys are written as nothing, every repeated row counts; words left empty
    are none.
    """
    source = docs.selectExpr(f"cast(`{key}` as string) as key", f"`{text}` as text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = regex.compile(LETTERS).findall
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for part in sliced(batches):
            for name, value in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                if not value:
                    continue
                lowered: dict[str, int] = {}
                for run, n in Counter(runs_of(value)).items():
                    low = run if run.islower() else run.translate(_LOWER)
                    lowered[low] = lowered.get(low, 0) + n
                if damage:
                    start = zlib.crc32(f"{name or ''}:".encode())
                    for low, n in lowered.items():
                        h = zlib.crc32(low.encode(), start)
                        if h % damage == 0:
                            at = h % len(low)
                            low = low[:at] + low[at + 1 :]
                        held[low] = held.get(low, 0) + n
                else:
                    for low, n in lowered.items():
                        held[low] = held.get(low, 0) + n
                if len(held) > HELD_WORDS:
                    yield out()
                    held = {}
        if held:
            yield out()

    counted = source.mapInArrow(count, "word string, n long").filter("word <> ''")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------------------------------------- index


def suffix_ranks(codes: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in their order, by doubling the compared length."""
    size, width = len(codes), 1
    rank = codes.astype(np.int64)
    while True:
        later = np.zeros(size, dtype=np.int64)
        later[: max(size - width, 0)] = rank[width:] + 1
        pair = rank * (size + int(rank.max()) + 2) + later
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == size - 1:
            return order
        width *= 2


def flat_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word starts and how long it is."""
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    return letters, np.cumsum(lengths) - lengths, lengths


class FMIndex:
    """Suffix ranks of distinct words between delimiters; intervals of ranks are extended to the left, many at once."""

    def __init__(self, words: list[str]):
        letters, starts, lengths = flat_letters(words)
        self.alphabet = np.unique(letters)
        self.sigma = len(self.alphabet) + 1  # letters are 1, 2, ...; the delimiter is 0
        text = np.zeros(len(letters) + len(words) + 1, dtype=np.int64)
        text[np.arange(len(letters)) + np.repeat(np.arange(1, len(words) + 1), lengths)] = np.searchsorted(self.alphabet, letters) + 1
        suffixes = suffix_ranks(text)
        self.before = text[suffixes - 1]  # the letter left of each suffix
        self.span = len(text) + 1
        # A letter's occurrences in `before`, ascending: the place of (letter, rank) among them is the rank after the step.
        order = np.argsort(self.before, kind="stable")
        self.steps = self.before[order] * self.span + order
        delimiters = np.cumsum(np.concatenate([[0], lengths + 1]))[: len(words)]
        number = np.full(len(text), -1, dtype=np.int64)
        number[delimiters] = np.arange(len(words))
        self.word = number[suffixes]  # the word that follows a suffix's delimiter

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """Letter numbers; letters that no word has get a number without occurrences."""
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at + 1, self.sigma)

    def extend(self, letter: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more letter to the left; empty where low equals high."""
        base = letter * self.span
        return np.searchsorted(self.steps, base + low), np.searchsorted(self.steps, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) of every letter that can stand left of the intervals, without the delimiter."""
        size = high - low
        wide = size > self.sigma
        many = np.flatnonzero(wide)
        owners, letters = [np.repeat(many, self.sigma - 1)], [np.tile(np.arange(1, self.sigma), len(many))]
        few = np.flatnonzero(~wide)
        count = size[few]
        rows = np.repeat(low[few] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pairs = np.unique(np.repeat(few, count) * (self.sigma + 1) + self.before[rows])
        owner, letter = pairs // (self.sigma + 1), pairs % (self.sigma + 1)
        owners.append(owner[letter > 0])
        letters.append(letter[letter > 0])
        return np.concatenate(owners), np.concatenate(letters)

    def one_error(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all index words one edit away from a query whose second half they share.

        Letters are taken from the last to the first.  The second half, with its delimiter, has to match; in the first half
        one letter may be replaced, missing or surplus.  A query of n letters has n // 2 in its second half.
        """
        letters, starts, lengths = flat_letters(words)
        codes, exact = self.codes(letters), lengths // 2
        total = int(np.count_nonzero(self.before == 0))
        query = np.arange(len(words))
        low, high = np.zeros(len(words), dtype=np.int64), np.full(len(words), total, dtype=np.int64)
        none = np.empty(0, dtype=np.int64)
        # States with one error: query and interval.  All states have taken the same number of letters.
        err, err_low, err_high = none, none, none
        found_query, found_word = [none], [none]
        for step in range(int(lengths.max(initial=0)) + 1):
            done = lengths[query] == step
            open_ = step >= exact[query]
            own = np.where(done, 0, codes[np.minimum(starts[query] + lengths[query] - 1 - step, len(codes) - 1)])
            # A surplus letter in the index word takes no letter of the query.
            at, letter = self.branches(low[open_], high[open_])
            at = np.flatnonzero(open_)[at]
            to_low, to_high = self.extend(letter, low[at], high[at])
            alive = to_low < to_high
            at, letter, to_low, to_high = at[alive], letter[alive], to_low[alive], to_high[alive]
            err, err_low, err_high = np.concatenate([err, query[at]]), np.concatenate([err_low, to_low]), np.concatenate([err_high, to_high])
            replaced = (letter != own[at]) & ~done[at]
            missing = open_ & ~done
            # Those with an error go on exactly.
            finished = lengths[err] == step
            next_letter = np.where(finished, 0, codes[np.minimum(starts[err] + lengths[err] - 1 - step, len(codes) - 1)])
            go_low, go_high = self.extend(next_letter, err_low, err_high)
            alive = go_low < go_high
            ends = np.flatnonzero(alive & finished)
            ends = ends[self.word[go_low[ends]] >= 0]  # nothing between two delimiters is no word
            found_query.append(err[ends])
            found_word.append(self.word[go_low[ends]])
            on = alive & ~finished
            states = [
                (err[on], go_low[on], go_high[on]),
                (query[at][replaced], to_low[replaced], to_high[replaced]),
                (query[missing], low[missing], high[missing]),
            ]
            err, err_low, err_high = (np.concatenate(column) for column in zip(*states))
            # Different edits may lead to one interval (a letter of a run of equal ones): it is followed once.
            order = np.lexsort((err_high, err_low, err))
            err, err_low, err_high = err[order], err_low[order], err_high[order]
            first = np.ones(len(err), dtype=bool)
            first[1:] = (err[1:] != err[:-1]) | (err_low[1:] != err_low[:-1]) | (err_high[1:] != err_high[:-1])
            err, err_low, err_high = err[first], err_low[first], err_high[first]
            # Those without an error, too; at the delimiter they end as the query itself.
            low, high = self.extend(own, low, high)
            alive = (low < high) & ~done
            query, low, high = query[alive], low[alive], high[alive]
            if not len(query) and not len(err):
                break
        pairs = np.unique(np.concatenate(found_query) * total + np.concatenate(found_word))
        return pairs // total, pairs % total


#: The halves that a search scheme matches exactly.
END, START = "end", "start"


class BidirectionalIndex:
    """FM-indexes of the words and of the reversed words, each made when a scheme first needs it."""

    def __init__(self, words: list[str]):
        self.words = words

    @cached_property
    def left(self) -> FMIndex:
        return FMIndex(self.words)

    @cached_property
    def right(self) -> FMIndex:
        return FMIndex([w[::-1] for w in self.words])

    def one_error_beside(self, queries: list[str], half: str) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs that differ by one edit outside the query's given half."""
        return self.left.one_error(queries) if half == END else self.right.one_error([q[::-1] for q in queries])

    def one_error(self, queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) numbers of all pairs that differ by one edit, once from each scheme that finds them."""
        for half in (END, START):
            yield self.one_error_beside(queries, half)


# ---------------------------------------------------------------------------------------------- search


def _halves(word: str, length: str) -> Column:
    """Keys of a word's outer parts: the n // 2 last and first letters that a query of n = ``length`` letters matches exactly."""
    kept = f"cast({length} div 2 as int)"
    return F.expr(f"array(xxhash64({length}, 'end', right({word}, {kept})), xxhash64({length}, 'start', left({word}, {kept})))")


def near_words(words: DataFrame, shard: int = SHARD_WORDS) -> DataFrame:
    """``word, near``: all pairs of distinct words (``word``) that differ by one inserted, deleted or replaced code point.

    A query's key is an intact half; an index word stands under the keys of queries one shorter, as long, and one longer.
    Keys are dealt to shards of about ``shard`` words.  A key of more words than that is a grid of cells of its own, words by
    queries.  Null and empty words have no neighbours; repeated words count once; no rows give no rows.
    """
    words = words.filter("word <> ''").select("word").distinct()
    sized = words.withColumn("size", F.length("word").cast("long"))
    lengths = F.explode(F.expr("array(size - 1, size, size + 1)"))
    stored = sized.withColumn("length", lengths).filter("length > 0").select("word", F.posexplode(_halves("word", "length")).alias("side", "key"))
    stored = stored.distinct()
    asked = sized.select("word", F.posexplode(_halves("word", "size")).alias("side", "key"))
    stored = materialize(stored, "halves")
    total = stored.count()
    shards = max(1, -(-total // (2 * shard)))  # of each side
    crowded = stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard)
    crowded = materialize(crowded.select("key", F.ceil(F.col("n") / shard).cast("int").alias("parts")), "crowded")
    alone = crowded.count() > 0

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows with the cell they meet in: shard, or key and place in the key's grid."""
        if not alone:
            return rows.select("word", "side", F.pmod("key", F.lit(shards)).alias("shard"), F.lit(0).alias("row"), F.lit(0).alias("column"))
        split = rows.join(crowded, "key", "left").withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        shard_of = F.when(F.col("parts").isNull(), F.pmod("key", F.lit(shards))).otherwise(F.col("key"))
        # A shard's number is far below a hash, but may equal one; the grid keeps them apart.
        grid = F.when(F.col("parts").isNull(), -1).otherwise(F.col(own)), F.when(F.col("parts").isNull(), -1).otherwise(F.col(other))
        return split.select("word", "side", shard_of.alias("shard"), grid[0].alias("row"), grid[1].alias("column"))

    cell = ["side", "shard", "row", "column"]
    index = dealt(stored, "own", "other").distinct()
    queries = dealt(asked, "other", "own").distinct()
    pairs = index.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(_search_shard, "word string, near string")
    return pairs.distinct()


def _search_shard(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
    """Pairs of the queries with the index words of one cell, in the direction of the half that the cell's keys name."""
    words, asked = index.column("word").to_pylist(), queries.column("word").to_pylist()
    empty = pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string())})
    if not words or not asked:
        return empty
    both, found = BidirectionalIndex(words), [empty]
    names = index.column("word").combine_chunks()
    # Long words one after another would make all others wait for their letters; alike lengths go together.
    asked.sort(key=len)
    for start in range(0, len(asked), QUERIES):
        some = asked[start : start + QUERIES]
        query, word = both.one_error_beside(some, START if key[0].as_py() else END)
        found.append(pa.table({"word": pa.array(some, pa.string()).take(pa.array(query)), "near": names.take(pa.array(word)).cast(pa.string())}))
    return pa.concat_tables(found)


def variants(docs: DataFrame, least_letters: int = 7, least: int = 2, ratio: int = 10, damage: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all documents with their spelling groups: ``word, form, root, n, n_near, form_n``.

    Words are those of ``word_counts`` with at least ``least_letters`` code points and ``least`` occurrences ``n``.  ``n_near``
    counts the words one edit away.  ``form`` is the one of these with most occurrences (ties: the smaller word), if it has
    ``ratio`` times the word's own or more, else null; ``root`` is where forms lead in the end, the word itself without a
    form.  Nulls, empty texts and repeated rows are as in ``word_counts``; other columns are ignored; no rows give no rows.
    """
    counted = word_counts(docs, damage, key, text)
    words = materialize(counted.filter((F.col("n") >= least) & (F.length("word") >= least_letters)), "words")
    pairs = materialize(near_words(words), "near")
    named = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = named.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    joined = words.join(best, "word", "left").withColumn("strong", -F.col("b.less") >= ratio * F.col("n"))
    formed = joined.select(
        "word",
        F.when(F.col("strong"), F.col("b.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("strong"), -F.col("b.less")).alias("form_n"),
    )
    formed = materialize(formed, "formed")
    roots = _roots(formed.filter("form is not null").select("word", F.col("form").alias("root")), formed, ratio)
    rooted = formed.join(roots, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame, formed: DataFrame, ratio: int) -> DataFrame:
    """The end of each word's chain of forms, by doubling the way covered.

    A form has ``ratio`` times the occurrences of its word, so the longest way is a logarithm of the largest count.
    """
    most, hops = formed.agg(F.max("n")).first()[0] or 1, 0
    while most >= ratio:
        most, hops = most // ratio, hops + 1
    covered = 1
    while covered < hops:
        links = materialize(links, "links")
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        covered *= 2
    return links


#: The same rows as ``variants(docs, damage=31)`` in DuckDB.  The checksum runs over the bytes of a word with a table made by its
#: rule; neighbours are found by deleting one letter: from one word (missing letter), or at one place from both (replaced letter).
SQL = r"""
WITH RECURSIVE bits AS (
    SELECT range AS i, 0 AS k, range AS v FROM range(256)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8
), crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
    SELECT word, n, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(line)), lambda i: ('0x' || substr(hex(encode(line)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda acc, b: xor(acc // 256, t[xor(acc % 256, b) + 1])), 4294967295) AS h
    FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || word AS line FROM runs), crc_table
), damaged AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed
), words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS MATERIALIZED (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT p.word, count(*) AS n_near, max(w.n) AS form_n, arg_min(p.near, (-w.n, encode(p.near))) AS form
    FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word
), formed AS MATERIALIZED (
    SELECT w.word, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, w.n, coalesce(b.n_near, 0) AS n_near,
        CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
), ways AS (
    SELECT word, form AS goal, 1 AS hop FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT ways.word, f.form, hop + 1 FROM ways JOIN formed f ON f.word = ways.goal WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(goal, hop) AS root FROM ways GROUP BY word)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM formed f LEFT JOIN roots r ON r.word = f.word
"""
