"""Near-duplicates by a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A signature holds one b-bit symbol per hash function and is split into chunks.  By the pigeonhole principle two
signatures that differ in fewer than ``(errors + 1) * chunks`` symbols have a chunk with at most ``errors`` of them, so
every chunk is indexed under each way of leaving ``errors`` symbols out: pairs below that distance meet in a bucket.

Buckets are never expanded into pairs.  All members of a bucket are tied to one centre, and the members tied to a
centre are resolved together from what sets them apart from it.  With D(x) the symmetric difference of x and the
centre c, |x ^ y| = |D(x) ^ D(y)|; and if x is not linked to c, a link of x and y needs a common element in D(x) and D(y)
(else the intersection of x and y is no larger than that of x and c, and the union no smaller).  So only elements
shared by several differences are looked up, and members linked to the centre are one component already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import map_slices, mixed, odd_numbers, sliced
from corpusflow.session import materialize

#: Symbols per chunk, symbols left out of a chunk, chunks, and bits per symbol.  Two sets of similarity 0.8 meet in no
#: bucket with probability (1 - 0.8**5 - 5 * 0.2 * 0.8**4) ** 10, about 2e-6.
CHUNK, ERRORS, CHUNKS, BITS = 5, 1, 10, 16
#: Shingles of one centre's members that a task takes at a time (twice); more are dealt to pairs of parts.
PART = 3_000_000


def word_codes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """64-bit codes of the words (runs without ASCII blanks, A-Z lower-cased)."""
    words = (text or "").encode().lower().split()
    if len(known) > 500_000:
        known.clear()
    code = xxhash.xxh64_intdigest
    try:
        codes = list(map(known.__getitem__, words))
    except KeyError:
        for word in words:
            if word not in known:
                known[word] = code(word)
        codes = list(map(known.__getitem__, words))
    return np.array(codes, dtype=np.uint64)


def shingle_set(codes: np.ndarray, size: int, multipliers: np.ndarray) -> np.ndarray:
    """The distinct shingles of ``size`` words, sorted; with fewer words the whole sequence as one; none without words."""
    n = len(codes)
    if not n:
        return codes
    width = min(size, n)
    total = np.full(n - width + 1, n if n < size else 0, dtype=np.uint64)
    for k in range(width):
        total += (codes[k : n - width + 1 + k] ^ (codes[k : n - width + 1 + k] >> np.uint64(31))) * multipliers[k]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The low bits of the smallest value under each hash function."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        low = np.minimum(low, (part[None, :] * multipliers[:, None]).min(axis=1))
    return (low >> np.uint64(64 - 32) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def set_number(shingles: np.ndarray) -> int | None:
    """A 64-bit name of a set (equal for unequal sets with a probability of 2**-64); none for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else None


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``key, row, n_shingles, number, signature``: a hash of the text, the set's size, its name, and its signature."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words, hashes, known = odd_numbers(size, 11), odd_numbers(CHUNK * CHUNKS, 13), {}

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            counts, numbers, signed = [], [], []
            with np.errstate(over="ignore"):
                for text in part.column("text").to_pylist():
                    shingles = shingle_set(word_codes(text, known), size, words)
                    counts.append(len(shingles))
                    numbers.append(set_number(shingles))
                    signed.append(signature(shingles, hashes).tobytes() if len(shingles) else None)
            columns = [part.column("key"), part.column("row"), pa.array(counts, pa.int64()), pa.array(numbers, pa.int64()), pa.array(signed, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["key", "row", "n_shingles", "number", "signature"])

        return one

    kind = dict(docs.dtypes)["key"]
    return map_slices(docs.withColumn("row", F.xxhash64("text")), make, f"key {kind}, row long, n_shingles long, number long, signature binary")


def bucket_keys(classes: DataFrame) -> DataFrame:
    """``bucket, number``: every chunk of every signature under each way of leaving symbols out."""
    keeps = [list(c) for c in combinations(range(CHUNK), CHUNK - ERRORS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick, salt = odd_numbers(CHUNK, 19), odd_numbers(CHUNKS * len(keeps), 29)
        for part in sliced(batches, "signature", 500_000):
            symbols = np.frombuffer(b"".join(part.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                buckets = np.stack([mixed((symbols[:, :, k] * pick[k]).sum(axis=2)) for k in keeps], axis=2).reshape(len(symbols), -1)
                buckets = mixed(buckets ^ salt)
            numbers = np.repeat(part.column("number").to_numpy(), buckets.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(buckets.reshape(-1).view(np.int64)), pa.array(numbers)], names=["bucket", "number"])

    return classes.select("number", "signature").mapInArrow(run, "bucket long, number long")


def ties(buckets: DataFrame) -> DataFrame:
    """``centre, number``: the members of each bucket of two or more, tied to one of them.

    The centre is the member that meets most others over all its buckets, so the buckets of a group of near copies
    agree on the copy that is nearest to the rest.  Counts are summed; no bucket is gathered or expanded.
    """
    dealt = buckets.repartition("bucket")
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(dealt.join(sizes, "bucket"), "buckets")
    meets = shared.groupBy("number").agg(F.sum("n").alias("meets"))
    ranked = shared.join(meets, "number")
    # Two sums instead of one ordered pair keep the aggregation free of sorting.
    most = ranked.groupBy("bucket").agg(F.max("meets").alias("most"))
    centres = ranked.join(most, "bucket").filter("meets = most").groupBy("bucket").agg(F.min("number").alias("centre"))
    return shared.select("bucket", "number").join(centres, "bucket").select("centre", "number").distinct()


def resolve(limit: tuple[int, int]) -> Callable[[pa.Table], pa.Table]:
    """Links among the members of one centre (a forest that connects what is linked), from their whole sets.

    ``limit`` (a, b): linked if b * |x & y| >= a * |x | y|, that is, (a + b) * |x ^ y| <= (b - a) * (|x| + |y|).
    """
    over, under = limit

    def links(part: pa.Table) -> pa.Table:
        centre, by_key = part.column("centre")[0].as_py(), dict(zip(part.column("number").to_pylist(), part.column("shingles").to_pylist()))
        keys, sets = list(by_key), [np.frombuffer(s, dtype=np.uint64) for s in by_key.values()]
        at = keys.index(centre)
        sizes = np.array(list(map(len, sets)), dtype=np.int64)
        apart = [np.setxor1d(s, sets[at], assume_unique=True) for s in sets]
        differ = np.array(list(map(len, apart)), dtype=np.int64)
        close = lambda away, a, b: (over + under) * away <= (under - over) * (a + b)
        root = np.arange(len(keys))
        root[close(differ, sizes, sizes[at])] = at
        found = [(at, i) for i in np.flatnonzero(root == at).tolist() if i != at]
        # Elements that several differences share, as lists of members.
        flat, owner = np.concatenate(apart), np.repeat(np.arange(len(keys)), differ)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        begins = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, dtype=np.int64)
        lengths = np.diff(np.concatenate((begins, [len(flat)])))
        shared = np.flatnonzero(lengths > 1)
        element, spread = np.repeat(shared, lengths[shared]), np.repeat(lengths > 1, lengths)
        member, place = owner[spread], np.concatenate(([0], np.cumsum(lengths[shared])))
        by_member = np.argsort(member, kind="stable")
        number = np.searchsorted(shared, element)[by_member]
        bounds = np.searchsorted(member[by_member], np.arange(len(keys) + 1))
        for i in np.flatnonzero(root != at).tolist():
            mine = number[bounds[i] : bounds[i + 1]]
            # A link leaves at most (under - over) / over of x outside of y, so enough of the difference must be shared.
            if not len(mine) or over * (differ[i] - len(mine)) > (under - over) * sizes[i]:
                continue
            near = np.concatenate([member[place[e] : place[e + 1]] for e in mine.tolist()])
            common = np.bincount(near, minlength=len(keys))
            away = differ[i] + differ - 2 * common
            linked = np.flatnonzero(close(away, sizes[i], sizes) & (common > 0) & (root != root[i]))
            for j in linked.tolist():
                if root[j] != root[i]:
                    found.append((i, j))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([keys[i] for i, _ in found], pa.int64()), "b": pa.array([keys[j] for _, j in found], pa.int64())})

    return links


def shingles_of(docs: DataFrame, size: int) -> DataFrame:
    """``number, shingles``: the whole sets, as binary."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words, known = odd_numbers(size, 11), {}

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            with np.errstate(over="ignore"):
                sets = [shingle_set(word_codes(t, known), size, words) for t in part.column("text").to_pylist()]
            columns = [pa.array(map(set_number, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["number", "shingles"])

        return one

    return map_slices(docs, make, "number long, shingles binary")


def components(links: DataFrame) -> DataFrame:
    """``number, root``: the smallest number reachable over links (a, b), for every number but the smallest of each component.

    Alternates two steps until nothing changes: every number hands the smallest one around it to its larger
    neighbours, then to its smaller ones.  Each round is written to the shared folder, so plans stay short and lost
    executors cost one round.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        edges = materialize(edges, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("number"), F.col("b").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        pairs = F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        edges = large.join(low, "a").select(F.explode(pairs).alias("e")).select("e.*").filter("a <> b").distinct()


def drop_near_duplicates(docs: DataFrame, size: int = 5, limit: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one document of each component: the one with the smallest key.

    Rows with a null key stay, as do rows that repeat a kept document's key and text.
    """
    found = near_duplicates(docs, size, limit, key, text, named=True).filter("not kept").select(F.col(key).alias("gone"), "row").distinct()
    gone = materialize(found, "gone")
    return docs.join(gone, (docs[key] == gone["gone"]) & (F.xxhash64(docs[text]) == gone["row"]), "left_anti")


def near_duplicates(docs: DataFrame, size: int = 5, limit: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text", named: bool = False) -> DataFrame:
    """Components of documents whose sets of ``size``-word shingles have a similarity of at least ``limit`` (a, b: a/b).

    One row per row: ``key``, ``n_shingles``, ``component_id`` (smallest key reachable, itself included), ``kept``
    (whether that is the row's own key).  Equal sets form one class first and are not compared one by one.
    Null and empty texts are linked with nothing.  Rows with a null key are in no component (null ``component_id``)
    and kept.  Rows that repeat a key are separate documents.  Other columns are ignored; no rows give no rows.
    With ``named`` there is also ``row``, a hash of the text.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    signed = materialize(signatures(source, size), "signatures")
    usable = signed.filter("number is not null and key is not null")
    classes = usable.groupBy("number").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")
    members = materialize(ties(bucket_keys(classes)), "ties")
    # Whole sets are made again, from the texts of the classes that met others, and travel only for those.
    known = members.select("number").distinct().join(classes.select("number", "key", "n_shingles"), "number")
    sets = shingles_of(source.join(known.select("key").distinct(), "key", "left_semi"), size)
    sets = materialize(sets.join(known.select("number"), "number", "left_semi"), "sets")
    sized = members.join(known.select("number", "n_shingles"), "number")
    parts = sized.groupBy("centre").agg(F.ceil(F.sum("n_shingles") / PART).cast("int").alias("parts"))
    dealt = sized.join(parts, "centre").withColumn("own", F.pmod(F.xxhash64("number"), "parts").cast("int"))
    # What fits one task stays together; more is dealt to all pairs of parts, and the centre to every pair.
    is_centre, count = F.col("number") == F.col("centre"), F.col("parts")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_centre, count * count).otherwise(count) - 1)))
    low = F.when(is_centre, F.floor(F.col("other") / count)).otherwise(F.least("own", "other")).cast("int")
    high = F.when(is_centre, F.pmod("other", "parts")).otherwise(F.greatest("own", "other")).cast("int")
    dealt = dealt.withColumn("low", low).withColumn("high", high).filter("low <= high").select("centre", "low", "high", "number")
    links = dealt.join(sets, "number").groupBy("centre", "low", "high").applyInArrow(resolve(limit), "a long, b long")
    found = components(links)
    # A component's name is its smallest document.
    rooted = classes.select("number", "key").join(found, "number", "left").withColumn("root", F.coalesce("root", "number"))
    rooted = materialize(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("key").alias("component_id"))
    by_set = rooted.select("number", "root").join(smallest, "root").select("number", "component_id")
    lone = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    result = signed.select("key", "row", "n_shingles", "number").join(by_set, "number", "left")
    result = result.select(F.col("key").alias(key), "n_shingles", lone.alias("component_id"), *(["row"] if named else []))
    return result.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


#: The same in SQL for four-word shingles: all pairs that share a shingle, and what can be reached over links.
SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS part FROM cut
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.part = b.part AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(x, y) AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, least(d.doc_id, coalesce(low, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY 1) m ON m.x = d.doc_id
"""
