"""Full-text index: standing tables of postings, TF-IDF search, and boolean terms given as tables.

An index is a folder of segments (``segments``): each call that adds chunks writes one, and a chunk added again replaces what earlier
ones hold of it.  A search reads the files that may hold its terms, and of these only what its best hits need: the counts of its
terms come from the index, candidates from the postings that a hit cannot do without, in tiers of about equally long chunks, and what
other terms add to them from the candidates' own chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import blocks
from corpusflow.operators import segments as S
from corpusflow.operators.scale import best_of, each, join_alike, salted_join, small_enough, top_k, wanted_hits
from corpusflow.operators.segments import KEY
from corpusflow.session import materialize, scratch_path

#: Tables of terms and clauses up to this size are sent to all tasks; larger ones are joined by shuffle.
QUERY_ROWS, QUERY_CHARS = 200_000, 8_000_000

#: A must term narrows a request down when its postings are at most this fraction of all the request's.
SELECTIVE = 16
#: Share of a request's postings, those that may add most first, from which its first threshold comes; and the postings, at least.
SEED_SHARE, SEED_LEAST = 0.05, 200
#: Matches (request, posting) up to this number are simply summed: thresholds cost several jobs, which less work does not repay.
#: A task adds up some tens of millions a second.
SUMMED = 5_000_000_000
#: Scores are compared with bounds with this margin (they are rounded to six places).
MARGIN = 1e-5


def stop_words(language: str = "english") -> list[str]:
    return StopWordsRemover.loadDefaultStopWords(language)


def analyze(text: Column, stem: Callable[[Column], Column] | None = None, stop: list[str] | None = None) -> Column:
    """Index terms of a text in order: tokens, without stop words, stemmed if asked."""
    terms = X.tokens(text)
    if stop:
        terms = F.filter(terms, lambda t: ~t.isin(stop))
    return F.transform(terms, lambda t: stem(t)) if stem else terms


def chunk_terms(chunks: DataFrame, **analysis) -> DataFrame:
    """(doc_id, offset, terms): the index terms of each chunk, in order."""
    return chunks.select(*KEY, analyze(F.col("text"), **analysis).alias("terms"))


def porter_terms(terms: DataFrame) -> DataFrame:
    """Replace all terms by Porter stems: inside the tasks, the stemmer running once per distinct term of a batch and of what a task
    remembers.  Rows of one key are one chunk, its terms in order of their places."""
    rows = terms.select(*KEY, "terms")
    again = materialize(rows.groupBy(*KEY).count().filter("count > 1").drop("count"), "repeated")
    if not again.isEmpty():
        # Only what is repeated is brought together.
        rows = materialize(rows, "tokens")
        repeated = join_alike(rows, again, KEY, "left_semi")
        rows = join_alike(rows, again, KEY, "left_anti").select(*KEY, "terms")
        stemmed = repeated.select(*KEY, "terms").mapInArrow(_stemmed, STEMMED)
        spread = stemmed.select(*KEY, F.posexplode_outer("terms").alias("pos", "stem"))
        ordered = F.sort_array(F.collect_list(F.when(F.col("stem").isNotNull(), F.struct("pos", "stem"))))
        merged = spread.groupBy(*KEY).agg(ordered.alias("s")).select(*KEY, F.col("s.stem").alias("terms"))
        return rows.mapInArrow(_stemmed, STEMMED).unionByName(merged)
    return rows.mapInArrow(_stemmed, STEMMED)


STEMMED = "doc_id long, offset int, terms array<string>"
#: Stems that a task remembers.
STEMS = 200_000


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, offset, terms) with the terms' stems; null terms are left out, null lists become empty."""
    known: dict[str, str] = {}
    for batch in batches:
        lists = batch.column("terms")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), sizes)
        if words.null_count:
            row, words = row[words.is_valid().to_numpy(zero_copy_only=False)], words.drop_null()
        words = words.dictionary_encode()
        if len(known) > STEMS:
            known.clear()
        stems = []
        for word in words.dictionary.to_pylist():
            if word not in known:
                known[word] = X.porter(word)
            stems.append(known[word])
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
        terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(stems, pa.string()).take(words.indices))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("offset"), terms], names=[*KEY, "terms"])


@dataclass(frozen=True)
class TextIndex:
    """A standing index below ``path`` as its newest manifest described it when it was opened; later writes do not show."""

    spark: SparkSession
    path: str

    @cached_property
    def state(self) -> S.State:
        folder = S.Folder(self.spark, self.path)
        return S.State(folder, folder.manifest())

    def _of(self, state: S.State) -> TextIndex:
        index = TextIndex(self.spark, self.path)
        index.__dict__["state"] = state
        return index

    @property
    def segments(self) -> list[int]:
        return [s.number for s in self.state.manifest.segments]

    @property
    def size(self) -> int:
        return self.state.size

    @property
    def chunks(self) -> DataFrame:
        """(doc_id, offset, n_terms, segment): the live form of each chunk."""
        return self.state.live(self.state.read("chunks")).select(*KEY, F.size("terms").alias("n_terms"), "segment")

    def postings(self, terms: DataFrame | None = None, small: bool | None = None) -> DataFrame:
        """(term, doc_id, offset, tf, positions) of all live chunks, or of the terms of a table (term) only.

        For given terms (of given tiers, if the table names them) only files between whose ends one of them lies are read.  ``small``
        says what is known of the table's size.
        """
        if terms is None:
            return self.state.live(self.state.read("postings")).select("term", *KEY, "tf", "positions")
        on = [c for c in ("tier", "term") if c in terms.columns]
        wanted = terms.select(*on).distinct()
        small = small_enough(wanted, "term", QUERY_ROWS, QUERY_CHARS) if small is None else small
        rows = self.state.read("postings", self._slots(wanted) if small else None)
        rows = rows.join(F.broadcast(wanted) if small else wanted, on, "left_semi")
        return self.state.live(rows).select("tier", "term", *KEY, "tf", "positions")

    def numbered(self, slots: DataFrame) -> DataFrame:
        """(slot, doc_id, offset, tier, tf) of the live postings of a small table ([tier, ]term, slot)."""
        on = [c for c in ("tier", "term") if c in slots.columns]
        rows = self.state.read("postings", self._slots(slots)).join(F.broadcast(slots), on)
        return self.state.live(rows).select("slot", *KEY, "tier", "tf")

    def _slots(self, terms: DataFrame) -> list[tuple]:
        """(tier, term) of a small table, in all tiers where it names none."""
        rows = [r.asDict() for r in terms.collect()]
        return [(t, r["term"]) for r in rows if r["term"] is not None for t in ([r["tier"]] if "tier" in r else self.state.tiers)]

    def _counts(self, terms: DataFrame | None, small: bool | None) -> DataFrame:
        """(term, tier, df, most) in parts that are to be added up, those of dead chunks below zero."""
        small = terms is not None and (small_enough(terms, "term", QUERY_ROWS, QUERY_CHARS) if small is None else small)
        names = [(r[0],) for r in terms.select("term").distinct().collect() if r[0] is not None] if small else None
        rows = self.state.read("terms", names).select("term", "tier", "df", "most")
        if self.state.has_dead:
            rows = rows.unionByName(self.state.dead_terms().select("term", "tier", (-F.col("df")).alias("df"), F.lit(0).alias("most")))
        if terms is not None:
            wanted = terms.select("term").distinct()
            rows = rows.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
        return rows

    def term_tiers(self, terms: DataFrame | None = None, small: bool | None = None) -> DataFrame:
        """(term, tier, df, most): in how many live chunks of a tier a term occurs, and how often at most in one (dead ones included)."""
        return self._counts(terms, small).groupBy("term", "tier").agg(F.sum("df").alias("df"), F.max("most").alias("most")).filter("df > 0")

    def term_stats(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df): in how many live chunks a term occurs."""
        return self._counts(terms, None).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def terms_of(self, keys: DataFrame) -> DataFrame:
        """(doc_id, offset, terms) of some live chunks, from the files that may hold their keys."""
        wanted, documents = keys.select(*KEY).distinct(), self.state.documents(keys)
        few = documents is not None and small_enough(wanted)
        rows = self.state.read("chunks", documents).join(F.broadcast(wanted) if few else wanted, KEY, "left_semi")
        return self.state.live(rows).select(*KEY, "terms")

    def add(self, chunks: DataFrame, seq: str | None = None, batch: int | None = None, **analysis) -> TextIndex:
        """The index with more chunks (doc_id, offset, text[, seq]); a chunk of the same key is replaced.

        Of a key given several times the one with the highest ``seq`` counts; without ``seq``, the last call does.  Segments are
        merged as they come together.  ``batch`` numbers streamed writes: one that is in the index already changes nothing.
        """
        rows = latest_chunks(chunks, seq) if seq else chunks
        return self.add_terms(rows.select(*KEY, analyze(F.col("text"), **analysis).alias("terms"), *([seq] if seq else [])), seq, batch)

    def add_terms(self, terms: DataFrame, seq: str | None = None, batch: int | None = None) -> TextIndex:
        """The same with terms (doc_id, offset, terms[, seq]); each key once."""
        number = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
        return self._of(S.add(self.state, terms.select(*KEY, "terms", number.alias("seq")), batch))

    def compact(self) -> TextIndex:
        """The index with all its live chunks in one segment, and nothing dead."""
        return self._of(S.compact(self.state, everything=True))

    def vacuum(self, keep: int = 1) -> None:
        """Delete files that only older manifests name."""
        S.vacuum(self.state, keep)


def build(chunks: DataFrame, path: str | None = None, seq: str | None = None, **analysis) -> TextIndex:
    """A standing index of chunks (doc_id, offset, text[, seq]) below ``path`` (a scratch folder if not given)."""
    return TextIndex(chunks.sparkSession, path or scratch_path(chunks.sparkSession, "fulltext")).add(chunks, seq, **analysis)


def build_terms(terms: DataFrame, path: str | None = None, seq: str | None = None) -> TextIndex:
    """The same from terms (doc_id, offset, terms[, seq])."""
    return TextIndex(terms.sparkSession, path or scratch_path(terms.sparkSession, "fulltext")).add_terms(terms, seq)


def latest_chunks(chunks: DataFrame, seq: str) -> DataFrame:
    """One row per (doc_id, offset): the chunk with the highest ``seq`` (of several of one seq, the greatest text)."""
    rows = chunks.groupBy(*KEY).agg(F.max(F.struct(seq, "text")).alias("m"))
    return rows.select(*KEY, "m.text", F.col(f"m.{seq}").alias(seq))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1))


def query_terms(queries: DataFrame, **analysis) -> DataFrame:
    """(request_id, term): the distinct terms of each query text."""
    return each(queries, F.array_distinct(analyze(F.col("text"), **analysis)), "term", ["request_id"])


def _weighted(clauses: DataFrame, index: TextIndex, small: bool | None = None) -> DataFrame:
    """The clause rows with their term's df and idf, its ``tiers`` (tier, df, most) and ``need``, the request's number of must terms.

    A term no chunk holds has df 0.
    """
    need = clauses.groupBy("request_id").agg(F.count_if(F.col("clause") == "must").alias("need"))
    stats = index.term_tiers(clauses, small).groupBy("term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("tier", "df", "most")).alias("tiers"))
    joined = clauses.join(stats, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return joined.withColumn("idf", idf(F.lit(index.size), F.col("df"))).join(need, "request_id")


COUNTED = ("must", "should", "must_not")


def _added(hits: DataFrame, *more: str) -> DataFrame:
    """Scores and numbers of clauses of all chunks from joined (clause, posting) rows."""
    kinds = [F.count_if(F.col("clause") == c).alias(f"n_{c}") for c in COUNTED]
    part = F.when(F.col("clause") != "must_not", F.col("tf") * F.col("idf"))
    return hits.groupBy("request_id", "need", *KEY, *more).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("score"), *kinds)


def _fitting(added: DataFrame) -> DataFrame:
    fits = "n_must = need AND n_must_not = 0 AND (need > 0 OR n_should > 0)"
    return added.filter(fits).drop("need", *[f"n_{c}" for c in COUNTED])


def _sums(hits: DataFrame) -> DataFrame:
    """Qualifying chunks from joined (clause, posting) rows."""
    return _fitting(_added(hits)).select("request_id", *KEY, "score")


def _asked(index: TextIndex, clauses: DataFrame, small: bool) -> DataFrame:
    """Joined (clause, posting) rows, in the tiers that the clauses name."""
    on = [c for c in ("tier", "term") if c in clauses.columns]
    rows = index.postings(clauses, small).select(*on, *KEY, "tf")
    if small:
        return rows.join(F.broadcast(clauses), on)
    slot = F.concat_ws(" ", *on)
    rows = materialize(rows.select(slot.alias("slot"), *KEY, "tf"), "postings")
    return salted_join(rows, clauses.withColumn("slot", slot), "slot").drop("slot")


def _in_blocks(
    index: TextIndex,
    clauses: DataFrame,
    wanted: DataFrame | None = None,
    by_tier: bool = False,
    low: DataFrame | None = None,
    rest: DataFrame | None = None,
    rarest: bool = False,
) -> DataFrame:
    """(request_id, doc_id, offset[, tier], score) of qualifying chunks for a small table of weighted clauses, [tier,] term by term.

    The postings are read and dealt out by chunk once, whichever requests ask for them, and added up by ``blocks``.  With ``wanted``
    (request_id, k) hits that cannot be among a request's best k stay in their task; ``low`` (request_id, low) is a score that its
    last hit has at least, ``rest`` (request_id, tier, rest) what a chunk of a tier may still get.
    ``rarest`` says that the candidates of a request are the postings of its rarest must term, as in ``_by_rarest``.
    """
    spark, on = index.spark, [c for c in ("tier", "term") if c in clauses.columns]
    rows = clauses.select("request_id", "clause", "idf", "need", "df" if rarest else F.lit(0).alias("df"), *on).collect()  # proven few
    number: dict = {}
    slots: dict[tuple, int] = {}
    for r in rows:
        number.setdefault(r["request_id"], len(number))
        slots.setdefault(tuple(r[c] for c in on), len(slots))
    need, more = np.zeros(len(number), dtype=np.int64), {}
    for r in rows:
        need[number[r["request_id"]]] = r["need"]
    kind = clauses.schema["request_id"].dataType.simpleString()
    ids = spark.createDataFrame([(i, n) for i, n in number.items()], f"request_id {kind}, request long")

    def values(table: DataFrame, *columns: str) -> list:
        return [tuple(r) for r in table.join(F.broadcast(ids), "request_id").select("request", *columns).collect()]  # a few rows per request

    if wanted is not None:
        more["wanted"] = np.zeros(len(number), dtype=np.int64)
        for request, k in values(wanted, "k"):
            more["wanted"][request] = k
    if low is not None:
        more["low"] = np.full(len(number), -np.inf)
        for request, least in values(low, "low"):
            more["low"][request] = least
    if rest is not None:
        tiers = index.state.tiers or [0]
        more["rest"], more["tier"] = np.zeros((len(number), len(tiers))), tiers[0]
        for request, tier, bound in values(rest, "tier", "rest"):
            more["rest"][request, tier - tiers[0]] = bound
    if rarest:
        first: dict = {}
        for r in rows:
            if r["clause"] == "must" and r["term"] is not None:
                first[r["request_id"]] = min(first.get(r["request_id"], (r["df"], r["term"])), (r["df"], r["term"]))
        more["rarest"] = [r["clause"] == "must" and first.get(r["request_id"], (0, None))[1] == r["term"] for r in rows]
    asked = blocks.asked(
        [slots[tuple(r[c] for c in on)] for r in rows], [number[r["request_id"]] for r in rows], [r["idf"] for r in rows], [r["clause"] for r in rows], need, MARGIN, **more
    )
    keys = [*KEY, *(["tier"] if by_tier else [])]
    named = spark.createDataFrame([(*slot, n) for slot, n in slots.items()], ", ".join(f"{c} {clauses.schema[c].dataType.simpleString()}" for c in on) + ", slot long")
    sent = spark.sparkContext.broadcast(vars(asked))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in blocks.hits(blocks.Asked(**sent.value), keys, batches):
            yield from found.select(["request", *keys, "score"]).combine_chunks().to_batches(max_chunksize=100_000)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = index.numbered(named).select("slot", *keys, "tf")
    postings = postings.dropna(subset=KEY) if rarest else postings
    dealt = postings.repartition(parts, *KEY).sortWithinPartitions(*keys, "slot")
    kinds = {"doc_id": "long", "offset": "int", "tier": "int"}
    found = dealt.mapInArrow(added, "request long, " + ", ".join(f"{c} {kinds[c]}" for c in keys) + ", score double")
    return found.join(F.broadcast(ids), "request").select("request_id", *keys, "score")


def _looked_up(index: TextIndex, candidates: DataFrame, clauses: DataFrame, small: bool) -> DataFrame:
    """(clause, posting) rows of candidates (request_id, doc_id, offset[, tier]) for the clauses, from the candidates' own chunks.

    A chunk's terms are counted once, whichever requests ask for it; only asked terms are counted.
    """
    words = clauses.select("term").distinct()
    tokens = each(index.terms_of(candidates), F.col("terms"), "term", KEY)
    tokens = tokens.join(F.broadcast(words) if small else words, "term", "left_semi")
    counts = tokens.groupBy(*KEY, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    on = [c for c in ("request_id", "tier") if c in candidates.columns]
    if small:
        return candidates.join(F.broadcast(clauses), on).join(counts, [*KEY, "term"])
    slot = F.concat_ws(" ", *on)
    wanted = salted_join(candidates.withColumn("slot", slot), clauses.withColumn("slot", slot).drop(*on), "slot").drop("slot")
    return wanted.join(counts, [*KEY, "term"])


def _by_rarest(index: TextIndex, weighted: DataFrame, small: bool) -> DataFrame:
    """Requests with a rare must term: its postings are the candidates; their own chunks say what other terms add."""
    rare = weighted.filter("clause = 'must'").groupBy("request_id").agg(F.min(F.struct("df", "term")).alias("r"))
    rare = materialize(rare.select("request_id", "r.term"), "rarest")
    stored = materialize(_asked(index, rare, small).select("request_id", *KEY), "candidates")
    return _sums(_looked_up(index, stored, weighted.drop("tiers"), small))


def _kth(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request_id, low): the score that a request's last wanted hit has so far; none where there are fewer."""
    most = wanted.agg(F.max("k")).first()[0] or 0
    ranked = top_k(hits, ["request_id"], [F.desc("score")], most, "rank").join(wanted, "request_id")
    return ranked.filter("rank = k").select("request_id", F.col("score").alias("low"))


def _best_any(index: TextIndex, weighted: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """Chunks that can be among the best ``k`` of requests without must terms, with their scores.

    Two rounds.  The postings that may add most to a request's scores, by tier and term, give its first threshold: so much its last
    hit has at least.  Terms of a tier that together cannot reach it, however often they occur in a chunk, find no hit by themselves
    and stay unread there; often that is a whole tier.  The others are read and raise the threshold.  Chunks that can still reach
    it get what the unread terms add from their own terms, or from the postings after all, if these are fewer.
    """
    plan = _plan(weighted)
    if small:
        plan = materialize(plan, "plan")
        first = _in_blocks(index, plan.filter("seed or clause = 'must_not'"), wanted, by_tier=True)
        plan = materialize(_unread(plan.join(_kth(first, wanted), "request_id", "left")), "plan")
        unread, low = plan.filter("unread"), plan.filter("low is not null").groupBy("request_id").agg(F.max("low").alias("low"))
        rest = None if unread.isEmpty() else unread.groupBy("request_id", "tier").agg(F.sum("bound").alias("rest"))
        partial = _in_blocks(index, plan.filter("not unread"), wanted, True, low, rest)
        if rest is None:
            return partial.drop("tier")
        partial = materialize(partial, "read")
    else:
        added = materialize(_added(_asked(index, plan.filter("seed or clause = 'must_not'"), small), "tier"), "seeds")
        plan = materialize(_unread(plan.join(_kth(_fitting(added), wanted), "request_id", "left")), "plan")
        more, unread = plan.filter("not seed and clause <> 'must_not' and not unread"), plan.filter("unread")
        if not more.isEmpty():
            both = added.unionByName(_added(_asked(index, more.drop("low", "unread", "seed"), small), "tier"))
            sums = [F.sum(c).alias(c) for c in ("score", *[f"n_{c}" for c in COUNTED])]
            added = materialize(both.groupBy("request_id", "need", *KEY, "tier").agg(*sums), "read")
        partial = _fitting(added)
        if unread.isEmpty():
            return partial.drop("tier")
    rest = unread.groupBy("request_id", "tier").agg(F.sum("bound").alias("rest"))
    able = partial.join(rest, ["request_id", "tier"], "left").join(_kth(partial, wanted), "request_id", "left")
    able = able.filter(F.col("low").isNull() | (F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("low") - MARGIN))
    able = materialize(able.select("request_id", *KEY, "tier", "score"), "able")
    postings = unread.select("term", "tier", "tier_df").distinct().agg(F.sum("tier_df")).first()[0] or 0
    keys = able.select("request_id", *KEY, "tier")
    if keys.select(*KEY).distinct().count() * index.state.tokens <= postings * max(1, index.size):
        late = _looked_up(index, keys, unread, small)
    else:
        late = _asked(index, unread, small).join(keys, ["request_id", *KEY], "left_semi")
    late = late.select("request_id", *KEY, (F.col("tf") * F.col("idf")).alias("score"))
    return able.drop("tier").unionByName(late).groupBy("request_id", *KEY).agg(F.sum("score").alias("score"))


def _plan(weighted: DataFrame) -> DataFrame:
    """A row per clause and tier with ``bound``, the most that it can add to a chunk's score, and ``seed``: whether it is among
    those of largest bound that hold a share of the request's postings."""
    wanted = F.col("clause") != "must_not"
    rows = weighted.select("request_id", "clause", "term", "idf", "need", F.explode("tiers").alias("t"))
    bound = F.when(wanted, F.col("idf") * F.col("t.most")).otherwise(0.0)
    rows = rows.select("request_id", "clause", "term", "idf", "need", "t.tier", F.col("t.df").alias("tier_df"), bound.alias("bound"))
    largest = Window.partitionBy("request_id").orderBy(wanted.desc(), F.desc("bound"), "term", "tier").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("request_id")
    before, total = F.coalesce(F.sum("tier_df").over(largest), F.lit(0)), F.sum(F.when(wanted, F.col("tier_df")).otherwise(0)).over(all_)
    return rows.withColumn("seed", wanted & (before <= F.greatest(total * SEED_SHARE, F.lit(SEED_LEAST))))


def _unread(plan: DataFrame) -> DataFrame:
    """The plan with ``unread``: terms of a tier, those of smallest bound first, that together stay below the request's threshold
    ``low``."""
    open_ = (~F.col("seed")) & (F.col("clause") != "must_not")
    least = Window.partitionBy("request_id", "tier").orderBy(F.when(open_, 0).otherwise(1), "bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    together = F.sum(F.when(open_, F.col("bound")).otherwise(0.0)).over(least)
    return plan.withColumn("unread", F.coalesce(open_ & (together < F.col("low") - MARGIN), F.lit(False)))


def read_share(index: TextIndex, clauses: DataFrame, k: int) -> float:
    """Share of the clauses' postings that a search of requests without must terms reads as postings (for reports)."""
    weighted = materialize(_weighted(clauses, index, True), "clauses")
    wanted = weighted.select("request_id").distinct().withColumn("k", F.lit(k))
    plan = _plan(weighted)
    added = _added(_asked(index, plan.filter("seed or clause = 'must_not'"), True), "tier")
    rows = _unread(plan.join(_kth(_fitting(added), wanted), "request_id", "left"))
    slots = rows.groupBy("term", "tier").agg(F.max("tier_df").alias("df"), F.every("unread").alias("unread"))
    read, total = slots.agg(F.sum(F.when(~F.col("unread"), F.col("df"))), F.sum("df")).first()
    return (read or 0) / max(1, total or 0)


def score(index: TextIndex, clauses: DataFrame, wanted: DataFrame | None = None, stored: bool = False, plan: str | None = None) -> DataFrame:
    """TF-IDF of qualifying chunks: (request_id, doc_id, offset, score).

    ``clauses`` is a table (request_id, clause, term), each row once, clause in must / should / must_not.
    A chunk qualifies when it holds all must terms (or, without must terms, at least one should term)
    and no must_not term.  The score is the sum of tf * ln((N+1)/(df+1)) over the must and should rows it holds.
    ``stored`` says that they are a stored table.  ``plan`` (``sums`` or ``bounds``) says how requests without must terms are
    answered, by default the number of their matches does.  With ``wanted`` (request_id, k) chunks that cannot be among a request's best k may be left out.
    Only files that may hold the clauses' terms are read; document frequencies are kept by the index.
    """
    clauses = clauses if stored else materialize(clauses, "asked")
    small = small_enough(clauses, "term", QUERY_ROWS, QUERY_CHARS)
    weighted = materialize(_weighted(clauses, index, small), "clauses")
    # A request whose rarest must term is rare against all its postings is answered from the chunks with
    # that term; one without must terms from the terms its best hits need; any other by summing its postings.
    requests = weighted.groupBy("request_id").agg(
        F.min(F.when(F.col("clause") == "must", F.col("df"))).alias("rarest"), F.sum("df").alias("total")
    )
    way = F.when(F.col("rarest") * SELECTIVE <= F.col("total"), "rare").when(F.col("rarest").isNull() & F.lit(wanted is not None), "best").otherwise("sums")
    requests = requests.select("request_id", way.alias("way"), "total", "rarest")
    counts = {r["way"]: r for r in requests.groupBy("way").agg(F.sum("total").alias("n"), F.sum("rarest").alias("rarest")).collect()}  # three rows at most
    found = {way: r["n"] for way, r in counts.items()}
    whole = False
    if small and "rare" in found:
        # Candidates' chunks are read whole; where that is more than the postings of all the requests' terms, these are added up.
        terms = weighted.join(requests.filter("way = 'rare'"), "request_id", "left_semi").select("term", "df").distinct()
        postings = terms.agg(F.sum("df")).first()[0] or 0
        whole = min(counts["rare"]["rarest"] * index.state.tokens / max(1, index.size), index.state.tokens) > postings
    if "best" in found and plan != "bounds" and (plan == "sums" or found["best"] <= SUMMED):
        requests = requests.withColumn("way", F.when(F.col("way") == "best", "sums").otherwise(F.col("way")))
        found["sums"] = found.get("sums", 0) + found.pop("best")
    ways = set(found) or {"sums"}
    requests = materialize(requests, "ways") if len(ways) > 1 else requests
    results = []
    for name in sorted(ways):
        rows = weighted.join(requests.filter(F.col("way") == name).select("request_id"), "request_id", "left_semi") if len(ways) > 1 else weighted
        if name == "rare" and whole:
            results.append(_in_blocks(index, rows, wanted, rarest=True))
        elif name == "rare":
            results.append(_by_rarest(index, rows, small))
        elif name == "best":
            results.append(_best_any(index, rows, wanted, small))
        elif small:
            results.append(_in_blocks(index, rows, wanted))
        else:
            results.append(_sums(_asked(index, rows.drop("tiers"), small)))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found


def best_hits(scored: DataFrame, k: int | None, requests: DataFrame | None = None) -> DataFrame:
    """Top k chunks per request by score rounded to six places, then key; without ``k``, each request's own ``top_k``."""
    rounded = scored.withColumn("score", F.round("score", 6))
    best = best_of(rounded, requests, [F.desc("score"), F.asc("doc_id"), F.asc("offset")], k)
    return best.select("request_id", "rank", *KEY, F.lit(1.0).alias("weight"), "score")


def search(index: TextIndex, queries: DataFrame, k: int | None = None, match: str = "all", plan: str | None = None, **analysis) -> DataFrame:
    """Top k chunks per query text: (request_id, rank, doc_id, offset, weight 1.0, score).

    Without ``k`` each request's own ``top_k`` column counts.  ``match='all'`` needs every distinct term of the query
    in the chunk, ``'any'`` at least one.  ``plan`` as in ``score``.
    """
    clause = {"all": "must", "any": "should"}[match]
    clauses = materialize(query_terms(queries, **analysis).withColumn("clause", F.lit(clause)).distinct(), "clauses")
    return best_hits(score(index, clauses, wanted_hits(clauses if k is not None else queries, k)[0], True, plan), k, queries)


def bool_search(index: TextIndex, clauses: DataFrame, k: int | None, requests: DataFrame | None = None, plan: str | None = None) -> DataFrame:
    """Top k chunks per request of boolean clauses (request_id, clause, term)."""
    clauses = materialize(clauses.select("request_id", "clause", "term").distinct(), "clauses")
    return best_hits(score(index, clauses, wanted_hits(clauses if k is not None else requests, k)[0], True, plan), k, requests)


def phrase_search(index: TextIndex, phrases: DataFrame, k: int | None, **analysis) -> DataFrame:
    """Chunks holding the whole phrase, its terms adjacent and in order; ranked by TF-IDF of its terms.

    Chunks holding all terms are found first; their own terms tell whether a phrase stands in them.
    """
    phrase = analyze(F.col("text"), **analysis)
    placed = materialize(phrases.select("request_id", phrase.alias("phrase")).filter(F.size("phrase") > 0), "phrases")
    clauses = placed.select("request_id", F.explode("phrase").alias("term")).distinct().withColumn("clause", F.lit("must"))
    scored = materialize(score(index, clauses), "candidates")
    # Terms hold letters and digits only, so a blank separates them.
    line = F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" "))
    lines = index.terms_of(scored).select(*KEY, line.alias("line"))
    asked = placed.select("request_id", F.concat(F.lit(" "), F.array_join("phrase", " "), F.lit(" ")).alias("phrase"))
    met = scored.join(lines, KEY).join(asked, "request_id").filter(F.contains("line", "phrase"))
    return best_hits(met.select("request_id", *KEY, "score").distinct(), k, phrases)
