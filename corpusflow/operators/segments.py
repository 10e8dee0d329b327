"""Storage of the standing full-text index: immutable segments, and a manifest that names the live ones.

A segment holds, each in files sorted over all of them,

* ``chunks``: (doc_id, offset, seq, terms), the terms in order, by key;
* ``postings``: (tier, term, doc_id, offset, tf, positions), by tier, term and key; a chunk's tier is the power of two that its
  number of terms reaches, so that chunks of a tier can score about equally much;
* ``terms``: (term, tier, df, most), in how many chunks of a tier a term occurs and how often at most in one, a row for each file
  of postings that holds the term;
* ``zones``: for each of those files its smallest and largest sort key, so that a reader asks only for the files it needs.

Every change writes new folders and then a new manifest under the next version number, which appears in one step: readers see the state
before or after it, never between.  Chunks that a later write replaces stay in their segment; the manifest names a table of these
dead keys and of what they take from the terms' counts.  Segments of one size class are merged when enough have come
together, so their number grows with the logarithm of the number of writes; a merge leaves dead chunks out.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import packed
from corpusflow.operators.scale import small_enough
from corpusflow.session import freed_shuffles, materialize, scratch_path

KEY = ["doc_id", "offset"]
CHUNKS = "doc_id long, offset int, seq long, terms array<string>"
POSTINGS = "tier int, term string, doc_id long, offset int, tf int, positions array<int>"
TERMS = "term string, tier int, df long, most int"
ZONES = "kind string, file string, low_tier int, low_term string, low_doc_id long, high_tier int, high_term string, high_doc_id long, rows long"
#: Columns each kind of file is sorted by, and those of them that bound its zones.
SORTED = {"chunks": KEY, "postings": ["tier", "term", *KEY], "terms": ["term", "tier"]}
BOUNDS = {"chunks": ["doc_id"], "postings": ["tier", "term", "doc_id"], "terms": ["term"]}

#: Tokens of a file; files of a segment at most, beyond which they grow.
FILE_TOKENS, MOST_FILES = 500_000, 20_000
#: Segments of one size class that are merged into one; share of dead chunks at which all segments are.
FAN, DEAD_SHARE = 8, 0.25
#: Keys up to this number are compared with the zones on the driver; with more of them, all files are read.
LOOKUPS = 200_000
LEAST = -(2**63)
#: Postings sampled for the ends of each file, and in all at most.
SAMPLED, MOST_SAMPLED = 40, 100_000
#: Tokens grouped at a time inside a task.
SLICE_TOKENS = 2_000_000


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Segment:
    number: int
    name: str
    chunks: int
    tokens: int
    dead: int = 0

    @property
    def tier(self) -> int:
        """Size class: segments of a class differ by less than the factor ``FAN``."""
        tier, size = 0, max(1, self.chunks)
        while size >= FAN:
            tier, size = tier + 1, size // FAN
        return tier


@dataclass(frozen=True)
class Manifest:
    """A state of the index.  ``batch`` is the last streamed micro-batch in it."""

    version: int = 0
    segments: tuple[Segment, ...] = ()
    next: int = 0
    dead: str | None = None
    batch: int = -1

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def parse(text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(**found | {"segments": tuple(Segment(**s) for s in found["segments"])})


class Folder:
    """The shared folder of an index, by whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def manifest(self) -> Manifest:
        """The newest state; an empty one where there is none."""
        files, path = self._path("manifests")
        if not files.exists(path):
            return Manifest()
        versions = [s.getPath().getName() for s in files.listStatus(path)]
        versions = [int(name) for name in versions if name.isdigit()]
        return self.version(max(versions)) if versions else Manifest()

    def version(self, number: int) -> Manifest:
        files, path = self._path(f"manifests/{number}")
        stream = files.open(path)
        try:
            return Manifest.parse(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: Manifest) -> Manifest:
        """Make a state the newest in one step: written aside, then renamed to a version that must not be there yet."""
        files, aside = self._path(f"manifests/aside-{uuid.uuid4().hex}")
        _, path = self._path(f"manifests/{manifest.version}")
        stream = files.create(aside, False)
        stream.write(bytearray(manifest.text().encode()))
        stream.close()
        if files.exists(path) or not files.rename(aside, path):
            files.delete(aside, False)
            raise Conflict(f"version {manifest.version} of {self.path} is there already")
        return manifest

    def drop(self, name: str) -> None:
        files, path = self._path(name)
        files.delete(path, True)

    def names(self, name: str) -> list[str]:
        files, path = self._path(name)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


# ---------------------------------------------------------------------------------------------- writing


def grouped_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tier, term, doc_id, offset, tf, positions) of chunks, a slice of tokens at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // SLICE_TOKENS
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            some, lengths = batch.slice(start, end - start), sizes[start:end].astype(np.int64)
            words = some.column("terms").flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            both = row * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(both, kind="stable")
            ordered = both[order]
            first = np.flatnonzero(np.diff(ordered, prepend=-1))
            ends = np.append(first, len(order))
            owner = pa.array(row[order][first])
            term = words.dictionary.take(pa.array(ordered[first] % max(1, len(words.dictionary))))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
            tier = pa.array(np.frexp(lengths[row[order][first]])[1] - 1, pa.int32())
            columns = [tier, term, some.column("doc_id").take(owner), some.column("offset").take(owner), pa.array(np.diff(ends), pa.int32()), positions]
            yield pa.RecordBatch.from_arrays(columns, names=["tier", "term", *KEY, "tf", "positions"])


def _cuts(held: DataFrame, tokens: int, files: int) -> list[tuple]:
    """Sort keys (tier, term, doc_id) at which a segment's files of postings begin, but the first, from a sample."""
    share = min(1.0, 2 * min(files * SAMPLED, MOST_SAMPLED) / max(1, tokens))
    # Chunks are sampled, and then, where that leaves few of them, postings of more chunks.
    some = held if share ** 0.5 >= 1 else held.sample(share**0.5, seed=1)
    found = some.select(*KEY, "terms").mapInArrow(grouped_terms, POSTINGS).select("tier", "term", F.coalesce("doc_id", F.lit(LEAST)))
    rows = sorted(tuple(r) for r in (found if share**0.5 >= 1 else found.sample(share**0.5, seed=2)).collect())
    return sorted({rows[len(rows) * i // files] for i in range(1, files)}) if rows else []


def placed_terms(cuts: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``grouped_terms`` with ``part``, the file that a posting lies in: how many of the cuts are not above its key."""
    docs = np.array([c[2] for c in cuts], dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped_terms(batches):
            tier = batch.column("tier").to_numpy()
            words = batch.column("term").dictionary_encode()
            texts, width = words.dictionary.to_pylist(), int(tier.max(initial=0)) + 1
            slots, of = np.unique(words.indices.to_numpy().astype(np.int64) * width + tier, return_inverse=True)
            keys = [(int(s % width), texts[s // width]) for s in slots]
            low = np.array([bisect_left(cuts, (*k, LEAST)) for k in keys], dtype=np.int64)
            high = np.array([bisect_right(cuts, (*k, -LEAST)) for k in keys], dtype=np.int64)
            part = low[of]
            doc = pc.fill_null(batch.column("doc_id"), LEAST).to_numpy()
            # A term that goes over several files is cut by document.
            several = np.flatnonzero((high > low)[of])
            several = several[np.argsort(of[several], kind="stable")]
            for same in np.split(several, np.flatnonzero(np.diff(of[several])) + 1):
                if len(same):
                    begin, end = low[of[same[0]]], high[of[same[0]]]
                    part[same] = begin + np.searchsorted(docs[begin:end], doc[same], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    return place


def sorted_parts(cuts: list[tuple], keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with ``part``: how many of the cuts are not above their sort key.  A null number sorts first."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in keys]
            values = zip(*[(c if pa.types.is_string(c.type) else pc.fill_null(c.cast(pa.int64()), LEAST)).to_pylist() for c in columns])
            part = pa.array([bisect_right(cuts, v) for v in values], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=[*batch.schema.names, "part"])

    return place


def _write(rows: DataFrame, path: str, kind: str, files: int) -> None:
    """Write stored rows in ``files`` files that follow each other in sort order, their ends from a sample."""
    keys, ddl = SORTED[kind], {"chunks": CHUNKS, "terms": TERMS}[kind]
    rows = rows.select(*[c.split(" ")[0] for c in ddl.split(", ")])
    if files > 1:
        share = min(1.0, 2 * min(files * SAMPLED, MOST_SAMPLED) / max(1, rows.count()))
        some = rows.select(*[c if c == "term" else F.coalesce(F.col(c).cast("long"), F.lit(LEAST)) for c in keys])
        found = sorted(tuple(r) for r in (some if share == 1 else some.sample(share, seed=1)).collect())
        cuts = sorted({found[len(found) * i // files] for i in range(1, files)}) if found else []
        rows = packed.dealt(rows, sorted_parts(cuts, keys), ddl, files)
    else:
        rows = rows.coalesce(1)
    rows.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{kind}")


SPANS = f"{TERMS}, {ZONES}"


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted postings (file, tier, term, doc_id, tf) a row (term, tier, df, most) for each term of a tier in a file, and one with the
    file's ends and number of rows; where a batch ends inside of them there are several, to be added up."""
    schema = packed.arrow_schema(SPANS)
    for batch in batches:
        file, tier, term, doc, tf = (batch.column(c) for c in ("file", "tier", "term", "doc_id", "tf"))

        def starts(*columns: pa.Array) -> np.ndarray:
            new = np.zeros(batch.num_rows, dtype=bool)
            new[:1] = True
            for c in columns:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            return np.flatnonzero(new)

        if not batch.num_rows:
            continue
        first, files = starts(file, tier, term), starts(file)
        last, whole = np.append(files[1:], batch.num_rows) - 1, np.diff(files, append=batch.num_rows)
        at, low, high = pa.array(first), pa.array(files), pa.array(last)
        counted = [term.take(at), tier.take(at), pa.array(np.diff(first, append=batch.num_rows)), pa.array(np.maximum.reduceat(tf.to_numpy(), first))]
        ends = [pa.array(["postings"] * len(files)), file.take(low), *[c.take(side) for side in (low, high) for c in (tier, term, doc)], pa.array(whole)]
        yield pa.RecordBatch.from_arrays([*counted, *[pa.nulls(len(first), f.type) for f in schema][4:]], schema=schema)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(files), f.type) for f in schema][:4], *ends], schema=schema)


def write_segment(folder: Folder, terms: DataFrame, number: int, stored: bool = False) -> Segment:
    """Write chunks (doc_id, offset, seq, terms), each once, as a segment; ``stored`` says that they are read from stored ones."""
    # Two writers may prepare the same number; only one of them can publish it.
    name = f"{number}-{uuid.uuid4().hex[:8]}"
    spark, path = folder.spark, f"{folder.path}/segments/{name}"
    held = terms.select(*KEY, F.col("seq").cast("long").alias("seq"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    aside = Folder(spark, scratch_path(spark, "segment"))  # deleted as soon as the segment holds the same
    with freed_shuffles(spark):
        if not stored:
            # The texts may be costly to read and are needed several times.
            held = _aside(held, aside, "held")
        chunks, tokens = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        files = max(1, min(MOST_FILES, -(-tokens // FILE_TOKENS)))
        _write(held, path, "chunks", files)
        aside.drop("held")
        grouped = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select(*KEY, "terms")
        if files > 1:
            # Each text is cut into its postings once: a task knows the file of each of them from the cuts.
            postings = packed.dealt(grouped, placed_terms(_cuts(grouped, tokens, files)), POSTINGS, files, ["tier", "term"])
        else:
            postings = grouped.mapInArrow(grouped_terms, POSTINGS).coalesce(1)
        postings.sortWithinPartitions(*SORTED["postings"]).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        # What terms.parquet and the zones need of the postings is counted in one pass over the sorted files.
        rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        rows = rows.select(F.col("_metadata.file_name").alias("file"), "tier", "term", F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "tf")
        found = _aside(rows.mapInArrow(spans, SPANS), aside, "spans")
        _write(found.filter("file is null"), path, "terms", max(1, files // 16))
        low, high = (pick(F.struct(*[F.col(f"{side}_{c}").alias(c) for c in BOUNDS["postings"]])) for side, pick in (("low", F.min), ("high", F.max)))
        zones = found.filter("file is not null").groupBy("file").agg(low.alias("low"), high.alias("high"), F.sum("rows").alias("rows"))
        zones = zones.select(F.lit("postings").alias("kind"), "file", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("low", "high") for c in BOUNDS["postings"]], "rows")
        for kind, bounds in BOUNDS.items():
            if kind == "postings":
                continue
            rows, ends = spark.read.parquet(f"{path}/{kind}"), []
            for side, pick in (("low", F.min), ("high", F.max)):
                end = pick(F.struct(*bounds))
                for column, empty in (("tier", "int"), ("term", "string"), ("doc_id", "long")):
                    ends.append((end[column] if column in bounds else F.lit(None).cast(empty)).alias(f"{side}_{column}"))
            counts = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(*ends, F.count(F.lit(1)).alias("rows"))
            zones = zones.unionByName(counts.select(F.lit(kind).alias("kind"), "*"))
        zones.coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")
    aside.drop("spans")
    return Segment(number, name, chunks, tokens)


def _aside(rows: DataFrame, folder: Folder, name: str) -> DataFrame:
    """The rows written to a folder and read back from there."""
    rows.write.option("compression", "zstd").parquet(f"{folder.path}/{name}")
    return folder.spark.read.schema(rows.schema).parquet(f"{folder.path}/{name}")


# ---------------------------------------------------------------------------------------------- reading


def _number(kind: str) -> Column:
    """The segment a row was read from."""
    return F.regexp_extract("_metadata.file_path", rf"/segments/(\d+)-[0-9a-f]+/{kind}/", 1).cast("int")


@dataclass(frozen=True)
class State:
    """An index as one manifest describes it."""

    folder: Folder
    manifest: Manifest

    @property
    def spark(self) -> SparkSession:
        return self.folder.spark

    @property
    def size(self) -> int:
        """Live chunks."""
        return sum(s.chunks - s.dead for s in self.manifest.segments)

    @property
    def tokens(self) -> int:
        return sum(s.tokens for s in self.manifest.segments)

    @property
    def has_dead(self) -> bool:
        return self.manifest.dead is not None

    @cached_property
    def _zones(self) -> dict[tuple[int, str], list]:
        """Zones of each segment and kind in their order; a file holds ``FILE_TOKENS`` tokens, so they are few."""
        paths = [f"{self.folder.path}/segments/{s.name}/zones" for s in self.manifest.segments]
        if not paths:
            return {}
        rows = self.spark.read.schema(ZONES).parquet(*paths).withColumn("segment", _number("zones"))
        found: dict[tuple[int, str], list] = {}
        for r in rows.collect():
            found.setdefault((r["segment"], r["kind"]), []).append(r)
        for zones in found.values():
            zones.sort(key=lambda z: z["file"])
        return found

    def files(self, kind: str, segment: int, wanted: Sequence[tuple] | None = None) -> list[str]:
        """Paths of the files of a kind that may hold one of the sort keys (prefixes are tuples of one), or of all."""
        keys = None if wanted is None else sorted(wanted)
        name = next(s.name for s in self.manifest.segments if s.number == segment)
        out = []
        for z in self._zones.get((segment, kind), []):
            # A null document number sorts first.
            low, high = (tuple(LEAST if z[f"{side}_{c}"] is None else z[f"{side}_{c}"] for c in BOUNDS[kind]) for side in ("low", "high"))
            if keys is not None:
                width = len(keys[0]) if keys else 0
                at = bisect_left(keys, low[:width])
                if at == len(keys) or keys[at] > high[:width]:
                    continue
            out.append(f"{self.folder.path}/segments/{name}/{kind}/{z['file']}")
        return out

    @cached_property
    def tiers(self) -> list[int]:
        """All tiers that postings may have."""
        ends = [(z["low_tier"], z["high_tier"]) for (_, kind), zones in self._zones.items() if kind == "postings" for z in zones]
        return list(range(min(e[0] for e in ends), max(e[1] for e in ends) + 1)) if ends else []

    def share(self, kind: str, wanted: Sequence[tuple]) -> float:
        """Share of the rows of a kind that lie in files that may hold the wanted keys."""
        asked = {p.rsplit("/", 1)[1] for s in self.manifest.segments for p in self.files(kind, s.number, wanted)}
        zones = [z for (_, k), found in self._zones.items() if k == kind for z in found]
        return sum(z["rows"] for z in zones if z["file"] in asked) / max(1, sum(z["rows"] for z in zones))

    def read(self, kind: str, wanted: Sequence[tuple] | None = None, segments: Sequence[int] | None = None) -> DataFrame:
        """Rows of a kind with their ``segment``, dead ones included, from the files that may hold the wanted keys."""
        schema = {"chunks": CHUNKS, "postings": POSTINGS, "terms": TERMS}[kind]
        numbers = [s.number for s in self.manifest.segments] if segments is None else segments
        paths = [p for n in numbers for p in self.files(kind, n, wanted)]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.withColumn("segment", _number(kind))

    def documents(self, keys: DataFrame) -> list[tuple] | None:
        """Document numbers of some keys for ``files``; nothing if they are too many."""
        found = [(r[0],) for r in keys.select("doc_id").filter("doc_id is not null").distinct().limit(LOOKUPS + 1).collect()]
        return found if len(found) <= LOOKUPS else None

    def dead(self) -> DataFrame:
        """(segment, doc_id, offset) of replaced chunks."""
        schema = "segment int, doc_id long, offset int"
        return self.spark.read.schema(schema).parquet(f"{self.folder.path}/{self.manifest.dead}/keys") if self.has_dead else self.spark.createDataFrame([], schema)

    def dead_terms(self) -> DataFrame:
        """(segment, term, tier, df): in how many dead chunks of a segment and tier a term occurs."""
        schema = "segment int, term string, tier int, df long"
        return self.spark.read.schema(schema).parquet(f"{self.folder.path}/{self.manifest.dead}/terms") if self.has_dead else self.spark.createDataFrame([], schema)

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows with (segment, doc_id, offset) that no later write replaced."""
        if not self.has_dead:
            return rows
        dead = self.dead()
        return rows.join(F.broadcast(dead) if small_enough(dead) else dead, ["segment", *KEY], "left_anti")


# ---------------------------------------------------------------------------------------------- changing


def add(state: State, terms: DataFrame, batch: int | None = None) -> State:
    """The state after a write of chunks (doc_id, offset, seq, terms).

    Of a key's writes the one of highest ``seq`` is live, of equal ``seq`` the last.  A streamed ``batch`` already in the index
    is not written again.
    """
    manifest = state.manifest
    if batch is not None and batch <= manifest.batch:
        return state
    segment = write_segment(state.folder, terms, manifest.next)
    grown = replace(
        manifest, version=manifest.version + 1, segments=(*manifest.segments, segment), next=segment.number + 1, batch=manifest.batch if batch is None else batch
    )
    if manifest.segments:
        grown = _bury(State(state.folder, grown), state, segment)
    return compact(State(state.folder, state.folder.publish(grown)))


def _bury(grown: State, before: State, new: Segment) -> Manifest:
    """The manifest with a dead table that also holds what the new segment and the older ones replace of each other."""
    columns = [*KEY, "seq", "segment"]
    fresh = grown.read("chunks", segments=[new.number]).select(*columns)
    # The new segment's keys say which files of the older ones can hold the same.
    low, high = fresh.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return grown.manifest
    older = before.live(before.read("chunks").select(*columns).filter(F.col("doc_id").between(low, high)))
    met = older.join((F.broadcast(fresh) if small_enough(fresh) else fresh).withColumnsRenamed({"seq": "new_seq", "segment": "new_segment"}), KEY)
    loser = F.when(F.col("new_seq") >= F.col("seq"), F.col("segment")).otherwise(F.col("new_segment"))
    lost = materialize(met.select(loser.alias("segment"), *KEY), "lost")
    if lost.isEmpty():
        return grown.manifest
    return _with_dead(grown, before.dead().unionByName(lost), before.dead_terms().unionByName(_terms_of(grown, lost)))


def _terms_of(state: State, keys: DataFrame) -> DataFrame:
    """(segment, term, tier, df) of some chunks."""
    sent = F.broadcast(keys) if small_enough(keys) else keys
    rows = state.read("chunks", state.documents(keys)).join(sent, ["segment", *KEY], "left_semi")
    tier = F.floor(F.log2(F.size("terms").cast("double"))).cast("int").alias("tier")
    tokens = rows.filter(F.size("terms") > 0).select("segment", tier, F.explode(F.array_distinct("terms")).alias("term"))
    return tokens.groupBy("segment", "term", "tier").agg(F.count(F.lit(1)).alias("df"))


def _with_dead(state: State, keys: DataFrame, terms: DataFrame) -> Manifest:
    name = f"dead/{uuid.uuid4().hex}"
    keys.write.parquet(f"{state.folder.path}/{name}/keys")
    terms.groupBy("segment", "term", "tier").agg(F.sum("df").alias("df")).write.parquet(f"{state.folder.path}/{name}/terms")
    counts = dict(state.spark.read.parquet(f"{state.folder.path}/{name}/keys").groupBy("segment").count().collect())  # a row per segment
    segments = tuple(replace(s, dead=counts.get(s.number, 0)) for s in state.manifest.segments)
    return replace(state.manifest, segments=segments, dead=name)


def compact(state: State, everything: bool = False) -> State:
    """Merge the segments of each size class that has ``FAN`` of them, or, with too many dead chunks or if told to, all."""
    while True:
        segments = state.manifest.segments
        total, dead = sum(s.chunks for s in segments), sum(s.dead for s in segments)
        if (everything and (len(segments) > 1 or dead)) or (len(segments) > 1 and dead > DEAD_SHARE * total):
            chosen = list(segments)
        else:
            tiers: dict[int, list[Segment]] = {}
            for s in segments:
                tiers.setdefault(s.tier, []).append(s)
            chosen = next((t for _, t in sorted(tiers.items()) if len(t) >= FAN), [])
        if not chosen:
            return state
        state, everything = _merge(state, chosen), False


def _merge(state: State, chosen: list[Segment]) -> State:
    """The state with one segment of the live chunks of some others in their place."""
    manifest, numbers = state.manifest, [s.number for s in chosen]
    rows = state.live(state.read("chunks", segments=numbers))
    merged = write_segment(state.folder, rows.select(*KEY, "seq", "terms"), manifest.next, stored=True)
    kept = tuple(s for s in manifest.segments if s.number not in numbers)
    after = replace(manifest, version=manifest.version + 1, segments=(*kept, merged), next=merged.number + 1, dead=None)
    if any(s.dead for s in kept):
        others = ~F.col("segment").isin(numbers)
        after = _with_dead(State(state.folder, after), state.dead().filter(others), state.dead_terms().filter(others))
    return State(state.folder, state.folder.publish(after))


def vacuum(state: State, keep: int = 1) -> None:
    """Delete what the last ``keep`` versions do not name.  Readers of older versions fail afterwards."""
    folder, newest = state.folder, state.folder.manifest().version
    named = [folder.version(v) for v in range(max(1, newest - keep + 1), newest + 1) if str(v) in folder.names("manifests")]
    live = {s.name for m in named for s in m.segments}
    for name in folder.names("segments"):
        # A number not given out yet is being written.
        if name not in live and int(name.split("-")[0]) < max(m.next for m in named):
            folder.drop(f"segments/{name}")
    for name in folder.names("dead"):
        if f"dead/{name}" not in {m.dead for m in named}:
            folder.drop(f"dead/{name}")
    for name in folder.names("manifests"):
        if name.isdigit() and int(name) <= newest - keep:
            folder.drop(f"manifests/{name}")
