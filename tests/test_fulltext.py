import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import fulltext as T
from corpusflow.operators import segments as S

WORDS = "the a of rose time summer winter eyes thou cats cat".split()


def make(seed=1, n=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def chunks(spark, texts):
    return spark.createDataFrame([(i // 2, i % 2, t) for i, t in enumerate(texts)], "doc_id long, offset int, text string")


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")


def tokens(text):
    return re.findall(r"\w+", text.lower())


def brute(texts, clauses):
    """Scores of every qualifying chunk, from the definition."""
    bags = [tokens(t) for t in texts]
    df = {w: sum(w in b for b in bags) for w in WORDS}
    out = {}
    for q in {c[0] for c in clauses}:
        kinds = {k: [t for r, c, t in clauses if r == q and c == k] for k in ("must", "should", "must_not")}
        for i, bag in enumerate(bags):
            if not all(t in bag for t in kinds["must"]) or any(t in bag for t in kinds["must_not"]):
                continue
            if not kinds["must"] and not any(t in bag for t in kinds["should"]):
                continue
            score = sum(bag.count(t) * math.log((len(bags) + 1) / (df.get(t, 0) + 1)) for t in kinds["must"] + kinds["should"])
            out[q, i // 2, i % 2] = round(score, 6)
    return out


def scores(df):
    return {(r["request_id"], r["doc_id"], r["offset"]): round(r["score"], 6) for r in df.collect()}


@pytest.mark.parametrize("selective", [0, 16, 10**6])
def test_boolean_scores(spark, monkeypatch, selective):
    """All ways of answering a request agree: by its rarest term (0), by sums (10**6), or as its terms suggest."""
    monkeypatch.setattr(T, "SELECTIVE", selective)
    texts = make()
    clauses = [
        (0, "must", "rose"), (0, "must", "the"), (1, "should", "time"), (1, "should", "cats"), (1, "must_not", "winter"),
        (2, "must", "eyes"), (2, "should", "of"), (2, "must_not", "a"), (3, "must", "absent"), (4, "should", "absent"),
        (5, "must", "thou"), (5, "should", "thou"),
    ]
    table = spark.createDataFrame(clauses, "request_id long, clause string, term string")
    got = scores(T.score(T.build(chunks(spark, texts)), table))
    assert got == pytest.approx(brute(texts, clauses))


@pytest.mark.parametrize("match,plan", [("all", None), ("any", "sums"), ("any", "bounds")])
def test_search_matches_brute_force(spark, match, plan):
    texts, asked = make(3), ["rose time", "the the of", "winter eyes cat", "nowhere"]
    clauses = [(q, {"all": "must", "any": "should"}[match], t) for q, text in enumerate(asked) for t in sorted(set(tokens(text)))]
    want = {}
    for (q, d, o), s in sorted(brute(texts, clauses).items(), key=lambda e: (e[0][0], -e[1], e[0][1:])):
        want.setdefault(q, []).append((d, o, s))
    rows = T.search(T.build(chunks(spark, texts)), queries(spark, asked), 3, match, plan).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["request_id"], r["rank"])):
        got.setdefault(r["request_id"], []).append((r["doc_id"], r["offset"], r["score"]))
    assert got == {q: hits[:3] for q, hits in want.items()}


def test_each_line_finds_itself(spark):
    rng = random.Random(2)
    lines = [f"line{i} " + " ".join(rng.choice(WORDS) for _ in range(5)) for i in range(98)]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)], "doc_id long, offset int, text string")
    hits = T.search(T.build(rows), queries(spark, lines), 1).collect()
    assert sorted((r["request_id"], r["doc_id"]) for r in hits) == [(i, i) for i in range(98)]


def test_postings_have_positions(spark):
    rows = T.build(chunks(spark, ["a rose is a rose", "rose"])).postings().collect()
    got = {(r["term"], r["doc_id"], r["offset"]): (r["tf"], r["positions"]) for r in rows}
    assert got == {("a", 0, 0): (2, [0, 3]), ("rose", 0, 0): (2, [1, 4]), ("is", 0, 0): (1, [2]), ("rose", 0, 1): (1, [0])}


@pytest.fixture
def small_files(monkeypatch):
    """Many small files, so that pruning shows at this size."""
    monkeypatch.setattr(S, "FILE_TOKENS", 12)


def test_search_reads_the_files_of_its_terms_only(spark, small_files):
    index = T.build(chunks(spark, make()))
    terms = spark.createDataFrame([("rose",)], "term string")
    found = index.postings(terms)
    files = index.state.files("postings", 0)
    assert len(files) > 5 and 0 < len(found.inputFiles()) < len(files) * 0.7
    assert found.count() == index.postings().filter("term = 'rose'").count() > 0
    assert 0 < index.state.share("postings", [(t, "rose") for t in index.state.tiers]) < 0.7 and index.state.share("postings", [(99, "rose")]) == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "regexp_extract_all" not in plan  # of the few terms
    # Chunks are found by key, too.
    keys = spark.createDataFrame([(3, 1), (17, 0)], "doc_id long, offset int")
    own = index.terms_of(keys)
    assert len(own.inputFiles()) < len(index.state.files("chunks", 0)) and sorted(r["doc_id"] for r in own.collect()) == [3, 17]


def test_best_hits_need_few_postings(spark, monkeypatch):
    """Requests of many terms: those that cannot make a hit stay unread, and the hits are those of the definition."""
    monkeypatch.setattr(T, "SEED_LEAST", 3)
    rng = random.Random(11)
    common = [f"common{i}" for i in range(12)]
    texts = [" ".join(rng.choice(common) for _ in range(rng.randint(5, 15))) + f" rare{i % 40} " * 3 for i in range(160)]
    asked = [" ".join([*common, f"rare{i}", f"rare{i + 1}"]) for i in range(6)]
    index = T.build(chunks(spark, texts))
    requests = queries(spark, asked).withColumn("top_k", F.lit(4))
    clauses = T.query_terms(requests).withColumn("clause", F.lit("should"))
    banned = spark.createDataFrame([(2, "must_not", "rare2"), (4, "must_not", "common3")], "request_id long, clause string, term string")
    clauses = clauses.unionByName(banned.select("request_id", "term", "clause")).join(banned.filter("clause = 'x'"), ["request_id", "term"], "left_anti")
    rows = [(r["request_id"], r["clause"], r["term"]) for r in clauses.collect()]
    monkeypatch.setattr("tests.test_fulltext.WORDS", sorted({w for t in texts for w in tokens(t)}))
    want = {}
    for (q, d, o), score in sorted(brute(texts, rows).items(), key=lambda e: (e[0][0], -e[1], e[0][1:])):
        want.setdefault(q, []).append((d, o, score))
    got = {}
    for r in sorted(T.bool_search(index, clauses, None, requests, "bounds").collect(), key=lambda r: (r["request_id"], r["rank"])):
        got.setdefault(r["request_id"], []).append((r["doc_id"], r["offset"], r["score"]))
    assert got == {q: hits[:4] for q, hits in want.items()}
    assert T.read_share(index, clauses.filter("clause = 'should'"), 4) < 0.6


def test_common_terms_come_from_chunks_or_postings(spark, monkeypatch):
    """Both ways to what unread terms add give the same scores."""
    monkeypatch.setattr(T, "SEED_LEAST", 1)
    texts = [f"the of a {'rose ' * (i % 7)} {'time ' * (i % 3)} unique{i % 9}" for i in range(60)]
    index = T.build(chunks(spark, texts))
    asked = queries(spark, ["the of a rose unique4", "time a unique2 unique3"])
    plain = sorted(map(tuple, T.search(index, asked, 5, "any", "bounds").collect()))
    assert plain == sorted(map(tuple, T.search(index, asked, 5, "any", "sums").collect())) and len(plain) == 10
    monkeypatch.setattr(S.State, "tokens", property(lambda self: 10**12))
    assert sorted(map(tuple, T.search(index, asked, 5, "any", "bounds").collect())) == plain


def test_segments_are_merged_as_they_come_together(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN", 3)
    texts = make(13, 24)
    index = T.build(chunks(spark, texts[:2]))
    for i in range(2, 24, 2):
        index = index.add(chunks(spark, texts[: i + 2]).filter(F.col("doc_id") == i // 2))
        assert len(index.segments) <= 2 + 2 * math.log(i + 2, 3)
    assert index.size == 24 and max(index.segments) > 11
    table = spark.createDataFrame([(0, "should", "rose"), (0, "should", "time")], "request_id long, clause string, term string")
    assert scores(T.score(index, table)) == pytest.approx(brute(texts, [tuple(r) for r in table.collect()]))
    # Nothing but the live segment is left after a whole merge and a clean-up.
    one = index.compact()
    one.vacuum()
    assert len(one.segments) == 1 and len(one.state.folder.names("segments")) == 1 and one.state.folder.names("dead") == []
    assert scores(T.score(T.TextIndex(spark, one.path), table)) == scores(T.score(one, table))


def test_dead_chunks_do_not_count(spark):
    texts = make(15, 20)
    index = T.build(chunks(spark, texts))
    for turn in range(2):
        changed = {i: f"eyes time {'rose ' * turn}" for i in range(0, 20, 5)}
        texts = [changed.get(i, t) for i, t in enumerate(texts)]
        index = index.add(spark.createDataFrame([(i // 2, i % 2, t) for i, t in changed.items()], "doc_id long, offset int, text string"))
    clauses = [(0, "should", "rose"), (0, "should", "eyes"), (1, "must", "time"), (1, "must", "eyes")]
    table = spark.createDataFrame(clauses, "request_id long, clause string, term string")
    want = {w: sum(w in tokens(t) for t in texts) for w in {w for t in texts for w in tokens(t)}}
    for form in (index, index.compact()):
        assert {r["term"]: r["df"] for r in form.term_stats().collect()} == want
        assert form.size == 20 == form.chunks.count() and scores(T.score(form, table)) == pytest.approx(brute(texts, clauses))
        assert T.search(form, queries(spark, ["rose"]), 9).filter("doc_id = 0 and offset = 0").count() == 1


def test_manifest_versions(spark):
    index = T.build(chunks(spark, ["a rose", "the rose"]))
    again = T.TextIndex(spark, index.path)
    assert again.segments == [0]
    more = index.add(chunks(spark, ["a rose", "the rose", "eyes"]).filter("doc_id = 1"), batch=7)
    # An opened index does not change; a new one sees the write; a writer that did not is refused; a batch counts once.
    assert index.size == again.size == 2 and T.TextIndex(spark, index.path).size == more.size == 3
    with pytest.raises(S.Conflict):
        again.add(chunks(spark, ["late"]))
    assert more.add(chunks(spark, ["twice"]), batch=7).segments == more.segments


def test_added_chunks_replace_earlier_ones(spark):
    texts = make(7, 30)
    index = T.build(chunks(spark, texts[:20]))
    index = index.add(chunks(spark, texts).filter("doc_id >= 10"))
    changed = {2: "rose rose summer", 25: "eyes"}
    update = spark.createDataFrame([(i // 2, i % 2, t) for i, t in changed.items()], "doc_id long, offset int, text string")
    index = index.add(update)
    final = [changed.get(i, t) for i, t in enumerate(texts)]
    assert index.segments == [0, 1, 2] and index.size == 30
    for text in ("rose", "summer eyes", "the of"):
        clauses = [(0, "should", t) for t in tokens(text)]
        table = spark.createDataFrame(clauses, "request_id long, clause string, term string")
        assert scores(T.score(index, table)) == pytest.approx(brute(final, clauses))


def test_seq_decides_between_writes(spark):
    rows = [(1, 0, "old rose", 1), (1, 0, "new eyes", 3), (2, 0, "rose", 2)]
    schema = "doc_id long, offset int, text string, seq int"
    index = T.build(spark.createDataFrame(rows, schema), seq="seq")
    index = index.add(spark.createDataFrame([(1, 0, "late rose", 2), (2, 0, "time", 9)], schema), seq="seq")
    got = {r["term"]: r["doc_id"] for r in index.postings().collect()}
    assert got == {"new": 1, "eyes": 1, "time": 2}


def test_each_request_has_its_own_top_k(spark):
    texts = ["rose " * (i + 1) for i in range(150)] + ["time"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, offset int, text string")
    asked = spark.createDataFrame([(1, "rose", 150), (2, "rose", 2), (3, "time", 5)], "request_id long, text string, top_k int")
    hits = T.search(T.build(rows), asked, match="any").groupBy("request_id").count().collect()
    assert {r["request_id"]: r["count"] for r in hits} == {1: 150, 2: 2, 3: 1}


def test_large_question_tables_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_ROWS", 0)
    texts = make()
    clauses = [(0, "must", "rose"), (0, "must", "the"), (1, "should", "time"), (1, "must_not", "winter"), (2, "must", "eyes")]
    table = spark.createDataFrame(clauses, "request_id long, clause string, term string")
    assert scores(T.score(T.build(chunks(spark, texts)), table)) == pytest.approx(brute(texts, clauses))


def test_phrase(spark):
    texts = ["the rose of summer", "summer rose of the", "of summer the rose of summer time", "rose  of, SUMMER"]
    rows = T.phrase_search(T.build(chunks(spark, texts)), queries(spark, ["rose of summer"]), 10).collect()
    assert {r["doc_id"] * 2 + r["offset"] for r in rows} == {0, 2, 3}


def test_stems_and_stop_words(spark):
    texts = ["the cats sat", "a cat sat", "dogs ran"]
    asked = queries(spark, ["cat"])
    plain = T.search(T.build(chunks(spark, texts)), asked, 5)
    stemmed = T.search(T.build(chunks(spark, texts), stem=X.s_stem), asked, 5, stem=X.s_stem)
    assert (plain.count(), stemmed.count()) == (1, 2)
    porter = T.porter_terms(T.chunk_terms(chunks(spark, ["running cats", "", "ran"]))).collect()
    assert sorted(r["terms"] for r in porter) == [[], ["ran"], ["run", "cat"]]
    kept = T.chunk_terms(chunks(spark, texts), stop=T.stop_words())
    assert sorted(r["terms"] for r in kept.collect()) == [["cat", "sat"], ["cats", "sat"], ["dogs", "ran"]]


def test_latest_chunk_replaces(spark):
    rows = spark.createDataFrame([(1, 0, "old", 1), (1, 0, "new", 2), (1, 1, "x", 1)], "doc_id long, offset int, text string, seq int")
    assert sorted(tuple(r) for r in T.latest_chunks(rows, "seq").collect()) == [(1, 0, "new", 2), (1, 1, "x", 1)]


def test_empty_sides(spark):
    none = T.build(chunks(spark, []))
    assert T.search(none, queries(spark, ["a"]), 3).collect() == []
    assert T.search(T.build(chunks(spark, ["a"])), queries(spark, []), 3).collect() == []
    with pytest.raises(KeyError):
        T.search(none, queries(spark, ["a"]), 3, match="some")
