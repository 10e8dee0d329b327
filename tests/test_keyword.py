import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as contract
from corpusflow.operators import grams, keyword


def chunks(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, offset int, text string")


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")


def brute(texts, patterns):
    """{(query, pattern): (occurrences, first end)} by looking at every position."""
    out = {}
    for q, text in enumerate(texts):
        for p, pattern in enumerate(patterns):
            at = [i for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)]
            if at and pattern:
                out[q, p] = (len(at), at[0] + len(pattern))
    return out


def found(df):
    return {(r["request_id"], r["doc_id"]): (int(r["relevance"]), r["first_end"]) for r in df.collect()}


def test_overlaps_nesting_and_length_classes(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 9, 60, 300, 900)] + ["aaaa", "", "né😀né😀", "x" * 500]
    patterns = ["a", "aa", "ab", "aba", "né", "é😀", "x" * 70, "nothing"] + [texts[4][i : i + n] for i, n in ((3, 8), (100, 17), (200, 40), (300, 200))]
    got = found(keyword.match(queries(spark, texts), keyword.build_index(chunks(spark, patterns))))
    assert got == brute(texts, patterns)
    assert got[5, 1] == (3, 2)  # aa in aaaa


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.text("abc ", max_size=80), min_size=5, max_size=10),
    st.lists(st.text("abc ", min_size=1, max_size=12), min_size=5, max_size=10, unique=True),
)
def test_any_texts_agree_with_brute_force(spark, texts, patterns):
    index = keyword.build_index(chunks(spark, patterns))
    assert found(keyword.match(queries(spark, texts), index)) == brute(texts, patterns)


def test_each_line_finds_itself(spark):
    rng = random.Random(2)
    lines = sorted({" ".join(rng.choice(["rose", "thou", "summer", "eyes", "time"]) + str(rng.randrange(1000)) for _ in range(6)) for _ in range(98)})
    hits = keyword.search(queries(spark, lines), keyword.build_index(chunks(spark, lines)), 1).collect()
    assert sorted((r["request_id"], r["doc_id"]) for r in hits) == [(i, i) for i in range(len(lines))]
    assert all(r["weight"] == 1.0 and r["rank"] == 1 for r in hits)


def test_hot_patterns_and_copied_texts(spark):
    """A third of the texts are copies, and patterns share long beginnings."""
    head = "the same long beginning of very many lines, word for word, again and again and once more; "
    patterns = [head + f"ending number {i}" for i in range(40)]
    texts = [patterns[7] + " tail"] * 30 + [f"other {i}" for i in range(60)]
    got = found(keyword.match(queries(spark, texts), keyword.build_index(chunks(spark, patterns))))
    assert got == brute(texts, patterns)


def test_hit_order(spark):
    patterns = ["zz", "abcd", "cd", "ab", "bc"]
    hits = keyword.search(queries(spark, ["abcd zz zz"]), keyword.build_index(chunks(spark, patterns)), 10)
    # Most occurrences; then earliest end; then longest.
    assert [patterns[r["doc_id"]] for r in hits.orderBy("rank").collect()] == ["zz", "ab", "bc", "abcd", "cd"]


def test_index_last_key_wins(spark):
    rows = [(1, 0, "a", 1), (2, 0, "a", 3), (9, 0, "a", 2), (4, 1, "b", 1), (5, 0, "", 1)]
    index = keyword.build_index(spark.createDataFrame(rows, "doc_id long, offset int, text string, seq int"), "seq")
    assert sorted((r["text"], r["doc_id"], r["offset"], r["added"]) for r in index.collect()) == [("a", 2, 0, 3), ("b", 4, 1, 1)]
    assert tuple(keyword.index_stats(index).first()) == (2, 4)


def test_empty_sides(spark):
    none, some = chunks(spark, []), chunks(spark, ["a"])
    assert keyword.search(queries(spark, ["a"]), keyword.build_index(none), 3).collect() == []
    assert keyword.search(queries(spark, []), keyword.build_index(some), 3).collect() == []
    assert keyword.index_stats(keyword.build_index(none)).first()["size"] == 0


def test_types_are_checked(spark):
    with pytest.raises(TypeError):
        keyword.build_index(spark.createDataFrame([(1, 0, 5)], "doc_id long, offset int, text int"))
    with pytest.raises(TypeError):
        keyword.match(spark.createDataFrame([(1, 5)], "request_id long, text int"), keyword.build_index(chunks(spark, ["a"])))


def test_composite_key(spark):
    asked = spark.createDataFrame([(1, 0, "ab"), (1, 1, "abab")], "request_id long, part int, text string")
    rows = keyword.match(asked, keyword.build_index(chunks(spark, ["ab"])), key=["request_id", "part"]).collect()
    assert sorted((r["request_id"], r["part"], r["relevance"]) for r in rows) == [(1, 0, 1.0), (1, 1, 2.0)]


def test_texts_that_share_a_request_are_searched_one_by_one(spark):
    asked = spark.createDataFrame([(1, "abab"), (1, "xxab")], "request_id long, text string")
    rows = keyword.match(asked, keyword.build_index(chunks(spark, ["ab"]))).collect()
    assert [(r["request_id"], r["relevance"], r["first_end"]) for r in rows] == [(1, 3.0, 2)]


def test_each_request_has_its_own_top_k(spark):
    patterns = [f"word{i:03d}" for i in range(150)]
    asked = spark.createDataFrame([(1, " ".join(patterns), 150), (2, " ".join(patterns), 3), (3, patterns[0], 0)], "request_id long, text string, top_k int")
    hits = keyword.search(asked, keyword.build_index(chunks(spark, patterns)))
    assert {r["request_id"]: r["count"] for r in hits.groupBy("request_id").count().collect()} == {1: 150, 2: 3}


def test_shuffled_anchors_give_the_same(spark, monkeypatch):
    patterns = ["a", "ab", "aba", "b" * 20, "abab" * 9]
    texts = ["abab" * 30, "b" * 50, "aba", ""]
    monkeypatch.setattr(keyword, "small_enough", lambda *args, **kwargs: False)
    assert found(keyword.match(queries(spark, texts), keyword.build_index(chunks(spark, patterns)))) == brute(texts, patterns)


def test_gram_table_finds_what_find_does(monkeypatch):
    monkeypatch.setattr(grams, "POSITIONS", 50)
    monkeypatch.setattr(grams, "COMPARED", 64)
    rng = random.Random(9)
    for turn in range(20):
        alphabet = "abé😀"[: 1 + turn % 4]
        patterns = list({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 20))) for _ in range(30)})
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(15)]
        text, pattern, n, first = grams.GramTable(patterns).counts(texts)
        got = {(t, p): (k, s + len(patterns[p])) for t, p, k, s in zip(text.tolist(), pattern.tolist(), n.tolist(), first.tolist())}
        assert got == brute(texts, patterns)
    assert [len(c) for c in grams.GramTable([]).counts(["a"])] == [0] * 4


def test_only_hits_leave_the_tasks(spark):
    """No row per position: what is shuffled are pairs with an occurrence."""
    texts = ["word " * 2000] * 50
    rows = keyword.match(queries(spark, texts), keyword.build_index(chunks(spark, ["word word", "absent"])))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan and "Join" not in plan
    assert rows.count() == 50


def test_short_patterns_are_searched_in_all_parts(spark):
    folder = "/root/testdata/sf0.001"
    part, supplier, nation = (pq.read_table(f"{folder}/{n}.parquet").to_pylist() for n in ("part", "supplier", "nation"))
    patterns = sorted({p["p_name"][p["p_partkey"] % 3 :][: 1 + p["p_partkey"] % 7] for p in part})
    asked = [(p["p_partkey"] % 50, p["p_name"]) for p in part] + [(n["n_nationkey"], f"{n['n_name']} {n['n_name']}") for n in nation]
    asked += [(s["s_nationkey"], s["s_name"] * 2 + s["s_name"][:9]) for s in supplier]
    want = {}
    for request, text in asked:
        for i, p in enumerate(patterns):
            at = [a for a in range(len(text) - len(p) + 1) if text.startswith(p, a)] if p else []
            if at:
                n, first = want.get((request, i), (0, 1 << 30))
                want[request, i] = (n + len(at), min(first, at[0] + len(p) - 1 + 1))
    rows = contract.queries()["keyword_match_short_all"](spark, folder).collect()
    assert {(r["request_id"], r["doc_id"]): (r["relevance"], r["first_end"]) for r in rows} == want and len(rows) == len(want)
