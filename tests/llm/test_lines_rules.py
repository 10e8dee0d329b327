import re
import time
from collections import Counter

import duckdb
import numpy as np
from corpusflow.llm import lines, rules
from tests.llm.conftest import document_rows


def line_rows():
    rows = []
    for i in range(60):
        text = [f"own line {i}", "shared by all", f"shared by some {i % 4}", " shared by all ", ""]
        text += ["on ten sites"] if i % 20 < 10 else []
        text += ["on nine sites"] if i % 20 < 9 else []
        rows.append((i, "\n".join(text), f"s{i % 20}"))
    return [*rows, (60, None, "s1"), (61, "", "s2"), (62, "shared by all", None), (None, "shared by all\nx", "s3")]


def test_lines_equal_sql(spark):
    docs = spark.createDataFrame(line_rows(), "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.line_dedup(docs).collect()}
    known = docs.filter("doc_id is not null").toPandas()
    with duckdb.connect() as db:
        db.register("documents", known)
        expected = {r[0]: (r[1], r[2]) for r in db.sql(lines.SQL).fetchall()}
    assert got[60] == (None, 0) and got[None] == ("x", 1)
    assert {k: v for k, v in got.items() if k not in (60, None)} == {k: v for k, v in expected.items() if k != 60}
    assert got[0][0].startswith("own line 0\nshared by all") and "on nine sites" in got[28][0] and "on ten sites" not in got[28][0]


def test_spread_over_hashed_join_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(line_rows(), "doc_id long, text string, source string")
    sent = sorted(map(str, lines.line_dedup(docs).collect()))
    monkeypatch.setattr(lines, "SENT_LINES", -1)
    assert sorted(map(str, lines.line_dedup(docs).collect())) == sent


def test_many_equal_lines_take_time_in_proportion(spark):
    """Texts of 200,000 equal lines each on twelve sites, and one of as many lines of which one goes."""
    docs = spark.range(12).selectExpr("id as doc_id", "repeat('the same line\n', 200000) as text", "concat('s', id) as source")
    own = spark.range(1).selectExpr("100 as doc_id", "array_join(transform(sequence(1, 200000), i -> concat('line ', i)), '\n') || '\nthe same line' as text", "'own' as source")
    started = time.monotonic()
    rows = {r["doc_id"]: r for r in lines.line_dedup(docs.unionByName(own)).selectExpr("doc_id", "n_removed", "length(text) as size", "left(text, 20) as start").collect()}
    assert time.monotonic() - started < 60
    assert rows[0]["n_removed"] == 199_999 and rows[0]["start"] == "the same line\n" and all(rows[i]["n_removed"] == 200_000 and rows[i]["size"] == 0 for i in range(1, 12))
    assert rows[100]["n_removed"] == 1 and rows[100]["start"].startswith("line 1\nline 2")


def test_awkward_lines(awkward, nothing):
    cut = lines.line_dedup(awkward, least=1)
    assert cut.columns == [*awkward.columns, "n_removed"] and cut.count() == len(document_rows())
    by_key = {r["doc_id"]: r for r in cut.collect()}
    assert by_key[4]["n_removed"] == 0 and by_key[5]["text"] == "" and by_key[9]["text"] == "all rights reserved.\nMit license"
    assert lines.line_dedup(nothing).count() == 0


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice, covered = {w for w, n in Counter(windows).items() if n > 1}, set()
    for i, w in enumerate(windows):
        if w in twice:
            covered.update(range(i, i + 8))
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


def rule_rows():
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = [" ".join(base), " ".join(base * 2), " ".join([*base, *base[3:12]]), "x " * 100, " ".join(base) + "\n\n" + " ".join(base) + "\r\n \x0bé # * $ % & | < >"]
    texts += [" ".join([*base[:8], "-", *base[:8], "-", *base[1:9]]), "tab\tand\x0bvertical\x0c form \x85 \xa0 wide 　 blank\x1c", *[r[1] for r in document_rows()]]
    return list(enumerate(texts))


def test_base_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in rule_rows()], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    for i, text in rule_rows():
        n, *rest = expected = brute(text)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected, text
        assert got[i]["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n)
        assert sum(got[i]["classes"]) == len(text or "") and sum(got[i]["common"]) == n


def test_distance_equals_brute_force(spark):
    draw = np.random.default_rng(6)
    reference = draw.dirichlet(np.ones(7)).tolist()
    counts = [draw.integers(0, 9, 7).tolist() for _ in range(20)] + [[0] * 7, [3, 0, 0, 0, 0, 0, 0]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, h array<bigint>")
    for r in df.withColumn("d", rules.distance("h", reference)).collect():
        h = np.array(r["h"], dtype=float)
        if not h.sum():
            assert r["d"] is None
            continue
        p, q = h / h.sum(), np.array(reference)
        m = (p + q) / 2
        parts = [sum(x * np.log2(x / y) for x, y in zip(side, m) if x > 0) for side in (p, q)]
        assert abs(r["d"] - np.sqrt(sum(parts) / 2)) < 1e-9


def test_divergent_texts_go_and_short_or_plain_ones_stay(spark):
    plain = "the house of the river and the night that was in a garden with this water from it "
    rows = [(i, (plain * (8 + i)).replace("river", f"river{i}"), "en") for i in range(30)]
    rows += [(100, (plain * 8).upper().replace("HOUSE", "X1"), "en"), (101, " ".join(f"w{i} |" for i in range(200)), "en")]
    rows = [(i, " ".join(f"{w}{'abcdefgh'[(j * (i + 3)) % 8]}" if j % 3 == 0 else w for j, w in enumerate(t.split())) if i < 100 else t, lang) for i, t, lang in rows]
    got = {r["doc_id"]: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(30)) and got[0]["class_distance"] < 0.1
    assert got[100]["class_distance"] > rules.MOST_CLASSES and not got[100]["kept"] and not got[101]["kept"]


def test_awkward_rules(awkward, nothing):
    rows = rules.quality_rules(awkward).collect()
    assert len(rows) == len(document_rows()) and all(r["kept"] in (True, False) for r in rows)
    assert rules.quality_rules(nothing).count() == 0
