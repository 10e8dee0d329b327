import random
import zlib
from collections import Counter

import regex
from corpusflow.llm import spelling
from corpusflow.llm.spelling import BidirectionalIndex
from tests.llm.conftest import document_rows


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_search_schemes_equal_brute_force():
    draw = random.Random(1)
    for turn in range(40):
        letters = "abcéÿ"[: draw.randint(1, 5)]
        some = lambda n: list({"".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(n)})
        words = some(120)
        queries = words if turn % 2 else some(60) + ["zz", "azb"]
        found = set()
        for query, word in BidirectionalIndex(words).one_error(queries):
            found |= {(queries[q], words[w]) for q, w in zip(query.tolist(), word.tolist())}
        assert found == {(q, w) for q in queries for w in words if one_edit(q, w)}


def test_shards_and_crowded_halves_lose_no_pair(spark):
    draw = random.Random(3)
    words = list({"prefix" + "".join(draw.choice("ab") for _ in range(draw.randint(1, 6))) for _ in range(150)} | {"".join(draw.choice("abc") for _ in range(7)) for _ in range(200)})
    table = spark.createDataFrame([(w,) for w in [*words, words[0], None, ""]], "word string")
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    for shard in (25, 10_000):
        rows = spelling.near_words(table, shard).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def brute(docs, damage, ratio=10):
    counts = Counter()
    for doc_id, text in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if damage and h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return rows


def test_variants_equal_brute_force(spark):
    docs = [(1, "Colourful " * 1000 + "colourfull " * 60 + "colorfull " * 5), (2, "Éternité éternité eternité ÉTERNITÉ " * 3), (None, "colourful colourfuls Straßenbahn straßenbahn straßenbahm"), (3, "colourfull,colourful;colourfullx")]
    docs += [(i, f"alternative alternativ{'e' * (i % 3)} repeated repeatedd {chr(97 + i % 5)}epeated") for i in range(10, 90)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for damage in (0, 5):
        rows = spelling.variants(table, damage=damage).collect()
        found = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows}
        assert found == brute(docs, damage) and len(rows) == len(found)
    assert any(r["root"] not in (r["word"], r["form"]) for r in spelling.variants(table).collect())


def test_awkward_rows(spark, awkward, nothing):
    rows = [tuple(r) for r in spelling.variants(awkward, damage=2).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert set(rows) == brute([(r[0], r[1]) for r in document_rows()], 2) and len(rows) == len(set(rows))
    assert spelling.variants(nothing).count() == 0
