import random

from corpusflow.llm import licenses

SCANNER = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES, 4, 8, 0.5)


def test_phrases_equal_brute_force():
    draw, pool = random.Random(3), [b"mit", b"license", b"apache", b"general", b"public", b"x", b"the", b"gnu"]
    for _ in range(1500):
        words = [draw.choice(pool) for _ in range(draw.randint(0, 25))] + licenses.words_of(draw.choice(licenses.TEMPLATES)[1])[draw.randint(0, 40) :]
        expected = []
        for phrase, label in licenses.PHRASES.items():
            parts = licenses.words_of(phrase)
            expected += [(label, i) for i in range(len(words)) if words[i : i + len(parts)] == parts]
        assert sorted((p["label"], p["word"]) for p in SCANNER.scan(words)[0]) == sorted(expected)


def test_matching_statistics_equal_brute_force():
    draw = random.Random(4)
    sequences = [[SCANNER.ids[w] for w in licenses.words_of(t)] for t in [*licenses.PHRASES, *[t for _, t in licenses.TEMPLATES]]]
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, min(len(s), i + 30) + 1)}
    for _ in range(100):
        words = []
        for _ in range(4):
            s = draw.choice(sequences)
            at = draw.randrange(len(s))
            words += s[at : at + draw.randint(1, 7)]
        for i, (_, length) in enumerate(SCANNER.automaton.statistics(words)):
            assert length == max([0, *[k for k in range(1, i + 2) if tuple(words[i + 1 - k : i + 1]) in runs]])


def test_gaps_are_chained_and_weak_matches_are_not_reported():
    words = licenses.words_of(licenses.TEMPLATES[0][1])
    changed = [*words[:20], b"really", *words[20:40], *words[42:]]
    spans = SCANNER.scan([b"a"] * 5 + changed)[1]
    assert [(s["label"], s["first"]) for s in spans] == [("mit", 5)] and 0.9 < spans[0]["share"] < 1
    assert SCANNER.scan(words[:12])[1] == []


def test_awkward_rows(awkward, nothing):
    rows = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(awkward).collect()}
    assert rows[(8, 8)]["phrases"][0]["word"] == 3 and {s["label"] for s in rows[(8, 8)]["spans"]} == {"mit"}
    assert rows[(0, 0)]["phrases"] == [] and rows[(None, 0)]["spans"] == []
    assert licenses.scan(nothing).count() == 0
