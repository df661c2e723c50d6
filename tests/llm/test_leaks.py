import random

from sheaf.llm.leaks import REPLACED, WINDOW, leaks, words_of


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = words_of(text)
        for i, passage in items:
            q = words_of(passage)
            for a in range(len(q) - WINDOW + 1):
                for b in range(len(w) - WINDOW + 1):
                    if sum(x != y for x, y in zip(q[a : a + WINDOW], w[b : b + WINDOW])) <= REPLACED:
                        out.add((d, i))
    return out


def test_against_brute_force(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(40)]
    make = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, make(random.randint(10, 30) if i % 4 else 30)) for i in range(12)]
    docs = []
    for d in range(40):
        w = make(random.randint(0, 60))
        _, q = random.choice(items)
        a = random.randrange(len(q) // 3)
        part = q[a : a + random.randint(12, 20)]
        for _ in range(random.randint(0, 2)):
            part[random.randrange(len(part))] = "other"
        docs.append((d, " ".join(w[: len(w) // 2] + part + w[len(w) // 2 :])))
    items = [(i, " ".join(q)) for i, q in items]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in got} == brute(docs, items)
    assert len(got) > 5


def test_what_does_not_count():
    assert words_of("**The** [river](http://x/y), isn&#39;t 1.5 <b>km</b>!") == words_of("the river isnt 15 km")
    assert words_of("e\u0301te\u0301 zero\u200bwidth") == ["été", "zerowidth"]


def test_long_tags_are_no_words():
    assert words_of("a <span title='" + "x " * 400 + "'>river</span> b") == ["a", "river", "b"]


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    from sheaf.llm import leaks as module

    text = " ".join(f"w{i % 17}x{i % 5}" for i in range(40))
    docs = spark.createDataFrame([(1, "so " + text), (1, "so " + text), (2, None), (3, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (8, text.upper()), (9, "short"), (None, text)], "item_id long, passage string")
    want = [(1, 7, 40, 40), (1, 8, 40, 40)]
    assert sorted(map(tuple, leaks(docs, items).collect())) == want
    monkeypatch.setattr(module, "_bitmap", lambda of: bytearray(b"\xff" * (1 << (module.BITS - 3))))
    assert sorted(map(tuple, leaks(docs, items).collect())) == want
