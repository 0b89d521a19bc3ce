"""Windows against brute force; blocks of items; cutting and dropping."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillforge.llm import decontaminate as D

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, window=10):
    wins = {}
    for name, text in items:
        own = words(text)
        for i in range(max(len(own) - window + 1, min(len(own), 1))):
            wins.setdefault(tuple(own[i : i + window]), set()).add(str(name))
    sizes = {len(w) for w in wins}
    out = {}
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if found := wins.get(tuple(own[i : i + n])):
                    names |= found
                    hit.update(range(i, i + n))
        out[doc] = (len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 4))
def test_automaton(items, text, window):
    matcher = D.Matcher([(str(i), " ".join(x)) for i, x in enumerate(items)], window)
    raw = " ".join(text).encode()
    import numpy as np

    [(_, n, hit, names, _)] = matcher.rows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    want = brute([(0, " ".join(text))], list(enumerate(" ".join(x) for x in items)), window)[0]
    assert (n, 0 if hit is None else hit.sum(), len(names)) == want[:3]


ODD = [(900_001, None), (900_002, ""), (900_003, "!!!"), (900_003, "Alpha-beta gamma"), (900_004, "x " * 5000 + "ALPHA beta, gamma")]
ITEMS = [(7000, "alpha beta gamma"), (7001, None), (7002, "..."), (7003, "beta Gamma")]


def tables(spark, tiny):
    docs, bench = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, items = [(r.doc_id, r.text) for r in docs.collect()] + ODD, [(r.item_id, r.text) for r in bench.collect()] + ITEMS
    return rows, items, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_query_against_brute_force(spark, tiny):
    rows, items, docs, bench = tables(spark, tiny)
    want = brute(rows, items)
    twice = want.pop(900_003)
    for block in (D.BLOCK_WORDS, 200):
        found = D.digest(D.contamination(docs, bench, block_words=block)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in found if r.doc_id != 900_003} == want
        # Rows that repeat a doc_id each have the result of their own text.
        assert sorted(tuple(r)[1:] for r in found if r.doc_id == 900_003) == sorted([twice, brute([(0, "!!!")], items)[0]])
    assert any(v[4] for v in want.values())
    assert D.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert D.contamination(docs.limit(0), bench).count() == 0


def test_cut_and_drop(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "src", f"Before {' '.join('abcdefghijklmnopqrstuvwxyz' * 3)} . {item.upper()}! after"), (2, "src", item), (3, "src", "clean"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, items string, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminate(docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[3] == "clean" and got[4] is None
    assert got[1] == f"Before {' '.join('abcdefghijklmnopqrstuvwxyz' * 3)} . ! after"
    assert {r.doc_id for r in D.decontaminate(docs, bench, coverage=0.0).collect()} == {3, 4}


def test_items_without_an_id(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"so {item}"), (2, "alpha beta"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, "alpha beta"), (7, "alpha beta")], "item_id long, text string")
    for block in (D.BLOCK_WORDS, 1):
        got = {r.doc_id: (r.n_hit, r.items) for r in D.contamination(docs, bench, block_words=block).collect()}
        assert got == {1: (11, []), 2: (2, ["7"]), 3: (0, [])}
    assert [r.doc_id for r in D.decontaminate(docs, bench, coverage=0.0).collect()] == [3]


@pytest.mark.parametrize("coverage", [0.0, 0.2, 1.0])
def test_blocks_never_change_a_result(spark, coverage):
    """Items in one block and in many: coverage is judged, and texts are cut, on the union of all hits."""
    inner = "i0 i1 i2 i3 i4 i5 i6 i7 i8 i9"
    first, second = [f"b{k}" for k in range(10)], [f"c{k}" for k in range(10)]
    filler = " ".join(f"w{k}" for k in range(73))
    rows = [
        (1, f"{filler} {' '.join(first)} so {' '.join(second)}", "x"),
        (2, f"{' '.join(first[:5])} {inner} {' '.join(first[5:])} {filler} {filler}", "x"),
        (3, f"alpha beta {filler} {filler}", "x"),
        (4, "alpha beta", "x"),
        (5, None, None),
        (5, filler, "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    bench = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(second)), (3, inner), (None, "alpha beta"), (5, None)], "item_id long, text string").coalesce(1)
    got = [sorted((tuple(r) for r in D.decontaminate(docs, bench, coverage=coverage, block_words=block).collect()), key=str) for block in (1_000_000, 15, 1)]
    assert got[0] == got[1] == got[2]
    kept = {r[0]: r[1] for r in got[0] if r[0] != 5}
    assert sum(r[0] == 5 for r in got[0]) == 2
    if coverage == 0.2:
        # 20 of 94 words are hit, by two items; of the rest the hit words are cut.
        assert set(kept) == {2, 3} and kept[2].split() == [*first, *filler.split(), *filler.split()] and kept[3].split() == [*filler.split(), *filler.split()]
    assert set(kept) == {0.0: set(), 0.2: {2, 3}, 1.0: {1, 2, 3, 4}}[coverage]


def test_repeated_words_take_linear_time():
    many = ["x"] * 20_000
    began = time.process_time()
    matcher = D.Matcher([("1", " ".join(many)), *((f"s{n}", " ".join(many[:n])) for n in range(1, 10))], 10)
    built = time.process_time()
    import numpy as np

    raw = " ".join(many).encode()
    [(_, n, hit, names, _)] = matcher.rows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert n == hit.sum() == 20_000 and len(names) == 10
    assert time.process_time() - built < 1 and built - began < 2


def test_two_million_item_words(spark):
    """Many blocks: one pass over the documents, then only over those that may be hit."""
    items = spark.range(400).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(1, 500), x -> concat('w', cast(id * 500 + x as string)))) as text")
    docs = spark.createDataFrame([(1, "so w101 w102 w103 w104 w105 w106 w107 w108 w109 w110 end"), (2, "w1 w2 w3"), (3, "clean")], "doc_id long, text string")
    windows = D.WindowFilter(items, 10)
    assert windows.widths == [10]
    got = {r.doc_id: (r.n_hit, r.items) for r in D.contamination(docs, items, block_words=30_000).collect()}
    assert got == {1: (10, ["0"]), 2: (0, []), 3: (0, [])}
