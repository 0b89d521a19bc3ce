"""Operators on small frames: clustering, components, grounding, curation, state, caps, exports, sources."""

import datetime
import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillforge.functions import text as X
from quillforge.operators import corpus, curation, export, extract, graph, grounding, running, state, vectors
from quillforge.schemas import EDGES, NODE
from quillforge.sources import papers

AT = datetime.datetime(2024, 5, 1, 12)


def naive_linkage(points, cutoff):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    gap = 1 - unit @ unit.T
    groups = [[i] for i in range(len(points))]
    while len(groups) > 1:
        best = min(((np.mean([gap[a, b] for a in x for b in y]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j), key=lambda t: t[0])
        if not best[0] < cutoff:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(points), int)
    for n, g in enumerate(sorted(groups, key=min)):
        out[g] = n
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 14), st.integers(0, 10_000), st.sampled_from([0.1, 0.28, 0.6, 1.0]))
def test_average_linkage(n, seed, cutoff):
    points = np.random.default_rng(seed).normal(size=(n, 4))
    assert (vectors.average_linkage(points, cutoff) == naive_linkage(points, cutoff)).all()


def test_average_linkage_copies():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        points = rng.normal(size=(5, 3))[rng.integers(0, 5, 16)]
        for cutoff in (0.3, 0.8):
            assert (vectors.average_linkage(points, cutoff) == naive_linkage(points, cutoff)).all()
    assert vectors.average_linkage(np.array([[0, 0], [1, 0], [0, 0], [2, 0]]), 0.5).tolist() == [0, 1, 2, 1]


def test_clusters_of_a_large_group(spark):
    """No number of rows is too many for a group, and copies weigh as many."""
    points = np.random.default_rng(3).normal(size=(12, 4)).astype("float32").tolist()
    which = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 12).cast("int")
    rows = spark.range(9000).select(F.lit("a").alias("concept"), F.col("id").alias("vec_id"), F.element_at(F.lit(points), which + 1).alias("embedding"))
    got = [r.cluster for r in vectors.clusters(rows, 0.6).orderBy("vec_id").collect()]
    assert got == naive_linkage(np.array(points)[[0 if i % 3 == 0 else i % 12 for i in range(24)]], 0.6).tolist() * 375


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        label[hi] = lo
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_degrees_and_isolated(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "c")], "src string, dst string")
    assert {tuple(r) for r in graph.degrees(edges).collect()} == {("a", 2, 2), ("b", 2, 2), ("c", 2, 1)}
    assert [r.node for r in graph.isolated(spark.createDataFrame([("a",), ("z",)], "node string"), edges).collect()] == ["z"]


def test_containment(spark):
    docs = spark.createDataFrame([(1, "alpha beta  gamma delta"), (2, "xbeta gammay"), (3, "Beta gamma"), (4, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "a beta  gamma d"), (2, "beta gamma"), (3, ""), (4, None), (5, "ta\u00a0x"), (6, "alpha beta gamma"), (7, "gamma")], "item_id long, text string")
    assert {tuple(r) for r in grounding.containment(docs, quotes).collect()} == {(1, 1), (2, 2), (1, 7), (2, 7), (3, 7)}


def test_keep_best_and_rank(spark):
    pool = spark.createDataFrame([(1, "k", 1, 2, 3), (2, "k", 1, 2, 3), (3, "j", 0, None, None)], "id long, key string, seed int, refs long, cites long")
    best = corpus.keep_best(pool, ["key"], [F.desc("seed"), F.desc("refs"), F.desc("cites"), F.asc("id")])
    assert [(r.rnk, r.id, r.score) for r in corpus.rank(best).collect()] == [(1, 1, pytest.approx(2 * np.log(3) + np.log(4), abs=1e-6)), (2, 3, 0.0)]


def nodes_and_edges(spark):
    kind = f"struct<{NODE[len('STRUCT<') : -1]}>"
    rows = [(("n1", "one", 2000, 2001, [9, 10], "a", [("a", 2001, "A"), ("b", None, "B")]),), (("n2", "two", 1999, 1999, [2, 9], "c", [("c", 1999, "C")]),), (("n3", "three", None, None, [], "d", [("d", 0, "D")]),)]
    nodes = spark.createDataFrame(rows, f"n {kind}").select("n.*")
    spec = [(1, "n1", "n2"), (2, "n2", "n1"), (3, "n1", "n3"), (4, "n3", "n3")]
    edges = spark.createDataFrame([(i, 1, s, t, "extends", None, None, "q", "q", 0.5, True, None, None) for i, s, t in spec], EDGES)
    return nodes, edges


def test_curation(spark):
    nodes, edges = nodes_and_edges(spark)
    merged, wired = curation.merge(nodes, edges, "n1", "n2")
    (n2,) = merged.where("node_id = 'n2'").collect()
    assert (n2.definition_ids, [m.arxiv_id for m in n2.members], n2.year_start, n2.year_end) == ([2, 9, 10], ["c", "a", "b"], 1999, 2001)
    assert {(r.id, r.source_node, r.target_node) for r in wired.collect()} == {(3, "n2", "n3")}
    assert curation.merge(nodes, edges, "nope", "n2")[0].exceptAll(nodes).count() == 0
    kept, left = curation.delete_node(nodes, edges, "n3")
    assert kept.count() == 2 and {r.id for r in left.collect()} == {1, 2}
    assert curation.rename(nodes, "n1", "  ").exceptAll(nodes).count() == 0
    assert curation.rename(nodes, "n1", " x ").where("node_id = 'n1'").first().label == "x"
    assert curation.reclassify(edges, 1, "merges").where("id = 1").first().edge_type == "merges"
    assert curation.delete_edge(edges, 1).count() == 3 and curation.delete_edge(edges, 99).count() == 4
    with pytest.raises(ValueError, match="no edge type"):
        curation.reclassify(edges, 1, "likes")
    edits = spark.range(1).select(curation.record(F.lit(None), "merge", "{}", AT, "me").alias("e")).first().e
    assert [(e.op, e.by, e.at) for e in edits] == [("merge", "me", AT)]
    listed = {r.node_id: (r.ends, r.isolated) for r in curation.listing(nodes, edges.where("id <= 2")).collect()}
    assert listed == {"n1": (2, False), "n2": (2, False), "n3": (0, True)}


def test_requests(spark):
    schema = "id long, concept string, requested_by string, status string, decided_by string, decided_at timestamp, created_at timestamp, updated_at timestamp"
    old = AT - datetime.timedelta(minutes=10)
    rows = [
        (1, "a", "u", "requested", None, None, AT - datetime.timedelta(days=7), AT),
        (2, "b", "u", "approved", None, AT, AT - datetime.timedelta(days=6, hours=23), AT),
        (3, "c", "v", "approved", None, None, AT, AT),
        (4, "d", "v", "running", None, AT, AT, old - datetime.timedelta(seconds=1)),
        (5, "e", "v", "running", None, AT, AT, old),
        (6, "f", "v", "complete", None, AT, AT, AT),
    ]
    own = spark.createDataFrame(rows, schema)
    before = {tuple(r) for r in own.collect()}
    assert state.claim(own).first().id == 3
    assert [r.id for r in state.stale(own, AT).collect()] == [4]
    assert {tuple(r) for r in state.quota(own, F.lit(AT).cast("timestamp")).collect()} == {("u", 2, 1), ("v", 3, 4)}
    ids = own.select("id")
    moved = {r.id: r.status for r in state.transition(own, ids, "rejected", "me", AT).collect()}
    assert moved == {1: "rejected", 2: "rejected", 3: "rejected", 4: "running", 5: "running", 6: "complete"}
    assert {tuple(r) for r in state.transition(own, ids.where("id > 99"), "failed", None, AT).collect()} == before
    incoming = spark.createDataFrame([(7, "a"), (8, "f"), (9, "f")], "id long, concept string")
    assert [r.id for r in state.open_unique(own, incoming).collect()] == [8]
    bad = state.violations(own, {"known": F.col("status").isin("requested"), "named": F.col("concept").isNotNull()})
    assert bad.count() == 5 and bad.first().broken == ["known"]


def test_spend_cap(spark):
    rows = [(i, i // 3, c) for i, c in enumerate([4, 6, 0, 1, 5])]
    kept = running.within_cap(spark.createDataFrame(rows, "pos long, day long, cost long"), ["pos"], "cost", 10, F.col("day"))
    assert [(r.pos, r.spent) for r in kept.orderBy("pos").collect()] == [(0, 4), (1, 10), (2, 10), (3, 11)]


def plain_keys(bases):
    taken, out = set(), []
    for name in bases:
        key, i = name, 0
        while key in taken:
            i += 1
            key = name + chr(96 + i)
        taken.add(key)
        out.append(key)
    return out


def test_cite_keys(spark):
    """Keys of several sets of bases, with bases that are others' suffixed keys, against keys given one by one."""
    rng = np.random.default_rng(9)
    sets = [["x", "x", "x", "xa"], ["xa", "x", "x", "xaa", "x", "xa"], ["k1ab"] * 30 + ["k1a", "k1a", "k1", "k1ab"], *(list(rng.choice(["p", "pa", "pb", "paa", "q7", "q7a", "q7b", "z"], 40)) for _ in range(3))]
    for bases in sets:
        rows = spark.createDataFrame(list(enumerate(map(str, bases))), "pos long, base string").repartition(3)
        got = {r.pos: r.key for r in export.cite_keys(rows, "base", ["pos"]).collect()}
        assert [got[i] for i in range(len(bases))] == plain_keys(bases) and len(set(got.values())) == len(bases)


def test_round_trip(spark):
    nodes, edges = nodes_and_edges(spark)
    genealogy = nodes.groupBy().agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes")).select(F.lit(1).alias("id"), F.lit("c").alias("concept"), F.lit("v1").alias("prompt_version"), "nodes")
    named = edges.withColumn("source_paper", F.lit("p1")).withColumn("target_paper", F.lit(None).cast("string"))
    texts = export.to_json(export.assemble(genealogy, named))
    assert json.loads(texts.first().json)["stats"] == {"nodes": 3, "edges": 4, "verified_edges": 4, "inferred_edges": 0}
    back = export.restore(texts, spark.createDataFrame([("p1", 5)], "arxiv_id string, id long")).orderBy("pos").collect()
    assert [(r.source_node, r.target_node, r.source_paper_id, r.target_paper_id) for r in back] == [("n1", "n2", 5, None), ("n2", "n1", 5, None), ("n1", "n3", 5, None), ("n3", "n3", 5, None)]
    with pytest.raises(PySparkException, match="no paper p1"):
        export.restore(texts, spark.createDataFrame([("p2", 5)], "arxiv_id string, id long")).collect()


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "A concept is here. More"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.defines_concept, r.verbatim_quote, r.quote_verified) for r in extract.extract(docs, "CONCEPT").collect()}
    assert got == {1: (True, "A concept is here.", True), 2: (False, "", False), 3: (False, "", False)}
    made = extract.embed(docs)
    stored = made.where("doc_id = 1").withColumn("embedding", F.array(F.lit(7.0).cast("float")))
    again = {r.doc_id: r.embedding for r in extract.embed_missing(docs, stored).collect()}
    assert again[1] == [7.0] and len(again[2]) == 64 and len(again) == 3


def archive(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(archive({"z/main.tex": "\\begin{document}Hi \\input{sub/part} \\include{none}\\end{document}", "sub/part.tex": "there \\input{main} \\input{part}", "x.png": "no"}))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"\\title{T} lone"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.bin").write_bytes(b"zzz")
    kinds = {r.path.rsplit("/", 1)[1]: r.format for r in papers.read_binaries(spark, str(tmp_path)).collect()}
    assert kinds == {"a.tar.gz": "latex", "b.gz": "latex", "c.pdf": "pdf", "d.bin": None}
    texts = {r.path.rsplit("/", 1)[1]: r.text.split() for r in papers.read_archives(spark, str(tmp_path)).collect()}
    # The main file may come once more within its own inputs, as any file not above itself.
    assert texts == {"a.tar.gz": ["Hi", "there", "Hi"], "b.gz": ["lone"]}


def test_pages(spark, tmp_path):
    for i, (rows, after) in enumerate([([{"id": 1}, {"id": 2}], "page-1.json"), ([{"id": 3}], "page-2.json"), ([], None)]):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"results": rows, "next": after}))
    spark.dataSource.register(papers.PagedSource)
    read = lambda most: sorted(json.loads(r.json)["id"] for r in spark.read.format("result_pages").option("most", most).load(str(tmp_path)).collect())
    assert read(400) == [1, 2, 3] and read(2) == [1, 2]


def test_feed(spark):
    feed = "<feed><entry><id>http://arxiv.org/abs/1706.03762v5</id><author><name>A B</name></author><author><name>C</name></author></entry><entry><id>http://arxiv.org/abs/cs/0701907v1</id><author><name>D</name></author></entry></feed>"
    rows = spark.createDataFrame([(feed,)], "f string").select(F.explode(papers.entries_of_feed(F.col("f"))).alias("e")).select("e.*").collect()
    assert [(r.id, r.names) for r in rows] == [("1706.03762", ["A B", "C"]), ("cs/0701907", ["D"])]


def test_outline(spark):
    nodes, edges = nodes_and_edges(spark)
    keys = spark.createDataFrame([("a", "ka", 2001), ("b", "kb", None), ("c", "kc", 1999), ("d", "kd", 2000)], "paper string, key string, year int")
    named = edges.where("id = 1").withColumn("source_paper", F.lit("a")).withColumn("target_paper", F.lit("c"))
    lines = [r.line for r in export.markdown(nodes, named, keys).orderBy("section", "part", "pos").collect()]
    assert lines == [
        "## 1. two (1999)\n\\cite{kc}",
        "## 2. one (2000–2001)\n\\cite{ka}, \\cite{kb}",
        "## 3. three (undated)\n\\cite{kd}",
        "- extends: \\cite{ka} to \\cite{kc}, *one* to *two* (0.50, verified)",
        "- not connected: three",
    ]


def test_references_and_defaults(spark):
    kind = "citing string, refs array<struct<citedPaper: struct<externalIds: struct<ArXiv: string>>, contexts: array<string>, intents: array<string>, isInfluential: boolean>>"
    rows = [("a", [((("b",),), ["", "1", " ", "2", "3", "4", "5"], ["x"], True), (((None,),), ["1"], None, None), ((None,), None, None, None), ((("b",),), None, None, False)]), ("c", None)]
    got = [(r.citing, r.cited, r.contexts, r.influential) for r in corpus.cited_references(spark.createDataFrame(rows, kind)).collect()]
    assert got == [("a", "b", ["1", "2", "3", "4"], True), ("a", "b", [], False)]
    some, other = (spark.createDataFrame([(x,)], "k string") for x in "ab")
    assert [r.k for r in corpus.or_default(some, other).collect()] == ["a"]
    assert [r.k for r in corpus.or_default(some.limit(0), other).collect()] == ["b"]
    text = spark.range(1).select(X.prompt(F.lit("nets"), F.lit("abc"), F.lit(""), 2).alias("p")).first().p
    assert text == "What does the following text say about nets?\n\nab"


def test_fetching():
    """Backoff, a service's own wish, what is not to be had, and spacing, by a transport and a clock of the test's."""
    now, slept, asked = [0.0], [], []

    def sleep(seconds):
        slept.append(round(seconds, 3))
        now[0] += seconds

    def fetcher(*answers, **options):
        left = list(answers)
        return papers.Fetcher(lambda url: (asked.append(url), left.pop(0))[1], clock=lambda: now[0], sleep=sleep, **options)

    a = papers.Answer
    assert fetcher(a(503), a(429, headers={"Retry-After": "7"}), a(500), a(200, b"x")).get("u") == b"x" and slept == [2.0, 7.0, 8.0]
    assert fetcher(a(403)).get("u") is None and fetcher(a(410)).get("u") is None
    with pytest.raises(OSError, match="gave up after 2"):
        fetcher(a(502), a(502), attempts=2).get("u")
    with pytest.raises(OSError, match="status 400"):
        fetcher(a(400)).get("u")
    slept.clear()
    spaced = fetcher(a(200, b"1"), a(200, b"2"), spacing=papers.SPACING["source"])
    assert spaced.get("u") == b"1" and spaced.get("u") == b"2" and slept == [3.0]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("cond-mat/1", bytearray(b"abc"), "gz"), ("2", bytearray(b"d"), "pdf")], "id string, content binary, ext string")
    assert sorted(tuple(r) for r in papers.write_files(rows, f"{tmp_path}/raw").collect()) == [("2", "2.pdf", True), ("cond-mat/1", "cond-mat_1.gz", True)]
    assert (tmp_path / "raw" / "cond-mat_1.gz").read_bytes() == b"abc" and len(list((tmp_path / "raw").iterdir())) == 2
    assert not any(r.written for r in papers.write_files(rows, f"{tmp_path}/raw").collect())


def test_file_sources(spark, tmp_path):
    """Works and corpora from JSON, whole texts, labels, the envelope of a list."""
    (tmp_path / "works.json").write_text('{"id": "W1", "display_name": "T", "referenced_works": ["W2"]}\n')
    (tmp_path / "corpus.json").write_text('[{"arxiv_id": "1", "year": null}, {"arxiv_id": "2", "year": 2001}]')
    (tmp_path / "a.txt").write_text("first\nsecond")
    assert papers.read_works(spark, f"{tmp_path}/works.json").first().referenced_works == ["W2"]
    assert [(r.arxiv_id, r.year) for r in papers.read_corpus(spark, f"{tmp_path}/corpus.json").collect()] == [("1", None), ("2", 2001)]
    assert [(r.text, r["head"]) for r in papers.read_texts(spark, f"{tmp_path}/a.txt", 5).collect()] == [("first\nsecond", "first")]
    labels = spark.createDataFrame([(1999, 2001, 3, 1), (None, None, 2, 7)], "low int, high int, n int, c int").select(X.default_label(F.col("low"), F.col("high"), F.col("n"), F.col("c")).alias("l")).collect()
    assert [r.l for r in labels] == ["1999–2001 sense (3 papers)", "cluster 7"]
    told = json.loads(export.envelope(spark.createDataFrame([(1, None)], "id long, note string"), AT).first().json)
    assert told["rows"] == [{"id": 1, "note": None}] and told["now"].startswith("2024-05-01T12")
    with pytest.raises(PySparkException, match="another width"):
        spark.range(1).select(extract.in_order(F.array(F.struct(F.lit(0).alias("index"), F.array(F.lit(1.0)).alias("embedding"))), 2)).collect()
    with pytest.raises(PySparkException, match="no concept matches x"):
        corpus.resolve_concept(spark.createDataFrame([("x", 0, None)], "query string, pos int, id string")).collect()


def test_staging_folder_is_deleted(spark):
    from quillforge import staging

    kept = staging.staged(spark.range(3), "rows")
    assert kept.count() == 3
    own = staging.own_dir(spark).removeprefix("file://").removeprefix("file:")
    import os

    assert os.path.isdir(own)
    staging.drop_staged(spark)
    assert not os.path.exists(own)
