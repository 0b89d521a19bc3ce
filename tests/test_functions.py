"""Scalar functions: the traps that plain data never shows."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillforge.functions import text as X


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *values):
        row = spark.range(1).select(*(F.lit(v).alias(f"c{i}") if not hasattr(v, "_jc") else v.alias(f"c{i}") for i, v in enumerate(values)))
        return row.select(function(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]

    return run


@pytest.mark.parametrize(("paper", "year", "old"), [("1706.03762", 2017, 2017), ("9107.0001", 1991, 2091), ("cs/0701907", 2007, 2007), ("cond-mat/9910332", 1999, 1999), ("math.ag/0601001", 2006, 2006), ("garbage", None, None)])
def test_years_of_ids(apply, paper, year, old):
    assert apply(X.arxiv_year, paper) == year
    assert apply(X.arxiv_year_2000s, paper) == old


def test_vector_text(spark):
    vectors = [[-0.0703125, 0.0078125, 0.0234375, 0.2578125], [1e22, -1e-9, 0.1234565, 8645915646.10156, float("inf")], [0.5, None, 1.0], [], None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>")
    want = ["[-0.070312,0.007812,0.023438,0.257812]", "[10000000000000000000000.000000,-0.000000,0.123456,8645915646.101561,inf]", "[0.500000,1.000000]", "[]", None]
    for kind in ("double", "float"):
        own = rows if kind == "double" else rows.where("i <> 1").withColumn("v", F.col("v").cast("array<float>"))
        got = {r.i: r.t for r in own.select("i", X.vector_text(F.col("v")).alias("t")).collect()}
        assert got == {i: w for i, w in enumerate(want) if i in got} and len(got) >= 4
    assert rows.where("i = 0").select(X.vector_of_text(X.vector_text(F.col("v")))).first()[0] == [-0.070312, 0.007812, 0.023438, 0.257812]


def test_year_rules(apply):
    assert apply(X.earliest_year, "1706.03762", 2025) == 2017
    assert apply(X.earliest_year, "1706.03762", 0) == 2017
    assert apply(X.earliest_year, "x", 0) is None
    assert apply(X.earliest_year, "1706.03762", 1999) == 1999
    assert apply(X.repaired_year, "1706.03762", 2025) == 2017
    assert apply(X.repaired_year, "1706.03762", 2001) == 2001


def test_ids_of_works(spark):
    place = "array<struct<landing_page_url: string, pdf_url: string>>"
    rows = [
        ("https://doi.org/10.48550/arXiv.1706.03762", None, "1706.03762"),
        (None, [("http://x.org", "https://ARXIV.org/pdf/1706.03762v3")], "1706.03762"),
        ("10.1000/x", [(None, None), ("https://arxiv.org/abs/cs/0701907", "https://arxiv.org/pdf/2001.00001")], "cs/0701907"),
        (None, [("https://arxiv.org/abs/math.AG/0601001", None)], None),
        (None, None, None),
    ]
    got = spark.createDataFrame(rows, f"doi string, locations {place}, want string").select(X.arxiv_id(F.col("doi"), F.col("locations")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_texts(apply):
    assert apply(X.dehyphenate, "con-\nvergence a-\nb-\nc é-\nü") == re.sub(r"(\w)-\n(\w)", r"\1\2", "con-\nvergence a-\nb-\nc é-\nü")
    assert apply(X.normalize, " \u00a0a \t\r\nb\n\n\n\n\nc\u00a0 ") == "a\nb\n\nc\n"
    assert apply(X.clean_quote, " a\u00a0 b\n\tc ") == "a b c"
    assert apply(X.tex_escape, "a\\b & 5% $x_#{}") == r"a\textbackslash{}b \& 5\% \$x\_\#{}"
    assert apply(X.title_match, "With The Cats ABCD cat", "cats sat; abc") == 0.5
    assert apply(X.title_match, "with the", "x") is None
    assert apply(lambda c: X.ellipsis(c, 3), "abcd") == "abc…" and apply(lambda c: X.ellipsis(c, 3), "abc") == "abc"
    assert apply(X.estimate_tokens, 102_162) == 39_293
    assert apply(X.latex_to_text, "\\section{A} b \\emph[x]{c}\n") == "b\n"


def test_names(apply):
    cases = {"Vaswani, Ashish": "Vaswani", "Aaron van den Oord": "van den Oord", "Ashish Vaswani": "Vaswani", "von": "von", "": "", "de la  Cruz": "de la Cruz", "Émile Ünal": "Ünal"}
    for name, want in cases.items():
        assert apply(X.surname, name) == want, name
    for name in ("Ünal", "naïve Œuvre", "O'Neil 2nd", "ﬁne"):
        assert apply(X.ascii_key, name) == re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower())
    assert apply(X.key_base, "ho", 2020, "On the Deep Nets") == "ho2020deep"
    assert apply(lambda t: X.key_base(F.lit(None).cast("string"), F.lit(0), t), "of a") == "anonpaper"


def test_progress(apply):
    assert apply(lambda c: X.progress_counter(c, 1), "[47/132] x") == 47 and apply(lambda c: X.progress_counter(c, 2), "[47/132] x") == 132
    assert apply(X.progress_spend, "(spend $0.12)") == 0.12 and apply(X.progress_spend, "Labelling spend: $0.0093.") == 0.0093
    assert apply(X.progress_spend, "SPEND CAP HIT: $16.00 > $15") is None


def test_requests(apply):
    assert apply(X.clean_concept, "  Deep   NETS ") == "deep nets" and apply(X.valid_concept, "deep nets") and not apply(X.valid_concept, "-x")
    assert apply(X.valid_field, "fields/12345") == "fields/17" and apply(X.valid_field, "fields/3") == "fields/3"
    assert apply(X.clean_gloss, " \x01\x02 ") is None and apply(X.clean_gloss, "a\tb") == "a b" and apply(X.clean_note, " ") is None
    assert [apply(lambda n: X.corpus_limit(n, F.lit(True)), n) for n in (0, 3, 200, 999)] == [150, 5, 200, 300]
    assert apply(lambda n: X.corpus_limit(n, F.lit(False)), 10) == 150
    assert apply(X.is_owner, "Ann", "ann") and not apply(X.is_owner, "", "")
    assert [apply(X.relative_age, s) for s in (-5, 59, 61, 7200, 200_000)] == ["just now", "just now", "1m ago", "2h ago", "2d ago"]
    assert apply(X.percent, 3, 2) == 100.0 and apply(X.percent, 3, 0) is None
    assert apply(X.verified_by, True, False) == "src" and apply(X.verified_by, True, True) == "src+tgt"
    assert apply(X.strip_version, "http://arxiv.org/abs/cs/0701907v2") == "cs/0701907"
    assert apply(X.field_of, "https://x/fields/17") == "17" and apply(X.field_of, "all") is None


def test_inverted_index(spark):
    row = spark.createDataFrame([({"b": [1], "a": [0, 2]},), (None,)], "i map<string, array<int>>").select(X.from_inverted_index(F.col("i"))).collect()
    assert [r[0] for r in row] == ["a b a", ""]
