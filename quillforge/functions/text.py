"""Scalar text functions as Column expressions (inventory F1-F40); pandas only where Spark lacks one.

Every function takes and returns Columns, keeps null as null unless it says otherwise, and stays
inside code generation, so it can stand in any select, filter or join of a distributed plan.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifier and progress patterns, word lists and prices that results depend on.
ARXIV_URL = r"(?i)arxiv\.org/(?:abs|pdf)/([a-z\-]+/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?"
ARXIV_DOI = r"(?i)10\.48550/arxiv\.(.+)$"
COUNTER = r"\[(\d+)/(\d+)\]"
SPEND = r"[Ss]pend:? \$([0-9]+(?:\.[0-9]+)?)"
TITLE_STOP = (
    "with", "from", "using", "their", "this", "that", "than", "then", "into", "over", "under", "between", "through", "towards", "toward", "based", "very", "your",
    "ours", "about", "which", "while", "were", "have", "been", "does",
)
KEY_STOP = ("a", "an", "the", "on", "of", "in", "for", "and", "with", "is", "are", "to", "by")
CHARS_PER_TOKEN = 2.6
DEFAULT_FIELD = "fields/17"


def _hit(column: Column, pattern: str, group: int = 1) -> Column:
    """The pattern's group, null where it isn't found."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def arxiv_id(doi: Column, locations: Column) -> Column:
    """from the DOI, else from the first location URL that has one (landing page before pdf)."""
    urls = F.flatten(F.transform(locations, lambda x: F.array(x["landing_page_url"], x["pdf_url"])))
    found = F.filter(F.transform(urls, lambda u: F.regexp_extract(F.coalesce(u, F.lit("")), ARXIV_URL, 1)), lambda u: u != "")
    return F.coalesce(_hit(doi, ARXIV_DOI), F.try_element_at(found, F.lit(1)))


def field_of(field: Column) -> Column:
    """the last path segment; null (no filter) for '' and 'all'."""
    return F.when(~F.lower(F.trim(field)).isin("", "all"), F.element_at(F.split(F.trim(field), "/"), -1))


def from_inverted_index(index: Column) -> Column:
    """The text of {word: positions}; '' for null or empty."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " "), F.lit(""))


def inverted_index(text: Column) -> Column:
    """F3 turned round: {word: positions} of a text split at single spaces, without leaving its row."""
    placed = F.sort_array(F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    # One-element arrays hold what lambdas use more than once.
    edges = lambda p: F.filter(F.sequence(F.lit(0), F.size(p)), lambda i: (i == 0) | (i == F.size(p)) | (F.get(p, i)["w"] != F.get(p, i - 1)["w"]))
    entry = lambda p, e: lambda s, i: F.struct(F.get(p, s)["w"].alias("w"), F.transform(F.slice(p, s + 1, F.get(e, i + 1) - s), lambda x: x["p"]).alias("p"))
    built = lambda p: F.transform(F.array(edges(p)), lambda e: F.map_from_entries(F.transform(F.slice(e, F.lit(1), F.size(e) - 1), entry(p, e))))[0]
    return F.transform(F.array(placed), built)[0]


def document_text(title: Column, abstract: Column, limit: int = 2000) -> Column:
    """title and abstract, the first ``limit`` code points."""
    return F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit(""))), 1, limit)


def citation_score(refs: Column, cites: Column) -> Column:
    """references inside the corpus weigh twice as much as citations at large."""
    return 2 * F.log1p(F.coalesce(refs, F.lit(0))) + F.log1p(F.coalesce(cites, F.lit(0)))


def arxiv_year(paper: Column) -> Column:
    """submission year of a new (YYMM.NNNNN) or old (archive/YYMMNNN) id; null for others."""
    yy = F.coalesce(_hit(paper, r"^(\d{2})\d{2}\.\d{4,5}$"), _hit(paper, r"^[a-z\-\.]+/(\d{2})\d{2}\d{3}$")).cast("int")
    return F.when(yy >= 91, 1900 + yy).otherwise(2000 + yy)


def arxiv_year_2000s(paper: Column) -> Column:
    """as ``arxiv_year``, but new-style ids are always of this century."""
    new = _hit(paper, r"^(\d{2})\d{2}\.\d{4,5}$").cast("int")
    return F.when(new.isNotNull(), 2000 + new).otherwise(arxiv_year(paper))


def known_year(year: Column) -> Column:
    """0 stands for an unknown year."""
    return F.nullif(year, F.lit(0))


def earliest_year(paper: Column, year: Column) -> Column:
    """F8: the earlier of the id's year and the stated one, of those that are known."""
    return F.least(known_year(arxiv_year(paper)), known_year(year))


def repaired_year(paper: Column, year: Column) -> Column:
    """the id's year where the stated one is later."""
    own = arxiv_year_2000s(paper)
    return F.when(year > own, own).otherwise(year)


def detect_format(content: Column) -> Column:
    """by magic bytes; null for what is neither."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head == "255044462D", "pdf").when(head.startswith("1F8B"), "latex")


def dehyphenate(text: Column) -> Column:
    """words split over lines, joined."""
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def normalize(text: Column) -> Column:
    """LF line ends, no blanks at line ends, at most one blank line, one LF at the end."""
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def title_match(title: Column, text: Column, stop: Sequence[str] = TITLE_STOP) -> Column:
    """Share of the title's significant words found in the text; null where it has none."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0)))
    words = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    # The text's lower case is an array's element, or the filter would make it again for every word.
    found = F.transform(F.array(F.lower(text)), lambda hay: F.size(F.filter(words, lambda w: F.contains(hay, w))))
    return F.try_divide(found[0].cast("double"), F.nullif(F.size(words), F.lit(0)))


def estimate_tokens(chars: Column) -> Column:
    """tokens of so many characters, rounded down."""
    return F.floor(chars / F.lit(CHARS_PER_TOKEN)).cast("long")


def cost_usd(tokens_in: Column, tokens_out: Column, per_m_in: Column, per_m_out: Column) -> Column:
    """by prices per million tokens."""
    return tokens_in / F.lit(1e6) * per_m_in + tokens_out / F.lit(1e6) * per_m_out


def default_label(low: Column, high: Column, n: Column, cluster: Column) -> Column:
    """years and size of a cluster, its number where no year is known."""
    return F.when(low.isNotNull(), F.format_string("%d–%d sense (%d papers)", low, high, n)).otherwise(F.concat(F.lit("cluster "), cluster.cast("string")))


@F.pandas_udf(T.StringType())
def ascii_key(text: pd.Series) -> pd.Series:
    """compatibility-decomposed, ASCII letters and digits only, lower-cased."""
    plain = text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
    return plain.str.lower().str.replace("[^a-z0-9]", "", regex=True)


def ascii_key_of_ascii(text: Column) -> Column:
    """F22 for text known to be ASCII, without leaving the JVM."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def surname(name: Column) -> Column:
    """what stands before a comma; else the last word with the lower-case particles before it."""
    particled = F.regexp_extract(F.trim(name), r"((?:(?<!\S)\p{Ll}\S*\s+)*\S+)$", 1)
    # The first word alone is never a particle of an empty surname: the pattern then takes all words.
    spaced = F.regexp_replace(particled, r"\s+", " ")
    return F.when(F.contains(name, F.lit(",")), F.trim(F.split_part(name, F.lit(","), F.lit(1)))).when(F.trim(name) == "", name).otherwise(spaced)


def key_word(title: Column) -> Column:
    """the title's first word of three letters or more that isn't a stop word, else 'paper'."""
    words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    good = F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*KEY_STOP))
    return F.coalesce(F.lower(F.try_element_at(good, F.lit(1))), F.lit("paper"))


def key_base(surname_key: Column, year: Column, title: Column) -> Column:
    """a citation key before collisions are told apart; null surname is 'anon'."""
    return F.concat(F.coalesce(surname_key, F.lit("anon")), F.coalesce(known_year(year).cast("string"), F.lit("")), key_word(title))


def tex_escape(text: Column) -> Column:
    """TeX's special characters; the backslash first, braces as they are."""
    for plain, escaped in (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def clean_quote(text: Column) -> Column:
    """runs of white space (Unicode's) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def year_span(low: Column, high: Column) -> Column:
    """one year, or both with a dash."""
    return F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))


def progress_counter(line: Column, group: int) -> Column:
    """[current/total] of a log line; group 1 or 2."""
    return _hit(line, COUNTER, group).cast("int")


def progress_spend(line: Column) -> Column:
    """the dollars a log line says were spent."""
    return _hit(line, SPEND).cast("double")


def slug(text: Column) -> Column:
    """lower case, everything but letters and digits as underscores."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def clean_concept(text: Column) -> Column:
    """trimmed, lower-case, single spaces."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")


def valid_concept(text: Column) -> Column:
    """2 to 60 letters, digits, spaces and hyphens, not beginning with a space or hyphen."""
    return text.rlike(r"^[a-z0-9][a-z0-9 -]{1,59}$")


def valid_field(field: Column) -> Column:
    """A field id, or the default one."""
    return F.when(field.rlike(r"^fields/\d{1,4}$"), field).otherwise(F.lit(DEFAULT_FIELD))


def clean_note(text: Column, limit: int = 500) -> Column:
    """trimmed and cut; empty is null."""
    return F.nullif(F.substring(F.trim(text), 1, limit), F.lit(""))


def clean_gloss(text: Column, limit: int = 200) -> Column:
    """control characters as spaces, trimmed and cut; empty is null."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x1f]", " ")), 1, limit), F.lit(""))


def corpus_limit(wanted: Column, owner: Column) -> Column:
    """150 for all but owners, who may choose from 5 to 300."""
    return F.when(owner, F.least(F.lit(300), F.greatest(F.lit(5), F.coalesce(F.nullif(wanted, F.lit(0)), F.lit(150))))).otherwise(F.lit(150))


def ellipsis(text: Column, limit: int) -> Column:
    """F32: cut at ``limit`` with an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def relative_age(seconds: Column) -> Column:
    """how long ago, in the largest whole unit; the future is now."""
    s = F.greatest(F.lit(0), F.floor(seconds))
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(name))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "m ago")).when(s < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def percent(current: Column, total: Column) -> Column:
    """100 at most; null without a total."""
    return F.when(total != 0, F.least(F.lit(100.0), F.try_divide(current * F.lit(100.0), total)))


def strip_version(paper: Column) -> Column:
    """what follows the last /abs/, without the version."""
    return F.regexp_replace(F.element_at(F.split(paper, "/abs/"), -1), r"v\d+$", "")


def is_owner(viewer: Column, owner: Column) -> Column:
    """the same name in any case; never where either is missing."""
    return F.coalesce((F.lower(viewer) == F.lower(owner)) & (owner != ""), F.lit(False))


def stem(paper: Column) -> Column:
    """an id as a file name."""
    return F.replace(paper, F.lit("/"), F.lit("_"))


def verified_by(source: Column, target: Column) -> Column:
    """which quotes were found."""
    return F.concat_ws("+", F.when(source, "src"), F.when(target, "tgt"))


@F.pandas_udf(T.StringType())
def _six_decimals(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else f"[{','.join(['%.6f'] * len(v)) % tuple(v.tolist())}]")


def vector_text(vector: Column) -> Column:
    """a vector as text, six decimals each, in brackets; nulls inside are left out.

    Rounded as C does, from the exact binary value and halves to even: ``format_string`` rounds halves
    up, ``format_number`` loses digits of large numbers.
    """
    return _six_decimals(F.array_compact(vector))


def vector_of_text(text: Column) -> Column:
    """the vector of such a text; empty brackets are an empty vector."""
    inner = F.regexp_replace(text, r"^\s*\[|\]\s*$", "")
    return F.when(F.trim(inner) == "", F.expr("cast(array() as array<double>)")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("double")))


def strip_html(html: Column) -> Column:
    """F13's counterpart for web pages: scripts, styles and tags removed, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def latex_to_text(latex: Column) -> Column:
    """commands with their arguments removed, then ``normalize``."""
    return normalize(F.regexp_replace(latex, r"\\[a-zA-Z]+\*?(\[[^\]]*\])?(\{[^}]*\})?", " "))


def prompt(concept: Column, text: Column, gloss: Column, limit: int = 40_000) -> Column:
    """The question for an extractor; the sense is there only with a gloss."""
    sense = F.when(gloss != "", F.concat(F.lit(", meant as: "), gloss)).otherwise("")
    return F.concat(F.lit("What does the following text say about "), concept, sense, F.lit("?\n\n"), F.substring(text, 1, limit))
