"""Personal data spans by weak supervision, in DataFrame and SQL functions only.

Method: base patterns (email, ip, card, phone) always count. Beyond them, these are candidates: words
with a digit, adjacent groups of digits as one (base matches that fail their check among them),
account numbers in groups of four, name=value and name:value words, any word behind a colon or equals
sign, and runs of capitalised words. LABELERS vote on them (1 personal or secret, -1
harmless, 0 no view): regexes, gazetteers of words and given names of four languages on values and on
the words before them, and context. Expectation-maximisation over the counts of vote patterns, from the
labelers' prior reliabilities (PRIOR, worth STRENGTH candidates), estimates how each votes on either kind of
candidate, hence how likely each pattern is personal; a candidate that nobody speaks about counts as
harmless but for a chance of UNSPOKEN. With these soft labels the final classifier is trained: its features are
the votes, weighted by the estimated reliabilities, and shape and context features, weighted by naive
Bayes at SHAPE of their log-odds, as shapes and votes overlap. It decides about every candidate; accepted ones
are added as spans, whose kind the votes tell: iban, name, number or secret.

Left out: names without a capitalised word beside them or without a given name or cue, streets, and
digit-free secrets without a sign or cue.

Scale: texts are scanned where they are; only counts of vote and feature patterns are shuffled
(combined map-side). There are some hundreds of vote patterns and a few thousand feature patterns however
large the corpus is; EM runs inside one SQL expression and some tens of weights return as literals.

Positions: a pattern's matches and the pieces between them alternate, so running sums of their
lengths in code points are the spans. Patterns use possessive runs and start only where a run starts,
so that time stays linear in a text. The context of a candidate is the CONTEXT code points before it.

Cases: null and empty texts have no spans; very long texts are taken whole; equal rows have equal spans; with
no candidates nothing is added; empty tables give no rows; clashing or extra columns are not read, and
``redact`` passes them through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.llm.shared import stage

#: Kinds in order; a match that fails its check is dropped.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds of added spans.
ADDED = ("iban", "name", "number", "secret")
#: A text without this can't match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string>>"
CONTEXT = 40

# Gazetteers: English, German, French, Spanish.
SECRET_WORDS = (
    "password", "passwd", "pwd", "passphrase", "passcode", "secret", "token", "apikey", "api_key", "access_key", "secret_key", "auth_token", "bearer", "credential", "credentials", "key", "pin",
    "passwort", "kennwort", "zugangscode", "geheimnis", "schlüssel", "zugangsschlüssel", "losung",
    "motdepasse", "mot_de_passe", "passe", "jeton", "clé", "cle", "code_secret",
    "contraseña", "contrasena", "clave", "secreto", "llave", "ficha", "clave_api",
)
PERSON_WORDS = (
    "call", "tel", "phone", "telephone", "mobile", "cell", "fax", "ssn", "passport", "iban", "account", "contact", "license", "card", "visa", "mastercard", "from", "name", "mr", "mrs", "ms", "dr",
    "telefon", "handy", "mobil", "rufnummer", "reisepass", "ausweis", "konto", "kontonummer", "kontakt", "karte", "kreditkarte", "steuernummer", "herr", "frau",
    "téléphone", "portable", "appelez", "passeport", "compte", "carte", "monsieur", "madame", "nom",
    "teléfono", "móvil", "llame", "pasaporte", "cuenta", "contacto", "tarjeta", "dni", "señor", "señora", "nombre",
)
PLAIN_WORDS = (
    "page", "pages", "chapter", "vol", "volume", "year", "version", "figure", "fig", "table", "step", "section", "no", "part", "line", "lines", "item", "items", "article", "room", "level", "about",
    "seite", "seiten", "kapitel", "band", "jahr", "abbildung", "abb", "tabelle", "schritt", "abschnitt", "teil", "zeile", "nr", "artikel", "etwa",
    "chapitre", "tome", "année", "tableau", "étape", "partie", "ligne", "environ",
    "página", "páginas", "capítulo", "volumen", "año", "versión", "figura", "tabla", "paso", "sección", "parte", "línea", "artículo", "unos",
)
GIVEN_NAMES = (
    "james", "mary", "john", "patricia", "robert", "jennifer", "michael", "linda", "william", "elizabeth", "david", "barbara", "richard", "susan", "joseph", "jessica", "thomas", "sarah", "charles", "karen", "daniel", "nancy", "matthew", "lisa", "anthony", "emily", "mark", "donna", "paul", "carol", "steven", "ruth", "andrew", "sharon", "george", "laura", "kevin", "alice", "brian", "jane", "peter", "anna", "oliver", "emma", "henry", "grace",
    "hans", "ursula", "klaus", "monika", "wolfgang", "petra", "jürgen", "sabine", "dieter", "renate", "stefan", "heike", "andreas", "katharina", "uwe", "birgit", "lukas", "claudia", "jonas", "silke", "felix", "greta", "maximilian", "heidi", "fritz", "ingrid", "matthias", "johanna",
    "jean", "marie", "pierre", "nathalie", "michel", "isabelle", "philippe", "sylvie", "alain", "catherine", "nicolas", "camille", "julien", "chloé", "antoine", "léa", "louis", "manon", "françois", "céline", "luc", "élodie", "jacques", "amélie", "rené", "hélène",
    "josé", "carmen", "antonio", "maría", "juan", "josefa", "manuel", "isabel", "francisco", "dolores", "luis", "pilar", "javier", "teresa", "miguel", "ana", "carlos", "lucía", "jesús", "elena", "alejandro", "paula", "diego", "sofía", "pablo", "marta", "jorge", "rosa", "fernando", "inés",
)
_FILLERS = "is|ist|lautet|est|es"

EM_ROUNDS = 25
#: How often a labeler says -1, 0 and 1 of harmless and of personal candidates, before any are seen.
PRIOR, STRENGTH = ((0.25, 0.73, 0.02), (0.03, 0.72, 0.25)), 20.0
#: Chance that a candidate nobody speaks about is personal.
UNSPOKEN = 0.02
#: Candidates' worth of shrinkage of shape features, and the part of their log-odds that counts.
SMOOTH, SHAPE = 20.0, 0.5

#: A word of digits and their punctuation; several, one space apart, are one candidate.
_GROUP = r"[(]?+[0-9][0-9().-]*+(?=[\s,;:!?]|$)"
_RUN = r"\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)++"
_ACCOUNT = r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?+(?![A-Za-z0-9])"
CANDIDATE = rf"(?<!\S)(?:{_ACCOUNT}|[+]?+{_GROUP}(?:\x20{_GROUP})++|(?=[^\s0-9]*+[0-9])\S++|[\p{{L}}_]++[:=]\S++|(?<=[:=]\s)\S++|{_RUN})"
#: A text without this has no candidate.
_MAY = r"[0-9=:]|\p{Ll}\x20\p{Lu}\p{Ll}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


_VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _found(text: Column, kind: str, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Spans of the pattern's valid matches, by start."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def step(a: Column, z: Column) -> Column:
        before = F.right(F.concat(a["tail"], z["gap"]), F.lit(CONTEXT))
        tail = F.right(F.concat(before, F.coalesce(z["hit"], F.lit(""))), F.lit(CONTEXT))
        begin = a["at"] + F.length(z["gap"])
        end = begin + F.coalesce(F.length(z["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), z["hit"].alias("value"), before.alias("before"))
        return F.struct(end.alias("at"), tail.alias("tail"), F.when(z["hit"].isNotNull() & valid(z["hit"]), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then start."""
    none = F.expr(f"cast(array() as {_SPAN})")
    parts = []
    for kind, pattern in PATTERNS.items():
        own = _found(text, kind, pattern, _VALID[kind])
        may = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike("[0-9]")
        parts.append(F.when(may, own).otherwise(none))
    return F.concat(*parts)


def candidates(text: Column, base: Column) -> Column:
    """Words and runs that CANDIDATE finds, without enclosing punctuation, that touch no base span."""
    none = F.expr(f"cast(array() as {_SPAN})")
    words = F.when(text.rlike(_MAY), _found(text, "secret", CANDIDATE, lambda v: F.lit(True))).otherwise(none)

    def trim(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], r"^([^\p{L}\p{N}]*+)", 1))
        core = F.regexp_replace(F.substr(s["value"], lead + 1), r"[^\p{L}\p{N}]++$", "")
        return F.struct(s["kind"], (s["start"] + lead).alias("start"), (s["start"] + lead + F.length(core)).alias("end"), core.alias("value"), s["before"])

    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(F.transform(words, trim), free)


def _previous(s: Column) -> Column:
    """The word before a candidate, lower-cased; a word for *is* between them does not count."""
    return F.lower(F.regexp_extract(s["before"], rf"(?iu)([\p{{L}}_]++)(?:[^\p{{L}}\p{{N}}]*+\s(?:{_FILLERS}))?+[^\p{{L}}\p{{N}}_]*+$", 1))


def _account(value: Column) -> Column:
    """Whether it is an international account number by its check digits."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    digit = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c >= "A", 100).otherwise(10) + digit(c)) % 97))
    return plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


#: What may vote, in order.
LABELERS = ("hex", "format", "account", "plain number", "secret word", "plain word", "person word", "length", "given name", "mixed characters")


def votes(s: Column) -> Column:
    """What each of LABELERS says about a candidate."""
    v, before = s["value"], _previous(s)
    name = F.lower(F.regexp_extract(v, r"^([\p{L}_]++)[=:]", 1))
    own = F.regexp_replace(v, r"^[\p{L}_]++[=:]", "")
    n, digits = F.length(own), F.length(_digits(v))
    words = F.split(F.lower(v), " ")
    groups, run = v.rlike(r"^[0-9(][0-9().\x20-]*\x20"), v.rlike(rf"^{_RUN}$")
    named = run & (F.exists(words, lambda w: w.isin(*GIVEN_NAMES)) | words[0].isin(*PERSON_WORDS))
    shaped = v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,40}$")

    def vote(yes: Column, no: Column | None = None) -> Column:
        out = F.when(yes, F.lit(1))
        return (out if no is None else out.when(no, F.lit(-1))).otherwise(F.lit(0))

    return F.array(
        vote(own.rlike(r"^(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{24,}$")),
        vote(own.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{12,}$|^(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[a-z])[-_][0-9A-Za-z_-]{12,}$|^AIza[0-9A-Za-z_-]{30,}$|^eyJ[0-9A-Za-z_-]{10,}\.")),
        vote(F.when(shaped, _account(v)).otherwise(False)),
        vote(F.lit(False), v.rlike(r"^[0-9]{1,4}(?:[.,:/-][0-9]{1,4})*(?:%|st|nd|rd|th|er|e|º)?$") | (groups & ~digits.between(7, 19))),
        vote((before.isin(*SECRET_WORDS) & ~run) | name.isin(*SECRET_WORDS)),
        vote(F.lit(False), before.isin(*PLAIN_WORDS)),
        vote(before.isin(*PERSON_WORDS) & ((digits >= 5) | run)),
        vote((n >= 16) & own.rlike("[0-9]") & own.rlike("[A-Za-z]"), (n <= 5) | (run & ~named & ~before.isin(*PERSON_WORDS))),
        vote(named),
        vote((n >= 8) & own.rlike("[0-9]") & own.rlike("[a-z]") & own.rlike("[A-Z]")),
    )


def _kind(v: Column, vote: Column) -> Column:
    said = lambda name: vote[LABELERS.index(name)] == 1
    return (
        F.when(said("account") | (said("person word") & v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,40}$")), "iban")
        .when(said("hex") | said("format") | said("secret word"), "secret")
        .when(v.rlike(rf"^{_RUN}$"), "name")
        .when(said("person word"), "number")
        .otherwise("secret")
    )


def features(s: Column) -> Column:
    """Shape and context of a candidate: a handful of values each."""
    v, before = s["value"], _previous(s)
    n, d = F.length(v), F.length(_digits(v))
    return F.array(
        F.concat(F.lit("n"), F.least(F.floor(F.log2(n + 1)), F.lit(6)).cast("string")),
        F.concat(F.lit("d"), F.floor(4 * d / F.greatest(n, F.lit(1))).cast("string")),
        F.concat(F.lit("c"), v.rlike("[a-z]").cast("int"), v.rlike("[A-Z]").cast("int"), v.rlike(r"[^\p{L}\p{N}]").cast("int")),
        F.concat(F.lit("x"), v.rlike("^[0-9a-fA-F]+$").cast("int")),
        F.concat(F.lit("p"), F.when(before.isin(*SECRET_WORDS), "s").when(before.isin(*PERSON_WORDS), "p").when(before.isin(*PLAIN_WORDS), "h").when(before == "", "0").otherwise("w")),
    )


def _em(patterns: DataFrame) -> DataFrame:
    """One row (prior, yes, no, v, p) for each of ``patterns`` (v, n): the reliabilities, and how likely the pattern is personal."""
    last = len(LABELERS) - 1
    weight = {1: "post[i]", 0: "(1 - post[i])"}

    def total(y: int) -> str:
        return f"aggregate(transform(pats, (x, i) -> x.n * {weight[y]}), 0D, (s, t) -> s + t)"

    def share(y: int) -> str:
        # Of each labeler, in order: how often it says -1, 0 and 1 on this kind.
        before = f"array({', '.join(f'{STRENGTH * p!r}D' for p in PRIOR[y])})[c + 1]"
        return f"transform(sequence(0, {last}), j -> transform(sequence(-1, 1), c -> ({before} + aggregate(transform(pats, (x, i) -> if(x.v[j] = c, x.n * {weight[y]}, 0D)), 0D, (s, t) -> s + t)) / ({STRENGTH!r}D + {total(y)})))"

    model = f"named_struct('prior', (1 + {total(1)}) / (4 + {total(1)} + {total(0)}), 'yes', {share(1)}, 'no', {share(0)})"
    odds = f"ln(m.prior) - ln(1 - m.prior) + aggregate(sequence(0, {last}), 0D, (s, j) -> s + ln(m.yes[j][x.v[j] + 1]) - ln(m.no[j][x.v[j] + 1]))"
    estep = f"transform(pats, x -> if(exists(x.v, w -> w <> 0), 1 / (1 + exp(-({odds}))), {UNSPOKEN!r}D))"
    start = f"transform(pats, x -> if(exists(x.v, w -> w <> 0), 1 / (1 + exp(-(2D * aggregate(x.v, 0, (s, t) -> s + t) - 0.5D))), {UNSPOKEN!r}D))"
    rounds = f"aggregate(sequence(1, {EM_ROUNDS}), {start}, (post, k) -> element_at(transform(array({model}), m -> {estep}), 1))"
    packed = patterns.select("v", F.col("n").cast("double").alias("n")).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("pats"))
    done = packed.where("size(pats) > 0").withColumn("post", F.expr(rounds)).withColumn("m", F.expr(model)).withColumn("post", F.expr(estep))
    return done.select("m.prior", "m.yes", "m.no", F.explode(F.arrays_zip("pats", "post")).alias("z")).select("prior", "yes", "no", F.col("z.pats.v").alias("v"), F.col("z.post").alias("p"))


@dataclass
class Weights:
    """The final classifier: the prior's log-odds, each labeler's for -1, 0 and 1, and each shape feature's."""

    prior: float
    vote: list[list[float]]
    shape: dict[str, float]


def train(docs: DataFrame) -> Weights | None:
    """The classifier of the candidates in ``docs`` (text); None without any."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(text.alias("text")).where(F.col("text").rlike(_MAY))
    own = own.withColumn("base", base_spans(F.col("text")))
    # A second use of base keeps the optimiser from putting its patterns inside the candidates' loop.
    own = own.select(F.explode(F.when(F.size("base") >= 0, candidates(F.col("text"), F.col("base")))).alias("s"))
    counts = stage(own.select(votes(F.col("s")).alias("v"), features(F.col("s")).alias("f")).groupBy("v", "f").agg(F.count("*").alias("n")), "votes")
    model = stage(_em(counts.groupBy("v").agg(F.sum("n").alias("n"))), "reliabilities")
    one = model.select(F.round("prior", 9).alias("prior"), "yes", "no").first()
    if one is None:
        return None
    soft = counts.join(F.broadcast(model.select("v", "p")), "v")
    sums = soft.select(F.explode(F.concat("f", F.array(F.lit("")))).alias("f"), (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no")).groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    rows = {r.f: (r.yes, r.no) for r in sums.withColumn("yes", F.round("yes", 6)).withColumn("no", F.round("no", 6)).collect()}
    yes, no = rows.pop("")
    part = {f: (a + b) / (yes + no) for f, (a, b) in rows.items()}
    odds = {f: F.log((F.lit(a) + SMOOTH * part[f]) / (F.lit(yes) + SMOOTH)) - F.log((F.lit(b) + SMOOTH * part[f]) / (F.lit(no) + SMOOTH)) for f, (a, b) in rows.items()}
    flat = [F.log(F.lit(one.prior) / (1 - F.lit(one.prior))), *(F.log(F.lit(y)) - F.log(F.lit(n)) for ys, ns in zip(one.yes, one.no, strict=True) for y, n in zip(ys, ns, strict=True)), *odds.values()]
    got = list(docs.sparkSession.range(1).select(*(F.round(c, 9).alias(f"w{i}") for i, c in enumerate(flat))).first())
    each = got[1 : 1 + 3 * len(LABELERS)]
    return Weights(got[0], [each[i : i + 3] for i in range(0, len(each), 3)], dict(zip(odds, got[1 + 3 * len(LABELERS) :], strict=True)))


def _accepted(found: Column, weights: Weights | None) -> Column:
    """Candidates the classifier takes, as spans of their kinds."""
    if weights is None:
        return F.filter(found, lambda s: F.lit(False))
    table = F.create_map(*(F.lit(x) for pair in sorted(weights.shape.items()) for x in pair))
    each = F.array(*(F.array(*map(F.lit, row)) for row in weights.vote))
    judged = F.transform(found, lambda s: F.struct(s.alias("s"), votes(s).alias("v"), features(s).alias("f")))

    def score(x: Column) -> Column:
        said = F.aggregate(F.zip_with(x["v"], each, lambda v, w: F.element_at(w, v + 2)), F.lit(weights.prior), lambda a, w: a + w)
        return F.aggregate(x["f"], said, lambda a, f: a + SHAPE * F.coalesce(F.element_at(table, f), F.lit(0.0)))

    taken = F.filter(judged, lambda x: score(x) > 0)
    return F.transform(taken, lambda x: F.struct(_kind(x["s"]["value"], x["v"]).alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["value"].alias("value"), x["s"]["before"].alias("before")))


def with_spans(docs: DataFrame, weights: Weights | None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end, value, before)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    based = docs.withColumn("base", base_spans(text))
    return based.withColumn("spans", F.when(text.rlike(_MAY), F.concat("base", _accepted(candidates(text, F.col("base")), weights))).otherwise(F.col("base")))


def find(docs: DataFrame) -> DataFrame:
    """doc_id with its base spans and all spans, by a classifier trained on ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(own, train(own)).select("doc_id", "base", "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans are one."""
    kept = [f"`{c}`" for c in docs.columns]
    own = docs.select(F.struct(*kept).alias("row"), F.col("text").cast("string").alias("text"))
    found = with_spans(own, train(own))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        # substr counts from 1: what lies between the last span's end and this one's start.
        fresh = s["start"] >= a["at"]
        gap = F.substr(text, a["at"] + 1, s["start"] - a["at"])
        grown = F.concat(a["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, grown).otherwise(a["out"]).alias("out"))

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    clean = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    cleaned = found.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(text))
    return cleaned.select(*((F.col("clean") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
