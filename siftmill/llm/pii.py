"""Personal data by weak supervision, with DataFrame functions only.

Fixed patterns find the base kinds: email, ip, card and phone.  Beyond these, wide patterns give candidate spans on which
regex, gazetteer, context and shape labelers vote.  Expectation-maximisation estimates the labelers' reliabilities from
the votes alone, and its posteriors train the naive Bayes classifier over the spans' features that decides.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")
# Each pattern finds what the plain one in its comment finds.  Possessive repeats and the tests before the first character
# only keep long runs from being tried again at each of their places.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ of at least 12 digits: the plain pattern's matches are whole runs of digits, so no shorter one hides a longer
    "card": r"[0-9](?:[\x20-]?[0-9]){11}(?:[\x20-]?[0-9])*+",
    # the plain pattern
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# The gazetteers of forms of address, first names and kinds of street.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau")
FIRST_NAMES = (
    "Alice", "Andrew", "Anna", "Anthony", "Barbara", "Betty", "Brian", "Carlos", "Charles", "Christopher", "Daniel", "David", "Deborah", "Donald", "Dorothy",
    "Edward", "Elizabeth", "Emily", "Emma", "George", "Hans", "Helen", "James", "Jennifer", "Jessica", "John", "Joseph", "Juan", "Karen", "Kenneth", "Laura",
    "Linda", "Lisa", "Margaret", "Maria", "Mark", "Mary", "Matthew", "Michael", "Nancy", "Patricia", "Paul", "Peter", "Richard", "Robert", "Sandra", "Sarah",
    "Steven", "Susan", "Thomas", "William",
)
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Square", "Terrace")
#: Wide patterns for further kinds: tokens with a digit that are long enough for a key, grouped identity numbers, capitalised
#: words behind a form of address or from a first name on, and a number before capitalised words.  Any two capitalised words
#: would be far too many candidates in some languages.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+",
    "identity": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "person": r"(?<![A-Za-z])(?:(?:" + "|".join(TITLES) + r")\.?+ [A-Z][a-z]{1,20}+|(?:" + "|".join(FIRST_NAMES) + r")(?= [A-Z][a-z]))(?: [A-Z][a-z]{1,20}+){0,2}+(?![A-Za-z])",
    "address": r"(?<![0-9A-Za-z])[0-9]{1,5}+(?: [A-Z][a-z]{1,20}+){1,3}+(?:,? [0-9]{5}(?![0-9]))?+(?![A-Za-z])",
}
#: Kinds whose labelers are weighed together; what one text form is worth says nothing of another.
FAMILIES = (("secret", "identity"), ("person",), ("address",))
# The gazetteer of key prefixes.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "glpat-")
NAMED_FOR = r"(?i)(?:\bname|contact|dear|signed|regards|employee|patient|customer|born)\W{0,6}$"
PLACED_FOR = r"(?i)(?:address|lives? at|ship(?:ped)? to|located at|residence|deliver(?:ed)? to)\W{0,6}$"
CONTEXT_FOR = r"(?i)(?:passw(?:or)?d|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key|auth|credential|ssn|social security|identity)\W{0,6}$"
CONTEXT_AGAINST = r"(?i)(?:https?:|www\.|/|sha1|sha256|md5|commit|checksum|version|doi|isbn)\W{0,3}$"
LABELERS = 4


def located(text: Column, pattern: str) -> Column:
    """Matches from left to right: start, end (code points, end exclusive), the match, and the text between it and the one before."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    pieces = F.filter(pieces, lambda x: x["hit"].isNotNull())
    none = F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,hit:string,gap:string>>)").alias("out")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.substring(x["gap"], -32, 32).alias("gap")))).alias("out"))

    return F.aggregate(pieces, F.struct(*none), step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds as structs of start, kind (its place in KINDS) and end, sorted."""
    gate = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": text.rlike(PATTERNS["card"]), "phone": F.contains(text, F.lit("+"))}
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def of(n: int, kind: str) -> Column:
        kept = F.filter(located(text, PATTERNS[kind]), lambda x: passes(kind, x["hit"]))
        return F.when(gate[kind], F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end")))).otherwise(none)

    return F.array_sort(F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)]))


def one_of(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def votes(kind: str, hit: Column, gap: Column) -> list[Column]:
    """1, -1 or 0 (abstains) of the regex, gazetteer, context and shape labelers."""
    if kind == "person":
        regex = F.when(hit.rlike("^" + one_of(TITLES)), 1).otherwise(0)
        gazetteer = F.when(hit.rlike(one_of(FIRST_NAMES)), 1).otherwise(-1)
        context = F.when(gap.rlike(NAMED_FOR), 1).otherwise(0)
        return [regex, gazetteer, context, F.when((gap == "") | gap.rlike(r"[.!?:\n]\s*$"), -1).otherwise(0)]
    if kind == "address":
        regex = F.when(hit.rlike("[0-9]{5}$"), 1).otherwise(0)
        gazetteer = F.when(hit.rlike(one_of(STREETS)), 1).otherwise(-1)
        context = F.when(gap.rlike(PLACED_FOR), 1).otherwise(0)
        return [regex, gazetteer, context, F.when(hit.rlike("^[0-9]+ [A-Z][a-z]+$"), -1).otherwise(0)]
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    share = digits / F.length(hit)
    regex = F.when(hit.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{20}|[0-9]{3}-[0-9]{2}-[0-9]{4})$") & hit.rlike("[A-Za-z]|-"), 1).when(hit.rlike(r"[a-z]-[a-z]|/"), -1).otherwise(0)
    gazetteer = F.when(hit.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"), 1).otherwise(0)
    context = F.when(gap.rlike(CONTEXT_FOR), 1).when(gap.rlike(CONTEXT_AGAINST), -1).otherwise(0)
    shape = F.when(hit.rlike("^[0-9_/+]+$"), -1).when((share >= 0.1) & ~hit.rlike("[/]"), 1).otherwise(-1)
    return [regex, gazetteer, context, shape]


def features(kind: str, hit: Column, gap: Column) -> list[Column]:
    """What the final classifier sees of a span; each takes a few values."""
    flag = lambda c: c.cast("string")
    if kind == "person":
        return [F.lit(kind), flag(hit.rlike("^" + one_of(TITLES))), flag(hit.rlike(one_of(FIRST_NAMES))), flag(F.size(F.split(hit, " "))), flag(gap.rlike(NAMED_FOR))]
    if kind == "address":
        return [F.lit(kind), flag(hit.rlike(one_of(STREETS))), flag(hit.rlike("[0-9]{5}$")), flag(F.size(F.split(hit, " "))), flag(gap.rlike(PLACED_FOR))]
    share = F.length(F.regexp_replace(hit, "[^0-9]", "")) / F.length(hit)
    mix = F.concat(hit.rlike("[a-z]").cast("int").cast("string"), hit.rlike("[A-Z]").cast("int").cast("string"), hit.rlike("[_/+-]").cast("int").cast("string"), hit.rlike("(?i)[g-z]").cast("int").cast("string"))
    return [F.lit(kind), F.least(F.floor(F.length(hit) / 8), F.lit(6)).cast("string"), F.floor(share * 4).cast("string"), mix, gap.rlike(r"[=:]\s*[\"']?$").cast("string"), gap.rlike(CONTEXT_FOR).cast("string")]


def candidate_spans(text: Column) -> Column:
    """Candidate spans as structs of start, end, kind and cell: votes and features in one string."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,cell:string>>)")

    def of(kind: str, pattern: str) -> Column:
        cell = lambda x: F.concat_ws("|", *[v.cast("string") for v in votes(kind, x["hit"], x["gap"])], *features(kind, x["hit"], x["gap"]))
        return F.transform(located(text, pattern), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), cell(x).alias("cell")))

    numbered = F.when(text.rlike("[0-9]"), F.concat(*[of(k, CANDIDATES[k]) for k in ("secret", "identity", "address")])).otherwise(none)
    return F.concat(numbered, of("person", CANDIDATES["person"]))


def accepted(cells: dict[str, int], rounds: int = 30) -> list[str]:
    """The cells whose spans the final classifier takes for personal data.

    ``cells`` counts the candidates by votes and features; its size is bounded by the number of values these can take,
    whatever the corpus.  Starts from the majority of the votes, and then alternates the posteriors of the cells with the
    prior and the labelers' rates of each vote.
    """
    if not cells:
        return []
    parsed = {c: ([int(v) for v in c.split("|")[:LABELERS]], c.split("|")[LABELERS:]) for c in cells}
    post = {c: 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for c, (v, _) in parsed.items()}
    for _ in range(rounds):
        rate = [{v: [1.0, 1.0] for v in (-1, 0, 1)} for _ in range(LABELERS)]
        total = [3.0, 3.0]
        for c, n in cells.items():
            for z, w in ((1, post[c] * n), (0, (1 - post[c]) * n)):
                total[z] += w
                for k, v in enumerate(parsed[c][0]):
                    rate[k][v][z] += w
        for c in cells:
            odds = math.log(total[1] / total[0]) + sum(math.log(rate[k][v][1] / total[1]) - math.log(rate[k][v][0] / total[0]) for k, v in enumerate(parsed[c][0]))
            post[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    seen: dict[tuple[int, str], list[float]] = defaultdict(lambda: [1.0, 1.0])
    total = [2.0, 2.0]
    for c, n in cells.items():
        for z, w in ((1, post[c] * n), (0, (1 - post[c]) * n)):
            total[z] += w
            for k, f in enumerate(parsed[c][1]):
                seen[k, f][z] += w
    score = lambda fs: math.log(total[1] / total[0]) + sum(math.log(seen[k, f][1] / total[1]) - math.log(seen[k, f][0] / total[0]) for k, f in enumerate(fs))
    return [c for c in cells if score(parsed[c][1]) > 0]


def accepted_of(cells: dict[str, int]) -> list[str]:
    """The accepted cells of all families, each weighed by itself."""
    kind = lambda c: c.split("|")[LABELERS]
    return [c for family in FAMILIES for c in accepted({c: n for c, n in cells.items() if kind(c) in family})]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base and extra, arrays of structs (start, kind, end) and (start, end, kind).

    A null text counts as empty and gives empty arrays; repeated rows give equal results; ids pass through; other columns
    are ignored; an empty table gives no rows.  Extra spans never overlap a base span.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = materialise(docs.select(F.col(id_col), base_spans(text).alias("base"), candidate_spans(text).alias("candidates")), "spans")
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    spans = spans.select(id_col, "base", free.alias("candidates"))
    cells = {r["cell"]: r["n"] for r in spans.select(F.explode("candidates.cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    good = accepted_of(cells)
    kept = F.filter("candidates", lambda c: c["cell"].isin(good)) if good else F.filter("candidates", lambda c: F.lit(False))
    return spans.select(id_col, "base", F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))).alias("extra"))


def annotate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with the columns base and extra of ``find``.  The texts are gone through twice, so that nothing has to be joined to them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    free = F.filter("_candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = docs.withColumns({"base": base_spans(text), "_candidates": candidate_spans(text)}).withColumn("_candidates", free)
    cells = {r["cell"]: r["n"] for r in found.select(F.explode("_candidates.cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    good = accepted_of(cells)
    kept = F.filter("_candidates", lambda c: c["cell"].isin(good) if good else F.lit(False))
    return found.withColumn("extra", F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))).drop("_candidates")


def kind_name(place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), place + 1)


def written(base: Column, extra: Column | None = None) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    rows = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("place"), b["end"].alias("end"), kind_name(b["kind"]).alias("kind")))
    if extra is not None:
        place = F.lit(len(KINDS))
        rows = F.concat(rows, F.transform(extra, lambda c: F.struct(c["start"].alias("start"), place.alias("place"), c["end"].alias("end"), c["kind"].alias("kind"))))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")


def masked(text: Column, base: Column, extra: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first counts and hides the rest."""
    rows = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), kind_name(b["kind"]).alias("kind"))),
        F.transform(extra, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))),
    )
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        new = F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, r["start"] - acc["at"]), F.concat(F.lit("<"), r["kind"], F.lit(">"))))
        return F.struct(F.greatest(acc["at"], r["end"]).alias("at"), F.when(r["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    end = F.aggregate(F.array_sort(rows), none, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(rows) > 0, end).otherwise(text)
