"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose candidates; four labelers vote on each: its form, a gazetteer (domains,
country codes, issuer prefixes, titles), cue words before it, and a checksum or range check.
A labeler may abstain. Expectation-maximisation over the counts of vote patterns estimates
how often each labeler is right (the counts are a bounded table: kinds x 3^4), and its
posteriors are the soft labels from which a naive Bayes classifier over span features is
trained. Spans of the four base kinds that pass their rule are always reported; the classifier
adds spans of the other kinds, where they touch no base span.

Texts are read once, by the executors; what is learned returns as literal maps.

Defined results: null is the empty text, without spans; kinds may overlap; repeated rows are
rows of their own; rows with null ids are kept; without candidates nothing is learned or
added; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions.binding import bind
from pagetide.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
ADDED = ("mail", "number", "iban", "name")
LABELERS = ("form", "gazetteer", "context", "check")
ROUNDS = 40
SURE = 0.5

# Possessive runs and look-behinds find the same spans as the plain forms, in linear time:
# a run that cannot end in a match is not tried again from its second character.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9.+(-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20"
    r"\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
# what a text must contain for its pattern to be tried
_NEEDS = {"email": ("@",), "phone": ("+",), "mail": ("(at)", "[at]")}

# Gazetteers and cue words.
DOMAINS = "com org net edu gov info io de fr es uk it nl eu ch at be".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 61 62 81 82 86 90 91".split()
IBAN_COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
CUES = {
    "email": "mail email contact kontakt correo courriel write schreiben",
    "ip": "ip host server address adresse login from client",
    "card": "card visa mastercard karte kreditkarte carte tarjeta payment",
    "phone": "phone tel telephone mobile cell fax call telefon handy appelez llame",
}
CUES |= {"mail": CUES["email"], "number": f"{CUES['phone']} ssn", "iban": "iban account konto compte cuenta bank", "name": "dear contact by von par por"}
DOUBTS = "order invoice sku isbn version tracking serial page chapter section fig"


_BLOCK = 64


def _running(numbers: Column) -> Column:
    """Running sums of an array, as longs: sums of blocks are carried along, the rest is added within one."""

    def sums(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(values: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
        totals = F.transform(blocks, lambda k: sums(F.slice(values, k * _BLOCK + 1, _BLOCK)))
        nothing = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("before"))
        carried = F.aggregate(
            totals,
            nothing,
            lambda a, x: F.struct((a["total"] + x).alias("total"), F.array_append(a["before"], a["total"]).alias("before")),
            lambda a: a["before"],
        )

        def within(before: Column) -> Column:
            return F.transform(
                values,
                lambda x, i: F.get(before, F.floor(i / _BLOCK).cast("int"))
                + sums(F.slice(values, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1)),
            )

        return F.when(F.size(values) > 0, bind(carried, within)).otherwise(F.array().cast("array<bigint>"))

    return bind(numbers, of)


def _spans(text: Column, kind: str) -> Column:
    """Matches of a kind: array of structs (first, last, kind, match), in code points."""
    pattern = PATTERNS[kind]

    def located(matches: Column) -> Column:
        def place(gaps: Column) -> Column:
            # a match begins behind all gaps and matches before it
            steps = F.transform(
                matches, lambda m, i: F.get(gaps, i) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0))
            )
            return bind(_running(steps), starts_at)

        def starts_at(starts: Column) -> Column:
            def one(match: Column, i: Column) -> Column:
                first = F.get(starts, i)
                return F.struct(
                    first.alias("first"),
                    (first + F.length(match)).alias("last"),
                    F.lit(kind).alias("kind"),
                    match.alias("match"),
                )

            return F.transform(matches, one)

        return bind(F.transform(F.split(text, pattern, -1), F.length), place)

    tried = text.rlike(pattern)
    if kind in _NEEDS:
        needed = F.lit(False)
        for part in _NEEDS[kind]:
            needed = needed | F.contains(text, F.lit(part))
        tried = needed & tried
    none = F.lit(None).cast("array<struct<first: bigint, last: bigint, kind: string, match: string>>")
    return F.when(tried, bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def checked(backwards: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            digit = backwards.substr(i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0

    return bind(F.reverse(digits), checked)


def _in_byte_range(match: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def passes(kind: Column, match: Column) -> Column:
    """The rule of a base kind; null for the kinds that have none."""
    n = F.length(_digits(match))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", _in_byte_range(match))
        .when(kind == "card", n.between(14, 19) & F.when(n.between(14, 19), luhn(_digits(match))).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
    )


def candidates(text: Column) -> Column:
    """All matches of all kinds, with 40 code points before and one after each."""
    found = F.flatten(F.filter(F.array(*[_spans(text, kind) for kind in (*KINDS, *ADDED)]), lambda x: x.isNotNull()))

    def framed(c: Column) -> Column:
        start = F.greatest(c["first"] - 40, F.lit(0)).cast("int")
        return F.struct(
            c["first"].alias("first"),
            F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *ADDED)]), c["kind"]).alias("rank"),
            c["last"].alias("last"),
            c["kind"].alias("kind"),
            c["match"].alias("match"),
            F.coalesce(passes(c["kind"], c["match"]), F.lit(False)).alias("base"),
            text.substr(start + 1, c["first"].cast("int") - start).alias("before"),
            text.substr(c["last"].cast("int") + 1, F.lit(1)).alias("after"),
        )

    return F.array_sort(F.transform(found, framed))


def _any_of(words: str | list[str]) -> str:
    return "|".join(words.split() if isinstance(words, str) else words)


def votes(c: Column) -> list[Column]:
    """1, 0 or -1 (abstains) of each labeler, in the order of LABELERS."""
    kind, match, before = c["kind"], c["match"], F.lower(c["before"])

    def by_kind(tests: dict[str, Column]) -> Column:
        vote = F.lit(-1)
        for name, test in tests.items():
            vote = F.when(kind == name, test.cast("int")).otherwise(vote)
        return vote

    form = by_kind(
        {
            "email": match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
            "ip": match.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
            "card": match.rlike(r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}$"),
            "phone": match.rlike(r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]"),
            "mail": match.rlike(r"dot|\.[A-Za-z]{2,}$"),
            "number": match.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{2,3}[\x20.-][0-9]{4}$"),
            "iban": match.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,}$"),
            "name": match.rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$"),
        }
    )
    gazetteer = by_kind(
        {
            "email": F.lower(match).rlike(rf"\.(?:{_any_of(DOMAINS)})$"),
            "ip": ~match.rlike(r"^(?:0|127|255|22[4-9]|2[3-5][0-9])\."),
            "card": match.rlike(r"^(?:3[47]|4|5[1-5]|2[2-7]|6)"),
            "phone": match.rlike(rf"^\+(?:{_any_of(COUNTRY_CODES)})"),
            "mail": F.lower(match).rlike(rf"(?:{_any_of(DOMAINS)})$"),
            "number": match.rlike(r"^\(?[2-9]"),
            "iban": match.rlike(rf"^(?:{_any_of(IBAN_COUNTRIES)})"),
            "name": match.rlike(r"^(?:Mr|Mrs|Ms|Dr|Herr|Frau|Madame)"),
        }
    )
    cued = by_kind({k: before.rlike(rf"(?<!\p{{L}})(?:{_any_of(w)})(?!\p{{L}})") for k, w in CUES.items()})
    doubted = before.rlike(rf"(?<!\p{{L}})(?:{_any_of(DOUBTS)})(?!\p{{L}})")
    context = F.when(cued == 1, 1).when(doubted, 0).otherwise(-1)
    check = F.coalesce(passes(kind, match).cast("int"), F.lit(-1))
    return [form, gazetteer, context, check]


def features(c: Column) -> list[Column]:
    """Values of the span classifier's features; each is qualified by kind."""
    match = c["match"]
    digits = F.length(_digits(match))
    return [
        F.concat_ws(":", F.lit(name), c["kind"], value.cast("string"))
        for name, value in (
            ("length", F.floor(F.log2(F.length(match)))),
            ("digits", F.least(digits, F.lit(20))),
            ("marks", F.least(F.length(F.regexp_replace(match, r"[\p{L}0-9]", "")), F.lit(6))),
            ("first", F.regexp_extract(match, r"^\+?[0-9]?", 0)),
            ("left", F.when(c["before"].rlike(r"[\p{L}0-9]$"), "word").when(c["before"].rlike(r"[:=#]\s?$"), "sign").otherwise("gap")),
            ("right", F.when(c["after"].rlike(r"[\p{L}0-9]"), "word").otherwise("gap")),
            ("cue", F.lower(c["before"]).rlike(rf"(?:{_any_of(' '.join(CUES.values()))})")),
        )
    ]


# --- learning: on counts only -----------------------------------------------------------


def reliabilities(counts: dict[tuple, int], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Posterior that a span is personal data, for each (kind, votes) that occurs.

    Two chances per labeler (vote 1 given true, given false) and one share per kind, by
    expectation-maximisation from the majority of votes; a pseudo-count of one keeps all open.
    """
    posterior = {}
    for pattern in counts:
        given = [v for v in pattern[1:] if v >= 0]
        posterior[pattern] = (sum(given) + 0.5) / (len(given) + 1)
    for _ in range(rounds):
        right = [[1.0, 2.0] for _ in LABELERS]  # votes 1 among the true, with pseudo-counts
        wrong = [[1.0, 2.0] for _ in LABELERS]
        share: dict[str, list[float]] = {}
        for pattern, n in counts.items():
            p = posterior[pattern]
            s = share.setdefault(pattern[0], [1.0, 2.0])
            s[0] += n * p
            s[1] += n
            for k, vote in enumerate(pattern[1:]):
                if vote >= 0:
                    right[k][0] += n * p * vote
                    right[k][1] += n * p
                    wrong[k][0] += n * (1 - p) * vote
                    wrong[k][1] += n * (1 - p)
        for pattern in counts:
            x = math.log(share[pattern[0]][0] / (share[pattern[0]][1] - share[pattern[0]][0]))
            for k, vote in enumerate(pattern[1:]):
                if vote >= 0:
                    a, b = right[k][0] / right[k][1], wrong[k][0] / wrong[k][1]
                    x += math.log(a / b) if vote else math.log((1 - a) / (1 - b))
            posterior[pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    return posterior


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    pairs = [F.lit(x) for pair in sorted(values.items()) for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def classifier(found: DataFrame) -> Column | None:
    """The chance of a candidate `c` to be personal data, as a function of its features."""
    one = found.select(F.explode("candidates").alias("c"))
    c = F.col("c")
    named = [v.alias(name) for name, v in zip(LABELERS, votes(c), strict=True)]
    voted = written(one.select(c["kind"].alias("kind"), *named, F.array(*features(c)).alias("values")), "votes")
    rows = voted.groupBy("kind", *LABELERS).count().collect()  # at most kinds x 3^4 rows
    if not rows:
        return None
    posterior = reliabilities({(r.kind, *[r[x] for x in LABELERS]): r["count"] for r in rows})
    soft = {"|".join(map(str, pattern)): p for pattern, p in posterior.items()}
    weighed = voted.withColumn("p", _lookup(soft, F.concat_ws("|", "kind", *LABELERS), 0.5))
    sums = (
        weighed.select("p", F.explode("values").alias("value"))
        .groupBy("value")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()  # a few hundred values of bucketed features
    )
    kinds = weighed.groupBy("kind").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    priors = {r.kind: math.log((r.yes + 1) / (r.no + 1)) for r in kinds}
    whole = {r.kind: (r.yes + 1, r.no + 1) for r in kinds}
    odds = {}
    for r in sums:
        yes, no = whole[r.value.split(":")[1]]
        odds[r.value] = math.log((r.yes + 0.5) / yes) - math.log((r.no + 0.5) / no)

    def chance(c: Column) -> Column:
        total = _lookup(priors, c["kind"], -10.0)
        for value in features(c):
            total = total + _lookup(odds, value, 0.0)
        return 1 / (1 + F.exp(-total))

    return chance


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) for every row."""
    text = F.coalesce("text", F.lit(""))
    found = written(docs.select("doc_id", text.alias("text")).select("doc_id", candidates(F.col("text")).alias("candidates")), "candidates")
    chance = classifier(found)
    base = F.filter("candidates", lambda c: c["base"])

    def more(own: Column) -> Column:
        if chance is None:
            return F.filter("candidates", lambda c: F.lit(False))
        return F.filter(
            "candidates",
            lambda c: c["kind"].isin(*ADDED)
            & ~F.exists(own, lambda b: (b["first"] < c["last"]) & (c["first"] < b["last"]))
            & (chance(c) >= SURE),
        )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["first"], c["last"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = found.withColumn("base", base).withColumn("added", more(F.col("base")))
    return spans.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.size("added").cast("long").alias("n_added"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}  # SQL has no match positions; tests compare with a plain scan
