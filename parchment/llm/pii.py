"""Personal data: base patterns, candidate generators and boosted trees; column expressions throughout.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns that pass their
checks; a failing match is dropped without retry. They always stay. High-recall generators then propose further
spans, which may overlap: digit groups, written-out or spaced addresses, account numbers, and long tokens that look
like secrets. Trees score each candidate by its format and its context; a span is added if its score reaches a
threshold that is calibrated on labelled rows so that the wanted precision holds, and if it overlaps no base span and
no added span of an earlier kind or start.

No labels of personal data come with a corpus, so the trees are fitted on planted spans: strings that are personal data
or only look like it (``planted_bank``: made by rule, with known answers) are set into texts of the corpus, whose own
candidates are cut out first. The answer comes from the making, not from the features. Strings are made in forms, and a
third of the forms is held out: thresholds are set on, and figures come from, strings of forms that the trees had not seen;
the trees that are used are then fitted on all forms. Every text takes part; of each only the surroundings of the places
where strings are set are looked at. What is fitted and counted are the distinct rows of features with their numbers.

Offsets are code points, end exclusive. Null and empty texts have no spans. Repeated rows and ties make no difference;
an empty table gives an empty result. Extra columns stay, but for ``base`` and ``spans``, which are replaced.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import let, stage

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans. The second form of each finds the same matches without scanning a run of
#: permitted characters once from each of its positions.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SEARCHED = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
#: A text without this character holds no match.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
#: Candidate kinds beyond the base: pattern, and a cheap pattern without which there is no match.
CANDIDATES = {
    "number": (r"(?<![0-9A-Za-z])[0-9](?:[\x20.()/-]{0,2}[0-9]){6,21}(?![0-9A-Za-z])", r"[0-9]"),
    "address": (r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,63}){1,4}", r"@|\(at\)|\[at\]"),
    "account": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}"),
    "secret": (r"(?<![0-9A-Za-z])[0-9A-Za-z_+/=-]{20,128}(?![0-9A-Za-z])", r"[0-9]"),
}
#: Words within ``CONTEXT`` characters before a candidate that speak for it.
CUES = {
    "number": "phone tel telephone call mobile fax whatsapp ssn passport tax id card visa account telefon téléphone teléfono handy",
    "address": "mail email e-mail contact write address adresse correo kontakt",
    "account": "iban account bank konto compte cuenta bic",
    "secret": "token secret password passwd api_key apikey key pwd bearer auth credential",
}
CONTEXT = 24
FEATURES = ("kind_no", "length", "digits", "digit_share", "letters", "separators", "distinct", "cue", "quoted", "after_equals", "luhn", "mod97", "starts_plus", "has_dot")
PRECISION = 0.95
#: Bins of a feature; Spark takes split places from all rows, if they are at most the square of this.
BINS = 256
#: Planted strings, and how many of them are set into each text at least.
BANK, PLANTED = 4_000, 2
#: Characters before and after the place of a planted string.
AROUND = 200
#: Tasks that look for candidates around planted strings, at least.
PLANT_TASKS = 32
#: Tasks of a fit: some thousands of rows of numbers.
FIT_TASKS = 4
#: Of the forms of each kind, every third is held out.
FORMS_FOLDS = 3


def _matches(text: Column, pattern: str) -> Column:
    """``array<struct<s, e, t>>``: all matches with their code-point offsets.

    The text between matches and the matches themselves, in turn, give the offsets by their lengths.
    """

    def places(between: Column) -> Column:
        def located(found: Column) -> Column:
            step = lambda acc, x: F.struct(
                (acc["at"] + x["b"] + F.length(x["t"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("s"), (acc["at"] + x["b"] + F.length(x["t"])).alias("e"), x["t"].alias("t")))).alias("out"),
            )
            pairs = F.transform(found, lambda t, i: F.struct(F.length(F.get(between, i)).alias("b"), t.alias("t")))
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,t:string>>").alias("out"))
            return F.aggregate(pairs, start, step, lambda acc: acc["out"])

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)

    return let(F.split(text, pattern, -1), places)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, n * 2 - 9).otherwise(n * 2))

    total = F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        parts = F.split(t, r"\.")
        return F.forall(parts, lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(_digits(t), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    return F.lit(True)


SPANS = "array<struct<s:int,e:int,t:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of one kind, in order."""
    found = F.filter(_matches(text, SEARCHED[kind]), lambda m: _valid(kind, m["t"]))
    return F.when(F.contains(text, F.lit(NEEDED[kind])) if kind in NEEDED else text.rlike("[0-9]"), found).otherwise(F.array().cast(SPANS))


def _base_list(base: Column) -> Column:
    def of(kind: str) -> Column:
        return F.transform(base[kind], lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e")))

    return F.concat(*map(of, KINDS))


def _candidates(text: Column) -> Column:
    """``array<struct<kind, s, e, t, before, after>>`` of all generators, in order of kind and start."""

    def of(kind: str) -> Column:
        pattern, needed = CANDIDATES[kind]
        found = F.when(text.rlike(needed), _matches(text, pattern)).otherwise(F.array().cast(SPANS))
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(kind).alias("kind"),
                m["s"].alias("s"),
                m["e"].alias("e"),
                m["t"].alias("t"),
                F.substring(text, F.greatest(m["s"] - CONTEXT + 1, F.lit(1)), F.least(m["s"], F.lit(CONTEXT))).alias("before"),
                F.substring(text, m["e"] + 1, F.lit(4)).alias("after"),
            ),
        )

    return F.concat(*map(of, CANDIDATES))


def _mod97(t: Column) -> Column:
    """Whether an account number's check digits hold (letters count from 10)."""

    def value(chars: Column) -> Column:
        moved = F.concat(F.slice(chars, 5, 64), F.slice(chars, 1, 4))
        code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        step = lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(100)) + code(c), F.lit(97))
        return F.aggregate(moved, F.lit(0), step)

    plain = F.upper(F.regexp_replace(t, "[^0-9A-Za-z]+", ""))
    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (let(F.filter(F.split(plain, ""), lambda x: x != ""), value) == 1)


def _features(c: Column) -> dict[str, Column]:
    """Format and context features of a candidate struct."""
    t = c["t"]
    digits = F.length(_digits(t))
    before = F.lower(c["before"])
    cue = F.lit(False)
    for kind, words in CUES.items():
        cue = cue | ((c["kind"] == kind) & before.rlike("(?:^|[^a-z0-9])(?:" + "|".join(words.split()) + ")[^a-z0-9]*$"))
    as_double = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    number = F.lit(0)
    for i, kind in enumerate(CANDIDATES):
        number = F.when(c["kind"] == kind, F.lit(i)).otherwise(number)
    return {
        "kind_no": as_double(number),
        "length": as_double(F.length(t)),
        "digits": as_double(digits),
        "digit_share": as_double(digits / F.length(t)),
        "letters": as_double(F.length(F.regexp_replace(t, "[^A-Za-z]+", ""))),
        "separators": as_double(F.length(F.regexp_replace(t, "[0-9A-Za-z]+", ""))),
        "distinct": as_double(F.size(F.array_distinct(F.split(t, "")))),
        "cue": as_double(cue),
        "quoted": as_double(before.rlike("[\"']$")),
        "after_equals": as_double(before.rlike("[=:]\\s*[\"']?$")),
        "luhn": as_double(F.when(digits.between(13, 19), luhn(_digits(t))).otherwise(F.lit(False))),
        "mod97": as_double(F.when(c["kind"] == "account", _mod97(t)).otherwise(F.lit(False))),
        "starts_plus": as_double(before.rlike("\\+[0-9 (]*$")),
        "has_dot": as_double(F.contains(t, F.lit("."))),
    }


def candidate_rows(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate: ``kind, s, e, t`` and the features; other columns stay."""
    rows = documents.withColumn("_c", F.explode(let(F.coalesce(F.col(text), F.lit("")), _candidates)))
    return rows.select(*documents.columns, F.col("_c.kind").alias("kind"), F.col("_c.s").alias("s"), F.col("_c.e").alias("e"), F.col("_c.t").alias("t"), *(v.alias(k) for k, v in _features(F.col("_c")).items()))


def planted_bank(n: int = BANK) -> list[tuple[int, str, int, str, str, str, float]]:
    """``id, kind, form, before, span, after, label``: personal data, and strings of the same generators that are none."""
    rng = random.Random(11)
    take = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    digits, upper, lower, hexa = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    shaped = lambda form: "".join(rng.choice(digits) if c == "#" else c for c in form)
    word = lambda: take(lower, rng.randint(2, 9))

    def pick(forms: list) -> tuple:
        k = rng.randrange(len(forms))
        return forms[k], k

    def account(good: bool) -> tuple[str, str, int]:
        body = take(digits, rng.choice([14, 16, 18]))
        country, form = pick(["DE", "ES", "FR", "IT", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        text = f"{country}{check if good else (check + rng.randint(1, 96)) % 97:02d}{body}"
        return rng.choice(["iban ", "IBAN: ", "konto ", "account ", "", "ref "]), " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if rng.random() < 0.5 else text, form

    def number(good: bool) -> tuple[str, str, int]:
        if good:
            shape, form = pick(["(###) ###-####", "###-###-####", "### ### ####", "###-##-####", "0## #######", "0### ######", "06 ## ## ## ##", "## ### ## ##", "###.###.####"])
            cue = rng.choice(["phone: ", "call ", "tel ", "mobile ", "fax: ", "ssn ", "passport no. ", "id: ", "Telefon: ", "téléphone ", "teléfono: ", "whatsapp ", ""])
            return cue, shaped(shape).lstrip("("), form
        shape, form = pick(["20##-##-## ##", "##.##.####-##", "#.###.###.###", "978-#-##-######-#", "##########", "########", "#############", "19## 19## 19##", "###/###/###", "# # # # # # # #", "########-##"])
        return rng.choice(["", "order ", "in ", "no. ", "page ", "total ", "isbn ", "from "]), shaped(shape), form

    def secret(good: bool) -> tuple[str, str, int]:
        if good:
            make, form = pick([lambda: take(hexa, rng.choice([24, 32, 40, 64])), lambda: take(upper + lower + digits, rng.randint(20, 48)), lambda: "AKIA" + take(upper + digits, 16), lambda: "ghp_" + take(upper + lower + digits, 36), lambda: "sk-" + take(upper + lower + digits, 32), lambda: take(upper + lower + digits + "+/", 42) + "=="])
            return rng.choice(['token = "', "api_key=", "password: ", "secret: ", "Authorization: Bearer ", "key='", "pwd=", "", "credential "]), make(), form
        make, form = pick([lambda: take(lower, rng.randint(20, 40)), lambda: "-".join(word() for _ in range(5)) + take(digits, rng.randint(0, 2)), lambda: "_".join([word(), word(), word(), word(), "v1", word()]), lambda: "20" + shaped("##-##-##-") + "-".join(word() for _ in range(3)), lambda: "=" * 24 + "0", lambda: rng.choice(lower) * 30, lambda: "/".join(word() for _ in range(5)) + "/1"])
        return rng.choice(["", "see ", "file ", "name: ", "id=", "/"]), make().ljust(20, "e"), form

    def address(good: bool) -> tuple[str, str, int]:
        (at, dot), form = pick([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", "."), ("@ ", "."), (" @", " . ")])
        if good:
            return rng.choice(["mail ", "contact: ", "write to ", "e-mail ", ""]), f"{word()}{rng.choice(['.', '_', ''])}{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'es', 'fr'])}", form
        make, form = pick([lambda: f"{word()} @ {word()}. {word().capitalize()}", lambda: f"{shaped('##')} @ {shaped('#')}. {word().capitalize()}", lambda: f"{word()} (at) {word()}. {word().capitalize()}"])
        return rng.choice(["we ", "", "the "]), make(), form

    makers = {"number": number, "secret": secret, "address": address, "account": account}
    out = []
    for i in range(n):
        kind, good = list(CANDIDATES)[i % len(CANDIDATES)], i // len(CANDIDATES) % 2 == 0
        before, span, form = makers[kind](good)
        out.append((i, kind, form, before, span, rng.choice([" ", ". ", ", ", '" ', "\n"]), float(good)))
    return out


def planted_rows(documents: DataFrame, text: str = "text") -> DataFrame:
    """``kind, label, unseen, half`` and the features of candidates on planted spans.

    ``unseen`` tells the held-out forms, ``half`` which half of all strings a string is in.
    """
    bank = documents.sparkSession.createDataFrame(planted_bank(), "bank int, planted string, form int, before string, span string, after string, label double")
    own = documents.select(F.col(text).alias("text")).where(F.trim("text") != "")
    # Each text takes some strings, and all of the bank is used however few texts there are.
    each = max(PLANTED, -(-BANK // max(own.count(), 1)))
    number = F.explode(F.transform(F.sequence(F.lit(1), F.lit(each)), lambda k: F.pmod(F.xxhash64("text") + k * 7919, F.lit(BANK)).cast("int")))
    # The surroundings of a place behind a blank, or of the end, without candidates of their own.
    cut = F.pmod(F.xxhash64("text", "bank"), F.length("text")).cast("int")
    blank = F.position(F.lit(" "), F.substring(F.col("text"), cut + 1, F.lit(AROUND)))
    place = F.when(blank > 0, cut + blank).otherwise(F.length("text"))
    near = F.substring(F.col("text"), F.greatest(place - AROUND + 1, F.lit(1)), F.least(place, F.lit(AROUND)))
    rows = own.withColumn("bank", number).select("bank", near.alias("head"), F.substring(F.col("text"), place + 1, F.lit(AROUND)).alias("rest"))
    # Dealt out anew, as a table may stand in few row groups.
    rows = rows.repartition(max(PLANT_TASKS, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for pattern, _ in CANDIDATES.values():
        rows = rows.withColumns({c: F.regexp_replace(c, pattern, " ") for c in ("head", "rest")})
    rows = rows.join(F.broadcast(bank), "bank")  # BANK rows
    head = F.when(F.col("head").endswith(" "), F.col("head")).otherwise(F.concat("head", F.lit(" ")))
    # The digit at the end lets generators look that skip texts without any.
    rows = rows.select(F.concat(head, "before", "span", "after", "rest", F.lit(" 0")).alias("text"), (F.length(head) + F.length("before")).alias("from"), F.length("span").alias("size"), "planted", "label", (F.col("form") % FORMS_FOLDS == FORMS_FOLDS - 1).alias("unseen"), F.pmod(F.xxhash64("span"), F.lit(2)).alias("half"))
    found = candidate_rows(rows).where((F.col("kind") == F.col("planted")) & (F.col("s") < F.col("from") + F.col("size")) & (F.col("e") > F.col("from")))
    return found.select("kind", "label", "unseen", "half", *FEATURES)


def train(documents: DataFrame, text: str = "text", precision: float = PRECISION) -> tuple[list, dict[str, float]]:
    """Trees, and for each kind the least score at which candidates of held-out forms reach the wanted precision."""
    trees, limits, _ = train_and_measure(documents, text, precision)
    return trees, limits


def train_and_measure(documents: DataFrame, text: str = "text", precision: float = PRECISION) -> tuple[list, dict[str, float], dict[str, tuple[float, float, int]]]:
    """Besides, for each kind the precision, recall and number of candidates of held-out forms.

    Trees that have not seen these forms score them: half of the strings set the thresholds, the other half gives the figures.
    The trees that are returned know all forms.
    """
    # Strings and words before them come from the bank, so distinct rows are few however many texts there are.
    planted = planted_rows(documents.select(text), text).groupBy("kind", "label", "unseen", "half", *FEATURES).agg(F.count("*").alias("weight"))
    rows = stage(planted, "planted").coalesce(FIT_TASKS).persist()
    try:
        trees = boosting.fit(rows, list(FEATURES), "label", trees=20, depth=4, weight="weight", bins=BINS)
        judge = boosting.fit(rows.where("not unseen"), list(FEATURES), "label", trees=20, depth=4, weight="weight", bins=BINS)
        scored = rows.where("unseen").select("kind", "half", "label", "weight", F.ceil(boosting.probability(judge, [F.col(c) for c in FEATURES]) * 100).alias("level"))
        table = scored.groupBy("kind", "half", "level").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect()  # at most 202 rows a kind
    finally:
        rows.unpersist()
    limits, figures = {}, {}
    for kind in CANDIDATES:
        own = sorted(((r["level"], r["good"], r["n"]) for r in table if r["kind"] == kind and r["half"] == 0), reverse=True)
        good = n = 0
        limits[kind] = 1.01 if own else 0.5
        for level, g, k in own:
            good, n = good + g, n + k
            if good >= precision * n:
                limits[kind] = (level - 1) / 100
        rest = [r for r in table if r["kind"] == kind and r["half"] == 1]
        above = [r for r in rest if r["level"] - 1 >= 100 * max(limits[kind], 0.5) - 1e-9]
        hits, said, all_good = sum(r["good"] for r in above), sum(r["n"] for r in above), sum(r["good"] for r in rest)
        figures[kind] = (hits / said if said else 1.0, hits / all_good if all_good else 1.0, sum(r["n"] for r in rest))
    return trees, limits, figures


def find(documents: DataFrame, model: tuple[list, dict[str, float]] | None = None, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans``, arrays of ``kind, s, e``: base spans by kind and start; then those added, likewise."""
    trees, limits = model if model is not None else train(documents, text)

    def added(c: Column) -> Column:
        features = _features(c)
        limit = F.lit(1.01)
        for kind, value in limits.items():
            limit = F.when(c["kind"] == kind, F.lit(value)).otherwise(limit)
        return boosting.probability(trees, list(features.values())) >= F.greatest(limit, F.lit(0.5))

    def free(c: Column, taken: Column) -> Column:
        return ~F.exists(taken, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    def merged(base: Column, text_: Column) -> Column:
        own = _base_list(base)

        def more(b: Column) -> Column:
            likely = F.filter(_candidates(text_), lambda c: free(c, b) & added(c))
            plain = F.transform(likely, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
            apart = F.aggregate(plain, F.array().cast("array<struct<kind:string,s:int,e:int>>"), lambda acc, c: F.when(free(c, acc), F.concat(acc, F.array(c))).otherwise(acc))
            return F.struct(b.alias("base"), F.concat(b, apart).alias("spans"))

        return let(own, more)

    def found(t: Column) -> Column:
        kinds = F.struct(*(base_spans(t, k).alias(k) for k in KINDS))
        return let(kinds, lambda b: merged(b, t))

    both = let(F.coalesce(F.col(text), F.lit("")), found)
    kept = [c for c in documents.columns if c not in ("base", "spans")]
    name = "found"
    while name in documents.columns:  # a name that no column has
        name += "_"
    rows = documents.select(*kept, *([] if text in kept else [text]), both.alias(name))
    return rows.select(*kept, F.col(name)["base"].alias("base"), F.col(name)["spans"].alias("spans"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def redact(documents: DataFrame, model: tuple[list, dict[str, float]] | None = None, text: str = "text") -> DataFrame:
    """Each span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    own = documents.select(F.struct(*documents.columns).alias("row"), F.col(text).alias("whole"))
    found = find(own, model, "whole")
    ordered = F.array_sort(F.transform("spans", lambda m: F.struct(m["s"].alias("s"), (-m["e"]).alias("e"), m["kind"].alias("kind"))))

    def rebuilt(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda acc, m: F.when(m["s"] < acc["at"], F.struct(F.greatest(acc["at"], -m["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct((-m["e"]).alias("at"), F.concat(acc["out"], F.substring(F.col("whole"), acc["at"] + 1, m["s"] - acc["at"]), F.lit("<"), F.upper(m["kind"]), F.lit(">")).alias("out"))
        )
        return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("whole"), acc["at"] + 1, F.length(F.col("whole")))))

    clean = F.when(F.size("spans") == 0, F.col("whole")).otherwise(let(ordered, rebuilt))
    return found.select(*(clean.alias(text) if c == text else F.col("row")[c].alias(c) for c in documents.columns))
