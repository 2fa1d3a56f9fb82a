"""Personal data, with DataFrame expressions only.

Regular expressions propose spans, leftmost and non-overlapping for each kind; validators confirm them: Luhn's digits
for cards, the mod-97 remainder for IBANs, ranges and digit counts for the rest. A proposal that fails is dropped and not
retried, but for IBANs: where one may begin, every end of 15 to 34 characters at a word's edge is tried, and of those whose
remainder holds the one of the country's length is taken, else the longest. Each span has a score: what its kind is worth, more if a checksum holds, more if a word of its kind's context
stands nearby. The base kinds (email, ip, card, phone) stay at any score; iban and ssn need `threshold`.

Offsets are code points, ends exclusive. A null text is an empty one and has no spans; a null id stays. Texts of any
length are read whole: the patterns below never go back over a run, and whatever stands somewhere in a text is read from
pieces of `PIECE` characters, so the time grows with the text and with its matches (times their logarithm), not with their square. Repeated
rows give equal results; an empty table gives an empty one. Other columns of the input stay: mask() keeps all of them under any
name, spans_column() replaces a column named as its result, detect() returns its own alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in the order of their names in results.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"

#: Proposals, in Java's syntax. They match what the plain patterns match: a match can only begin where its first run
#: begins or where the last match ended (\G), and no run has to give characters back, so runs are possessive.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",  # only where one begins; _ibans() finds the end
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: The whole of what an IBAN may be, and its most characters with a blank before each behind the first four.
IBAN, IBAN_CHARS = r"\A[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\z", 64

#: Characters of an IBAN by country.
IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

#: What a text must hold for a kind's proposals to be looked for.
HINTS = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.instr(t, "+") > 0,
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}

#: Characters of the pieces in which a text is read, and elements of the lists that are put together into one.
PIECE, SOME = 512, 256

#: Worth of a kind, and of its checksum.
WORTH = {"email": (0.8, 0.0), "ip": (0.6, 0.0), "card": (0.3, 0.4), "phone": (0.6, 0.0), "iban": (0.3, 0.5), "ssn": (0.3, 0.0)}

#: Words that raise a score by CONTEXT_WORTH when they stand within CONTEXT_CHARS before a span or half as many after it.
CONTEXT = {
    "email": "mail|email|contact|write",
    "ip": "ip|address|server|host",
    "card": "card|visa|mastercard|amex|credit|payment",
    "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|bank|account|konto|transfer",
    "ssn": "ssn|social|security",
}
CONTEXT_WORTH, CONTEXT_CHARS = 0.3, 60


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, op) -> Column:
    """The running sums (or whatever op gives) of an array<int>, by steps of 1, 2, 4 and so on."""

    def steps(own: Column) -> Column:
        strides = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(own)))), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(strides, own, lambda a, d: F.transform(a, lambda x, i: F.when(i >= d, op(x, F.get(a, i - d))).otherwise(x)))

    return _let(values, steps)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _near(pieces: Column, start: Column, n: Column) -> Column:
    """At most PIECE characters from start (0 or more) on."""
    number = F.floor(start / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, number), F.lit("")), F.coalesce(F.get(pieces, number + 1), F.lit("")))
    return F.substring(two, start - number * PIECE + 1, n)


def _stretch(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, however many."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    one = F.substring(F.get(pieces, first), start - first * PIECE + 1, end - start)
    many = F.concat(F.substring(F.get(pieces, first), start - first * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(F.get(pieces, last), F.lit(1), end - last * PIECE))
    return F.when(end <= start, "").when(first == last, one).otherwise(many)


def _proposals(text: Column, kind: str) -> Column:
    """array<struct<start,end,found>> of all matches. The gaps between matches (split) and the matches themselves
    give the offsets, in code points."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(gaps, found, lambda g, f: F.struct(F.length(f).alias("n"), (F.length(g) + F.length(f)).alias("step"), f.alias("found")))

    def placed(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda x: x["step"]), lambda x, y: x + y)
        return F.zip_with(pairs, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), end.alias("end"), x["found"].alias("found")))

    return _let(F.filter(pairs, lambda x: x["found"].isNotNull()), placed)


def _ibans(text: Column, pieces: Column) -> Column:
    """array<struct<start,end,found>> of valid IBANs, leftmost and non-overlapping: of each begin's ends the best one."""
    known = F.create_map(*[F.lit(x) for item in IBAN_LENGTH.items() for x in item])

    def best(x: Column) -> Column:
        """The end of an IBAN that begins at x, as a struct that sorts by worth; null if there is none."""
        return _let(_near(pieces, x["start"], F.lit(IBAN_CHARS + 1)), best_of)

    def best_of(piece: Column) -> Column:

        def end(n: Column) -> Column:
            found = F.substring(piece, F.lit(1), n)
            usual = F.length(F.regexp_replace(found, " ", "")) == F.coalesce(F.try_element_at(known, F.substring(found, 1, 2)), F.lit(0))
            return F.struct(usual.alias("usual"), n.alias("n"), found.alias("found"))

        edge = lambda n: ~F.substring(piece, n + 1, F.lit(1)).rlike("[A-Za-z0-9]") & F.substring(piece, n, F.lit(1)).rlike("[A-Z0-9]")
        lengths = F.filter(F.sequence(F.lit(15), F.least(F.length(piece), F.lit(IBAN_CHARS))), edge)
        ends = F.filter(F.transform(lengths, end), lambda e: e["found"].rlike(IBAN) & _valid("iban", e["found"]))
        return F.array_max(ends)

    empty = F.expr("array()").cast("array<struct<start:int,end:int,found:string>>")
    lists = F.expr("array()").cast("array<array<struct<start:int,end:int,found:string>>>")

    def step(acc: Column, x: Column) -> Column:
        """Lists of SOME, so that no long list is copied at each step."""
        new = F.struct(x["start"].alias("start"), (x["start"] + x["best"]["n"]).alias("end"), x["best"]["found"].alias("found"))
        full = F.size(acc["out"]) >= SOME
        lists = F.when(full, F.concat(acc["lists"], F.array(acc["out"]))).otherwise(acc["lists"])
        out = F.concat(F.when(full, empty).otherwise(acc["out"]), F.array(new))
        return F.when((x["start"] >= acc["at"]) & x["best"].isNotNull(), F.struct(new["end"].alias("at"), out.alias("out"), lists.alias("lists"))).otherwise(acc)

    each = F.transform(_proposals(text, "iban"), lambda x: F.struct(x["start"].alias("start"), best(x).alias("best")))
    return F.aggregate(each, F.struct(F.lit(0).alias("at"), empty.alias("out"), lists.alias("lists")), step, lambda acc: F.concat(F.flatten(acc["lists"]), acc["out"]))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check: from the right, every second digit doubled, nines cast out."""
    back = F.split(F.reverse(digits), "")
    each = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(found: Column) -> Column:
    """Whether an IBAN leaves 1: its first four characters moved to the end, letters as numbers from 10."""
    plain = F.regexp_replace(found, " ", "")
    moved = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + (F.ascii(c) - 48)) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def _part_ok(part: Column) -> Column:
    """A number of at most 255, however many zeros lead it."""
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 3) & (F.coalesce(F.when(F.length(bare) <= 3, F.when(bare == "", 0).otherwise(bare.cast("int"))), F.lit(999)) <= 255)


def _valid(kind: str, found: Column) -> Column:
    n = F.length(_digits(found))
    if kind == "ip":
        return F.forall(F.split(found, r"\."), _part_ok)
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(found))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(found, " ", "")).between(15, 34) & _mod97(found)
    if kind == "ssn":
        return ~found.substr(1, 3).isin("000", "666") & ~found.startswith("9") & (found.substr(5, 2) != "00") & (found.substr(8, 4) != "0000")
    return F.lit(True)


def _spans(text: Column, pieces: Column, kind: str, threshold: float) -> Column:
    """Confirmed spans of a kind with their scores: array<struct<start,rank,end,score>>."""
    rank = KINDS.index(kind)
    worth, check = WORTH[kind]

    def scored(x: Column) -> Column:
        before = _near(pieces, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)), F.least(x["start"], F.lit(CONTEXT_CHARS)))
        after = _near(pieces, x["end"], F.lit(CONTEXT_CHARS // 2))
        near = F.concat(before, F.lit(" "), after).rlike(rf"(?i)\b(?:{CONTEXT[kind]})s?\b")
        score = F.lit(worth + check) + F.when(near, CONTEXT_WORTH).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    valid = _ibans(text, pieces) if kind == "iban" else F.filter(_proposals(text, kind), lambda x: _valid(kind, x["found"]))
    confirmed = F.transform(valid, scored)
    if kind not in BASE:
        confirmed = F.filter(confirmed, lambda s: s["score"] >= threshold)
    empty = F.expr("array()").cast("array<struct<start:int,rank:int,end:int,score:double>>")
    return F.when(HINTS[kind](text), confirmed).otherwise(empty)


def _all_spans(text: Column, threshold: float) -> Column:
    any_hint = HINTS[KINDS[0]](text)
    for k in KINDS[1:]:
        any_hint = any_hint | HINTS[k](text)
    found = _let(_pieces(text), lambda pieces: F.array_sort(F.concat(*[_spans(text, pieces, k, threshold) for k in KINDS])))
    return F.when(any_hint, found).otherwise(F.expr("array()").cast("array<struct<start:int,rank:int,end:int,score:double>>"))


def spans_column(docs: DataFrame, text_col: str = "text", out: str = "spans", threshold: float = 0.5) -> DataFrame:
    """docs with a column `out`: array<struct<start,rank,end,score>>, by start, then kind in the order of KINDS."""
    return docs.withColumn(out, _all_spans(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), threshold))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first one's kind stands."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put_together(spans: Column, reached: Column, pieces: Column) -> Column:
        """reached: how far each span and those before it go."""
        before = F.concat(F.array(F.lit(0)), reached)
        each = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda s, at: F.when(s["start"] >= at, F.concat(_stretch(pieces, at, s["start"]), F.element_at(names, s["rank"] + 1))).otherwise(""))
        last = F.element_at(reached, -1)
        return F.concat(F.array_join(each, ""), _stretch(pieces, last, F.length(text)))

    def on(spans: Column) -> Column:
        reached = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return _let(reached, lambda r: _let(_pieces(text), lambda pieces: put_together(spans, r, pieces)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(spans, on))


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with the spans in text_col masked (a null stays) and, if named, the text's length in length_col. All columns stay in their places."""
    text = F.col(f"`{text_col}`").cast("string")
    # the rows' own columns travel as one, so that no name of theirs can meet one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("t"), _all_spans(F.coalesce(text, F.lit("")), threshold).alias("spans"))
    rows = rows.select("doc", F.when(F.col("t").isNotNull(), masked(F.col("t"), F.col("spans"))).alias("m"))
    now = {text_col: F.col("m"), length_col: F.coalesce(F.length("m"), F.lit(0)).cast("long")}
    return rows.select(*[now[c].alias(c) if c in now else F.col("doc").getField(c).alias(c) for c in docs.columns])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = docs.select(F.col(id_col), _all_spans(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), threshold).alias("found"))
    number = lambda k: F.size(F.filter("found", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(id_col, *[number(k) for k in BASE], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))
