"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their score.

DataFrame functions only. A span is (kind, start, end, value, score) with start and end in code
points, end exclusive. Patterns are written without repeated groups, whose matching needs stack for
each repetition: separators inside a run are first replaced by MARK, one character for one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import apart, named, together

#: A noncharacter that stands for a dot or a separator inside a run; one already in the text counts as OTHER.
MARK, OTHER = "\uffff", "\ufffd"
BASE_KINDS, ADDED_KINDS = ("email", "ip", "card", "phone"), ("iban", "ssn")
#: Words that make a kind likelier if they stand in the CONTEXT characters before a span.
WORDS = {
    "email": ("mail", "contact", "write to", "@"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security"),
}
CONTEXT = 40
#: A kind's score before and with a context word. Base spans stay whatever their score; added ones need ACCEPTED.
SCORES = {"email": (0.9, 1.0), "ip": (0.7, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.9), "iban": (0.8, 1.0), "ssn": (0.4, 0.8)}
ACCEPTED = 0.6
#: The number of characters of an IBAN by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29,
    ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20,
    LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25,
    QA=29, RO=24, RS=22, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
#: Characters that the longest IBAN takes with a blank behind each.
IBAN_REACH = 2 * max(IBAN_LENGTHS.values())


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def worth(i: Column) -> Column:
        v = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a code of A-Z and 0-9 leaves 1 modulo 97 once its first four characters stand last and letters count from 10."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def running(lengths: Column, base: Column) -> Column:
    """base plus the sum of all elements before each one. Sums run in blocks, so the cost isn't that of appending n times."""
    block = 256

    def inner(xs: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("s"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, first, lambda a, x: F.struct((a.s + x).cast("int").alias("s"), F.concat(a.out, F.array(a.s)).alias("out")), lambda a: a.out)

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))), lambda k: F.slice(lengths, k * block + 1, F.lit(block)))
    bases = inner(F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)), base)
    return F.flatten(F.zip_with(blocks, bases, inner))


def placed(x: Column, pattern: str) -> Column:
    """(start, end, value) of every match: what stands between matches gives their places."""
    matches, gaps = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.split(x, pattern, -1)
    starts = running(F.zip_with(matches, F.slice(gaps, F.lit(2), F.size(matches)), lambda m, g: F.length(m) + F.length(g)), F.length(F.get(gaps, F.lit(0))))
    return F.zip_with(matches, starts, lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: By kind: whether a text can hold it at all, what the pattern runs over, the pattern, and what confirms a match.
RULES: dict[str, tuple[Callable, Callable, str, Callable]] = {
    "email": (
        lambda t: F.contains(t, F.lit("@")),
        lambda t: F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK),
        rf"(?:(?<![A-Za-z0-9._%+{MARK}-])|\G)[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++",
        lambda v: F.lit(True),
    ),
    "ip": (
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        lambda t: t,
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda v: v.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    ),
    "card": (
        lambda t: t.rlike("[0-9]"),
        lambda t: F.regexp_replace(t, r"(?<=[0-9])[\x20-](?=[0-9])", MARK),
        rf"(?<![0-9{MARK}])[0-9][0-9{MARK}]{{12,}}+",
        lambda v: F.length(_digits(v)).between(13, 19) & luhn(_digits(v)),
    ),
    "phone": (
        lambda t: F.contains(t, F.lit("+")),
        lambda t: t,
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda v: F.length(_digits(v)).between(9, 15),
    ),
    # the beginning of one; iban_at has the rest
    "iban": (
        lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
        lambda t: t,
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}",
        lambda v: mod97(F.replace(v, F.lit(" "), F.lit(""))),
    ),
    "ssn": (
        lambda t: t.rlike("[0-9]-[0-9]"),
        lambda t: t,
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda v: v.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
    ),
}


def iban_at(text: Column, m: Column) -> Column:
    """The span from a beginning over as many capitals and digits as its country has, single blanks between them; null if there are fewer, or a letter or digit follows."""
    tail = F.substring(text, m.start + 1, F.lit(IBAN_REACH))
    run = F.regexp_extract(tail, rf"^[A-Z0-9](?:\x20?[A-Z0-9]){{0,{IBAN_REACH // 2 - 1}}}", 0)
    length = F.element_at(F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair)), F.substring(m.value, 1, 2))
    ends = F.filter(F.sequence(F.lit(1), F.length(run)), lambda e: F.length(F.replace(F.substring(run, F.lit(1), e), F.lit(" "), F.lit(""))) == length)
    end = F.get(ends, F.lit(0))
    alone = ~F.substring(tail, end + 1, F.lit(1)).rlike("[A-Za-z0-9]")
    return F.when(end.isNotNull() & alone, F.struct(m.start.alias("start"), (m.start + end).alias("end"), F.substring(run, F.lit(1), end).alias("value")))


def _kind(text: Column, kind: str) -> Column:
    possible, over, pattern, confirmed = RULES[kind]
    plain, near = SCORES[kind]

    def scored(m: Column) -> Column:
        begin = F.greatest(m.start - CONTEXT, F.lit(0))
        before = F.lower(F.substring(text, begin + 1, m.start - begin))
        told = F.lit(False)
        for word in WORDS[kind]:
            told = told | F.contains(before, F.lit(word))
        value = F.substring(text, m.start + 1, m.end - m.start)
        return F.struct(F.lit(kind).alias("kind"), m.start.alias("start"), m.end.alias("end"), value.alias("value"), F.when(told, near).otherwise(plain).alias("score"))

    matches = placed(over(text), pattern)
    if kind == "iban":
        matches = F.filter(F.transform(matches, lambda m: iban_at(text, m)), lambda m: m.isNotNull())
    found = F.transform(F.filter(matches, lambda m: confirmed(m.value)), scored)
    return F.when(possible(text), found).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with the spans of personal data in each whole text, by kind (email, ip, card, phone, then iban, ssn), then start.

    email, ip, card and phone are the leftmost matches of their patterns that don't overlap and pass
    their check (parts up to 255, Luhn on 13 to 19 digits, 9 to 15 digits); a match that fails is
    dropped and not tried again from its inside. They stay whatever their score. iban has its
    country's length, in one run or with single blanks, and passes mod-97; ssn needs a context word. Kinds are independent, so spans of two kinds may overlap. A null or
    empty text has no spans. A column of df named like ``out``, in any case of
    letters, is replaced; all others stay. Rows repeat as in df.
    """
    held = apart(df, out, t=F.translate(F.coalesce(named(text), F.lit("")), MARK, OTHER))
    for kind in RULES:
        held = held.withColumn(kind, _kind(F.col("t"), kind))
    added = [F.filter(F.col(k), lambda s: s.score >= ACCEPTED) for k in ADDED_KINDS]
    return together(held, **{out: F.concat(*BASE_KINDS, *added)})


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; of spans that overlap, the one that begins first names them. Null for null."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.concat(a.parts, F.array(F.substring(text, a.at + 1, s.start - a.at), F.concat(F.lit("<"), F.upper(s.kind), F.lit(">"))))
        return F.struct(F.greatest(a.at, s.end).alias("at"), F.when(s.start >= a.at, fresh).otherwise(a.parts).alias("parts"))

    rebuilt = F.aggregate(ordered, first, step, lambda a: F.concat(F.array_join(a.parts, ""), F.substring(text, a.at + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rebuilt).otherwise(text)
