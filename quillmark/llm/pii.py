"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score. All of it is native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import texts
from quillmark.llm.native_spans import counted, listed, matches, merged, of_kind, spans

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order that ties take; the last two are proposed by this method alone.
KINDS = (*BASE, "iban", "ssn")
#: Score of a confirmed span, words that raise it by RAISE within NEAR characters before it, and the score below which a span beyond the base is dropped.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "host|server|address|ip",
    "card": "card|visa|credit|pay|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance|tax",
}
RAISE, NEAR, LEAST = 0.3, 40, 0.5
#: The base patterns; guards and possessive repeats don't change what they match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole chain of 14 to 19 digits; chains of other lengths would be dropped anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: A code has the length of its country, so that a word in capitals after it isn't taken in.
IBAN = (
    "(?<![A-Za-z0-9])(?:"
    + "|".join(rf"(?:{'|'.join(c for c, m in IBAN_LENGTHS.items() if m == n)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n in sorted(set(IBAN_LENGTHS.values())))
    + ")(?![A-Za-z0-9])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def add(total, x):
        even = F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)
        return total + F.when(x["i"] % 2 == 1, even).otherwise(x["d"])

    places = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.struct(F.coalesce(c.try_cast("int"), F.lit(0)).alias("d"), i.alias("i")))
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an IBAN without spaces has the remainder 1: letters count as 10 to 35, the first four characters go last."""
    turned = F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4))

    def add(rest, c):
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c))) == 1


def found_spans(text: Column) -> Column:
    """All spans of a text column without nulls, with scores."""

    def score(kind):
        def of(x):
            first = F.greatest(x["start"] - NEAR, F.lit(0))
            before = F.substring(text, (first + 1).cast("int"), (x["start"] - first).cast("int"))
            return F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(F.lower(before).rlike(CONTEXT[kind]), RAISE).otherwise(0.0))

        return of

    digit = text.rlike("[0-9]")
    length = lambda x: F.length(digits(x))
    checks = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, digit & F.contains(text, F.lit(".")), lambda x: x.rlike(_OCTETS)),
        "card": (CARD, digit, lambda x: luhn(digits(x))),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda x: length(x).between(10, 15)),
        "iban": (IBAN, digit, lambda x: mod97(F.replace(x, F.lit(" "), F.lit("")))),
        "ssn": (SSN, digit & F.contains(text, F.lit("-")), None),
    }
    parts = []
    for rank, kind in enumerate(KINDS):
        pattern, hint, keep = checks[kind]
        one = spans(matches(text, pattern, hint), kind, rank, keep, score(kind))
        parts.append(one if kind in BASE else F.filter(one, lambda x: x["score"] >= LEAST))
    return merged(*parts)


def pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): the spans of every whole text as an array of (start, rank, end, kind, score), one row per row of ``docs``, repeated rows included.

    Null and empty texts have none; texts may have any length; a null key stays null; an empty table gives no rows. Spans that begin together are in the order of KINDS.
    Other columns, whatever their names, don't matter.
    """
    return texts(docs, key, text).select("doc_id", found_spans(F.col("text")).alias("found"))


def pii_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, top_score) of every row; see ``pii`` for nulls and other cases."""
    found = F.col("found")
    return pii(docs, key, text).select(
        "doc_id", *(counted(found, k).alias(f"n_{k}") for k in BASE), F.sha2(listed(of_kind(found, *BASE)), 256).alias("base_sha256"), listed(found).alias("spans"),
        F.size(found).cast("long").alias("n_found"), F.coalesce(F.array_max(F.transform(found, lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
    )
