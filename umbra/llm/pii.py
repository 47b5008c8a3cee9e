"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. Built-in SQL functions only.

The score starts from what a confirmed match of its kind is worth by itself; words of the kind up to 48 characters away (or five
matches of the kind, if those are nearer) raise it, words that number other things lower it.

Null text: no spans. Empty text: no spans. Very long texts: as any other, in time that grows with the text. Equal rows: equal
results, row by row. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.spans import Rule, count_kind, listed, masked, of_kinds, with_spans

BASE = ("email", "ip", "card", "phone")

# Possessive loops and starts held to the head of a run keep each pattern linear in the text; a run's head and its later
# characters reach the same run end, so the leftmost matches are the same. \G admits a start right after the last match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Length of an account number by the country that leads it. Fixed values.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 "
    "TN24 TR26 UA29 VA22 VG24 XK20"
).split()
#: Words that make a kind likelier, and words that make a number of any kind unlikelier.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|kontakt|correo|courriel)",
    "ip": r"(?i)\b(?:ip|host|server|address|client|login|connect|ping|network)",
    "card": r"(?i)\b(?:card|visa|master\s?card|amex|credit|debit|payment|karte|tarjeta|carte)",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|whatsapp|telefon|tel[eé]fono)",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta|transfer)",
    "ssn": r"(?i)\b(?:ssn|social security|tax id|taxpayer|national id)",
}
AGAINST = r"(?i)\b(?:version|release|serial|part no|sku|isbn|issn|order no|order number|invoice|tracking|commit|example|sample|test)\b"
#: Score of a confirmed match by itself, and what the two sorts of words add or take.
ALONE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
MORE, LESS = 0.3, 0.3


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of `x` pass Luhn's check."""
    d = F.reverse(digits(x))
    doubled = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number, four leading characters moved to its end and letters read as 10 to 35, leaves 1 modulo 97."""
    flat = F.upper(F.regexp_replace(x, r"\x20", ""))
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))

    def step(a: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, (a * 100 + n - 55) % 97).otherwise((a * 10 + n - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


def _country(x: Column) -> Column:
    flat = F.regexp_replace(x, r"\x20", "")
    return F.concat(F.substring(flat, 1, 2), F.length(flat).cast("string")).isin(*IBAN_LENGTHS)


def _near(kind: str):
    def score(value: Column, before: Column, after: Column) -> Column:
        around = F.concat_ws(" ", before, after)
        change = F.when(around.rlike(CONTEXT[kind]), F.lit(MORE)).otherwise(F.lit(0.0)) - F.when(around.rlike(AGAINST), F.lit(LESS)).otherwise(F.lit(0.0))
        return F.round(F.greatest(F.least(F.lit(ALONE[kind]) + change, F.lit(1.0)), F.lit(0.0)), 2)

    return score


def rules(least: float = 0.5) -> list[Rule]:
    """The base kinds, always kept, each with its score; and those that the score decides: a valid IBAN stands unless words nearby
    speak against it, a number of the pattern of a social security number needs a word nearby."""
    some_digit = lambda t: t.rlike("[0-9]")
    return [
        Rule("email", EMAIL, lambda t: t.contains("@"), None, _near("email")),
        Rule("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets, _near("ip")),
        Rule("card", CARD, some_digit, lambda m: F.length(digits(m)).between(12, 19) & luhn(m), _near("card")),
        Rule("phone", PHONE, lambda t: t.contains("+"), lambda m: F.length(digits(m)).between(9, 15), _near("phone")),
        Rule("iban", IBAN, some_digit, lambda m: _country(m) & mod97(m), _near("iban"), least),
        Rule("ssn", SSN, some_digit, lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), _near("ssn"), least),
    ]


def find(docs: DataFrame, text_col: str = "text", out: str = "pii", least: float = 0.5) -> DataFrame:
    """Adds `out`, the spans of personal data that reach the score `least`."""
    return with_spans(docs, text_col, rules(least), out)


def redact(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in square brackets."""
    found = find(docs, text_col, "__pii", least)
    clean = masked(found, text_col, "__pii", lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return found.select(
        "doc_id",
        *[count_kind(F.col("pii"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(of_kinds(F.col("pii"), BASE)), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
