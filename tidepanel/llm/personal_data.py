"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, checksums and ranges confirm or reject them, and words shortly
before or after a span raise its score. Repetitions are possessive or bounded and runs are entered at their
beginning only, so the time of a text is in proportion to its length whatever it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.tables import text_of

CONTEXT_CHARS = 50
BLOCK = 64
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: pattern, check of a match, score without and with context words."""

    name: str
    pattern: str
    check: str
    hint: str
    context: str
    score: float
    raised: float
    least: float = 0.0


#: The four base kinds, whose spans always stay. The patterns match what these do, leftmost first:
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#:   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card  [0-9]([\x20-]?[0-9])+   with 16 to 19 digits
#:   phone \+[0-9][\x20().0-9-]+[0-9]
BASE = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "none",
        "@",
        r"mail|contact|kontakt|correo|courriel",
        0.9,
        0.95,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "parts",
        ".",
        r"\bip\b|address|adresse|direcci|host|server",
        0.6,
        0.8,
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
        "luhn",
        "",
        r"card|visa|master|amex|karte|carte|tarjeta",
        0.8,
        0.95,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "digits",
        "+",
        r"phone|tel\b|call|mobile|telefon|t[ée]l[ée]",
        0.6,
        0.85,
    ),
)
#: Further kinds; their spans count from the score ``least``.
MORE = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "mod97",
        "",
        r"iban|account|konto|compte|cuenta",
        0.8,
        0.95,
        0.7,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "none",
        "-",
        r"ssn|social security",
        0.4,
        0.8,
        0.7,
    ),
)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit at the end is right."""
    backward = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        value = F.substring(backward, i, F.lit(1)).cast("int") * (F.lit(1) + (i + 1) % 2)
        return total + value - F.when(value > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 by ISO 7064."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        sign = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(sign < 58, rest * 10 + sign - 48).otherwise(rest * 100 + sign - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), add) == 1


def small_parts(ip: Column) -> Column:
    """Whether every part is at most 255; leading zeros are allowed."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _passes(kind: Kind, match: Column) -> Column:
    if kind.check == "parts":
        return small_parts(match)
    if kind.check == "luhn":
        return luhn(digits_of(match))
    if kind.check == "digits":
        return F.length(digits_of(match)).between(8, 15)
    if kind.check == "mod97":
        account = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(account).between(15, 34) & mod97(account)
    return F.lit(True)


def spans_of(text: Column, kind: Kind) -> Column:
    """Ascending spans of a kind in code points, end exclusive.

    What lies between the matches gives their places: the text is cut at the pattern, and lengths are
    added up, first over blocks of matches and then inside each block, so that no array grows by one
    element at a time over a whole long text. A match that fails its check is passed over whole. The
    context of a match is the text around it, up to the matches before and after.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def alternating(gaps: Column) -> Column:
        following = F.slice(gaps, F.lit(2), F.size(gaps))
        return F.arrays_zip(gaps.alias("gap"), matches.alias("match"), following.alias("after"))

    # \G and lookbehinds see the same text in both, so pieces and matches alternate
    cut = F.get(F.transform(F.array(F.split(text, kind.pattern, -1)), alternating), F.lit(0))

    def taken(at: Column, z: Column) -> Column:
        start, match = at + F.length(z["gap"]), z["match"]
        # a sign that no context word holds keeps words of the two sides apart
        around = F.concat(
            F.substring(z["gap"], -CONTEXT_CHARS, CONTEXT_CHARS),
            F.lit(" \n "),
            F.coalesce(F.substring(z["after"], 1, CONTEXT_CHARS), F.lit("")),
        )
        score = F.when(F.lower(around).rlike(kind.context), kind.raised).otherwise(kind.score)
        span = F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            score.alias("score"),
        )
        passes = match.isNotNull() & _passes(kind, match) & (score >= kind.least)
        return F.when(passes, F.array(span).cast(SPAN)).otherwise(F.array().cast(SPAN))

    def width(z: Column) -> Column:
        return F.length(z["gap"]) + F.coalesce(F.length(z["match"]), F.lit(0))

    def in_block(block: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(
            block,
            first,
            lambda seen, z: F.struct(
                (seen["at"] + width(z)).alias("at"), F.concat(seen["out"], taken(seen["at"], z)).alias("out")
            ),
            lambda seen: seen["out"],
        )

    def in_blocks(cut: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(cut, b * BLOCK + 1, BLOCK),
        )
        widths = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda n, z: n + width(z)))
        starts = F.aggregate(
            widths, F.array(F.lit(0)), lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n))
        )
        return F.flatten(
            F.filter(F.zip_with(blocks, starts, lambda x, at: F.when(x.isNotNull(), in_block(x, at))), lambda x: x.isNotNull())
        )

    # transform() over one element names the pieces, which are then worked out once
    found = F.get(F.transform(F.array(cut), in_blocks), F.lit(0))
    # most texts hold none, which a plain search tells
    possible = F.contains(text, F.lit(kind.hint)) & text.rlike(kind.pattern) if kind.hint else text.rlike(kind.pattern)
    return F.when(possible, found).otherwise(F.array().cast(SPAN))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and, for each kind, an array of its spans (kind, start, end, score).

    A span has its higher score when a context word stands within 50 characters before or after it. A
    null text counts as empty and has no spans; rows that repeat give repeated results.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.select("doc_id", *[spans_of(text, k).alias(k.name) for k in (*BASE, *MORE)])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans, from ``find_personal_data``."""
    base = F.concat(*[F.col(k.name) for k in BASE])
    spans = F.concat(*[F.col(k.name) for k in (*BASE, *MORE)])
    return found.select(
        "doc_id",
        *[F.size(k.name).cast("bigint").alias(f"n_{k.name}") for k in BASE],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["score"] >= 0.8)).cast("bigint").alias("n_certain"),
    )
