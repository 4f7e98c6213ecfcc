"""Which column is the time, which the label, which are numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from tidepanel.functions import texts
from tidepanel.model import from_micros

PARSED_SHARE = 0.95

# --- fixed values: date formats tried besides ISO ---------------------------------------------
DATE_FORMATS = [
    "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy",
    "yyyy.M.d H:mm:ss", "yyyy.M.d H:mm", "yyyy.M.d",
    "d-MMM-yyyy H:mm:ss", "d-MMM-yyyy",
]


@dataclass(frozen=True)
class ColumnFacts:
    """Facts about one column, all from one aggregation."""

    name: str
    is_time: bool
    is_text: bool
    is_bool: bool
    is_number: bool
    rows: int
    known: int
    times: int
    lo: float | None
    hi: float | None
    between: int

    @property
    def parsed_share(self) -> float:
        return self.times / self.rows if self.rows else 0.0

    @property
    def is_binary(self) -> bool:
        """Exactly the values 0 and 1."""
        return self.lo == 0.0 and self.hi == 1.0 and self.between == 0


@dataclass(frozen=True)
class Roles:
    time_col: str | None
    label_col: str | None
    features: list[str]
    dropped: list[str]


def has_time_word(name: str, strict_reference: bool = False) -> bool:
    """Whole words by default; ``strict_reference`` also takes ``runtime`` or ``odds``."""
    low = name.strip().lower()
    if strict_reference:
        return any(word in low for word in texts.TIME_WORDS)
    parts = [p for p in re.split(r"[\W_0-9]+", low) if p]
    ascii_words = [w for w in texts.TIME_WORDS if w.isascii()]
    other_words = [w for w in texts.TIME_WORDS if not w.isascii()]
    return any(p in ascii_words for p in parts) or any(w in low for w in other_words)


def is_label_name(name: str) -> bool:
    return name.strip().lower() in texts.LABEL_NAMES


def parse_text_time(column: Column | str) -> Column:
    """Wall-clock time of a text; NULL if no format fits. A zone in the text is dropped."""
    name = column if isinstance(column, str) else None
    text = F.col(f"`{name}`") if name else column
    iso = text.try_cast("timestamp_ntz")
    other = F.lit(None).cast("timestamp_ntz")
    for pattern in reversed(DATE_FORMATS):
        parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
        other = F.when(text.rlike(_shape(pattern)), parsed).otherwise(other)
    # all formats begin with a number and one of these marks: other numbers need not be tried with each
    return F.when(iso.isNotNull(), iso).otherwise(F.when(text.rlike("^[0-9]{1,4}[-./]"), other))


def _shape(pattern: str) -> str:
    """Regular expression of texts a date format can fit: a failed parse costs far more than this."""

    def part(letters: re.Match) -> str:
        run = letters.group()
        if run == "MMM":
            return "[A-Za-z]{3}"
        return "[0-9]{1,2}" if len(run) == 1 else f"[0-9]{{{len(run)}}}"

    return "^" + re.sub(r"(y+|M+|d+|H+|m+|s+)", part, pattern.replace(".", r"\.")) + "$"


def parse_epoch(column: Column) -> Column:
    """Numbers count as nanoseconds since the epoch; they have more digits than a double holds."""
    return from_micros(F.floor(column.cast("string").try_cast("decimal(38,9)") / 1000).cast("bigint"))


def parse_time(name: str, facts: dict[str, ColumnFacts]) -> Column:
    fact = facts[name]
    column = F.col(f"`{name}`")
    if fact.is_time:
        return column.cast("timestamp_ntz")
    return parse_epoch(column) if fact.is_number else parse_text_time(name)


def label_value(name: str) -> Column:
    """0 or 1 from a number, a boolean or its text; NULL counts as 0."""
    text = F.lower(F.col(f"`{name}`").cast("string"))
    number = text.try_cast("double").try_cast("int")
    return F.coalesce(F.when(text == "true", 1).when(text == "false", 0).otherwise(number), F.lit(0))


def profile(rows: DataFrame, strict_reference: bool = False) -> dict[str, ColumnFacts]:
    """Facts about every column in one pass over the data; one row reaches the driver."""
    wanted: list[Column] = [F.count(F.lit(1)).alias("rows")]
    fields = {f.name: f.dataType for f in rows.schema.fields}
    for i, (name, kind) in enumerate(fields.items()):
        column = F.col(f"`{name}`")
        wanted.append(F.count(column).alias(f"known{i}"))
        if isinstance(kind, (StringType, NumericType)):
            number = column.try_cast("double")
            wanted += [
                F.count(number).alias(f"numbers{i}"),
                F.min(number).alias(f"lo{i}"),
                F.max(number).alias(f"hi{i}"),
                F.count_if((number != 0) & (number != 1)).alias(f"between{i}"),
            ]
        if isinstance(kind, StringType):
            truth = F.lower(column).isin("true", "false")
            wanted.append(F.count_if(truth).alias(f"truths{i}"))
            wanted.append(F.count(parse_text_time(name)).alias(f"times{i}"))
    got = rows.agg(*wanted).first().asDict()
    facts = {}
    for i, (name, kind) in enumerate(fields.items()):
        known = got[f"known{i}"]
        is_time = isinstance(kind, (TimestampType, TimestampNTZType, DateType))
        text = isinstance(kind, StringType)
        is_bool = isinstance(kind, BooleanType) or (text and known > 0 and got[f"truths{i}"] == known)
        is_number = isinstance(kind, NumericType) or (
            text and not is_bool and got[f"numbers{i}"] == known
        )
        facts[name] = ColumnFacts(
            name=name,
            is_time=is_time,
            is_text=text and not is_number and not is_bool,
            is_bool=is_bool,
            is_number=is_number,
            rows=got["rows"],
            known=known,
            times=got[f"times{i}"] if text and not is_number else known,
            lo=got.get(f"lo{i}"),
            hi=got.get(f"hi{i}"),
            between=got.get(f"between{i}") or 0,
        )
    return facts


def detect_time_column(
    facts: dict[str, ColumnFacts], strict_reference: bool = False
) -> str | None:
    """A typed time column first; else the best of those that parse, a telling name counting more."""
    for fact in facts.values():
        if fact.is_time:
            return fact.name
    best: tuple[int, str] | None = None
    for fact in facts.values():
        named = has_time_word(fact.name, strict_reference)
        if not (fact.is_text or (named and fact.is_number)):
            continue
        if fact.parsed_share >= PARSED_SHARE:
            score = 3 if named else 1
            if best is None or score > best[0]:
                best = (score, fact.name)
    return best[1] if best else None


def detect_label_column(facts: dict[str, ColumnFacts], skip: str | None) -> str | None:
    """First column with a label's name and 0/1 values, or with exactly the values 0 and 1."""
    for fact in facts.values():
        if fact.name == skip or not (fact.is_number or fact.is_bool):
            continue
        named = is_label_name(fact.name)
        if fact.is_bool and named:
            return fact.name
        zero_one = fact.known > 0 and fact.between == 0
        if fact.is_number and (fact.is_binary or (named and zero_one)):
            return fact.name
    return None


def choose(facts: dict[str, ColumnFacts], strict_reference: bool = False) -> Roles:
    time_col = detect_time_column(facts, strict_reference)
    label_col = detect_label_column(facts, time_col)
    rest = [f for f in facts.values() if f.name not in (time_col, label_col)]
    return Roles(
        time_col=time_col,
        label_col=label_col,
        features=[f.name for f in rest if f.is_number],
        dropped=[f.name for f in rest if not f.is_number],
    )
