"""Personal data: patterns propose spans, checksums confirm them, nearby words move their score.

Only SQL functions are used. Places are found without row code: the pieces between the
matches (``split``) and the matches (``regexp_extract_all``) come from the same leftmost
scan, so running sums of their lengths give every start. Patterns begin only where a run
begins or the last match ended and repeat possessively, so a long run of letters or
digits is walked once and no match recurses.

Kinds with a fixed definition (email, ip, card, phone) always stay when their checks hold;
their context only changes the score. The further kinds (iban, ssn, key) must reach the threshold:
an IBAN by its mod-97 checksum, a social security number by its context, an access key by its form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelgrid.llm.job import fresh

NEAR = 40  # characters of context on either side
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    """A pattern; its score without context, the gain from a context word; whether it stays whatever its score."""

    name: str
    pattern: str
    score: float
    words: str
    gain: float = 0.3
    fixed: bool = False


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write to", 0.1, True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|address|host|server|login|from", 0.3, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|master|amex|credit|payment|karte|carte|tarjeta", 0.2, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax|cell", 0.3, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, "iban|account|bank|konto|compte|cuenta", 0.2),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social security|taxpayer", 0.4),
    Kind("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", 0.8, "aws|key|secret|token|credential", 0.2),
)
BASE = tuple(k.name for k in KINDS if k.fixed)
SPAN = "struct<start:int,rank:int,kind:string,end:int,score:double>"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    at = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(at, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number is 1 modulo 97, with its first four characters moved to the end and letters as numbers."""
    clean = F.replace(account, F.lit(" "))
    chars = F.filter(F.split(F.concat(F.substr(clean, F.lit(5)), F.substring(clean, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        chars, F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)
    )
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.length(digits_of(match))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return digits.between(12, 19) & luhn(digits_of(match))
    if kind == "phone":
        return digits.between(9, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "))).between(15, 34) & mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind as an array, by start; code points, end exclusive."""
    pattern = F.lit(kind.pattern)
    found = F.zip_with(
        F.split(text, kind.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")),
    )
    found = F.filter(found, lambda x: x["match"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int>>")
    placed = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.length(x["match"])).alias("at"),
            F.when(
                confirmed(kind.name, x["match"]),
                F.concat(a["out"], F.array(F.struct(
                    (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + F.length(x["match"])).alias("end")
                ))),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )

    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - NEAR + 1, F.lit(1))
        before = F.substr(text, first, s["start"] - first + 1)
        after = F.substr(text, s["end"] + 1, F.lit(NEAR))
        near = F.lower(F.concat_ws(" ", before, after)).rlike(rf"\b(?:{kind.words})\b")
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), s["end"].alias("end"),
            F.when(near, F.lit(kind.score + kind.gain)).otherwise(F.lit(kind.score)).alias("score"),
        )

    spans = F.transform(placed, scored)
    if not kind.fixed:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    # most rows have no such character run: they skip the two scans and the arrays
    return F.when(text.rlike(kind.pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """Add ``spans``: all personal data of each whole text as structs ordered by start, then kind.

    Null and empty texts have an empty array. Every other column and row stays as it is; a column already called
    ``spans`` is replaced. Spans of different kinds may overlap; those of one kind don't.
    """
    safe = F.coalesce(F.col(text), F.lit(""))
    each = [spans_of(safe, kind, rank) for rank, kind in enumerate(KINDS)]
    return docs.withColumn(spans, F.array_sort(F.concat(*each)))


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of personal data by its kind in angle brackets; nothing else changes. A null text stays null.

    Of overlapping spans the first by start, then by kind, is replaced; the rest of a longer one that reaches beyond is cut too.
    """
    own = fresh(docs, "_pii")
    found = with_spans(docs, text, own)
    piece = lambda a, b: F.substr(F.col(text), a + 1, F.greatest(b - a, F.lit(0)))
    built = F.aggregate(
        F.col(own),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], piece(a["at"], s["start"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)),
    )
    return found.withColumn(text, F.when(F.size(own) > 0, built).otherwise(F.col(text))).drop(own)
