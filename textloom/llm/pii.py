"""Personal data: expressions propose spans, checksums confirm, context adjusts.

Each kind has an expression, a validator and a starting score. The texts around
a match are its pieces between matches, so positions (code points, end
exclusive) are running sums of lengths; the sums run in blocks, so a text with
very many matches costs little more than its length. Words near a match raise or
lower its score; spans that reach the threshold are reported. E-mail addresses,
IPv4 addresses, card numbers (Luhn) and international phone numbers that pass
their validator always do; IBANs (mod-97), national id and local phone numbers
and credentials are added to them where they don't overlap those.

All of it is built-in functions; long matches need no regex stack, as the loops
are possessive, which changes no match: nothing that follows a loop could match
what the loop takes.

Defined cases: a null text counts as empty; equal spans of two kinds are both
reported; repeated rows give repeated results; other columns are kept by
`redact` and not read by `find`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Code points before and after a span in which context words count.
NEAR = 40
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    proposed: str  # an expression that texts with a match have, cheap to search
    score: float
    confirmed: float  # added if the validator agrees
    raising: str = ""
    lowering: str = ""


_MAIL = "A-Za-z0-9._%+-"
#: The four base kinds, in the order in which they are listed.
BASE = (
    Kind("email", rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.2),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", 0.3, 0.7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", r"[0-9](?:[\x20-]?[0-9]){11}", 0.2, 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.3, 0.7),
)
#: What the method adds; no match may touch a base span.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", 0.1, 0.7, "iban|account|bank|konto|compte|cuenta"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, 0.0, "ssn|social security|tax id", "order|invoice|part|version"),
    Kind("local_phone", r"(?<![0-9+)(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])", r"[0-9]{3}[-.][0-9]{4}", 0.3, 0.0, "phone|call|tel|mobile|fax|contact", "order|invoice|part|version"),
    Kind("credential", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{18,64})(?![A-Za-z0-9])", r"AKIA[A-Z0-9]{16}|[0-9a-f]{18}", 0.2, 0.4, "password|passwd|token|secret|api.?key", "commit|sha|md5|checksum"),
)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    summed = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(summed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    plain = F.translate(match, " ", "")
    moved = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    # A is 10, B is 11, ...: a letter shifts by two places
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid(kind: Kind, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind.name == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind.name == "card":
        return n.between(12, 19) & F.when(n <= 19, luhn(_digits(match))).otherwise(False)
    if kind.name == "phone":
        return n.between(9, 15)
    if kind.name == "iban":
        return mod97(match)
    if kind.name == "credential":
        return match.startswith("AKIA")
    return F.lit(kind.name == "email")


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of longs, in blocks."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), zero)
    run = lambda xs: F.aggregate(xs, none, lambda a, v: F.concat(a, F.array(last(a) + v)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    inner = F.transform(blocks, run)
    sums = run(F.transform(inner, last))
    before = F.slice(F.concat(F.array(zero), sums), F.lit(1), F.size(sums))
    return F.flatten(F.zip_with(inner, before, lambda i, o: F.transform(i, lambda v: v + o)))


def _proposals(df: DataFrame, kind: Kind, text: str) -> DataFrame:
    """Add ``__kind``: spans (start, order, end, kind, score) of the kind that its validator and score let pass."""
    has = F.contains(F.col(text), F.lit("@")) if kind.proposed == "@" else F.col(text).rlike(kind.proposed)
    if kind.name == "phone":
        has = F.contains(F.col(text), F.lit("+")) & has
    df = df.withColumn("__m", F.when(has, F.regexp_extract_all(text, F.lit(kind.pattern), 0)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__x", F.when(F.size("__m") > 0, F.split(F.col(text), kind.pattern, -1)).otherwise(F.array().cast("array<string>")))
    gaps = F.zip_with(F.slice("__x", F.lit(1), F.size("__m")), F.col("__m"), lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    df = df.withColumn("__e", F.when(F.size("__m") > 0, prefix_sums(gaps)).otherwise(F.array().cast("array<bigint>")))

    order = [k.name for k in BASE + ADDED].index(kind.name)
    base = kind in BASE

    def span(end: Column, match: Column) -> Column:
        start = end - F.length(match)
        score = F.lit(kind.score) + F.when(_valid(kind, match), F.lit(kind.confirmed)).otherwise(F.lit(0.0))
        if kind.raising or kind.lowering:
            from_ = F.greatest(start - NEAR, F.lit(0).cast("long"))
            around = F.lower(F.concat(F.substring(F.col(text), from_ + 1, start - from_), F.lit(" "), F.substring(F.col(text), end + 1, F.lit(NEAR))))
            if kind.raising:
                score += F.when(around.rlike(kind.raising), F.lit(0.4)).otherwise(F.lit(0.0))
            if kind.lowering:
                score -= F.when(around.rlike(kind.lowering), F.lit(0.3)).otherwise(F.lit(0.0))
        ok = _valid(kind, match) if base else F.lit(True)
        return F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind.name).alias("kind"), F.when(ok, F.round(score, 6)).otherwise(F.lit(0.0)).alias("score"))

    found = F.filter(F.zip_with("__e", "__m", span), lambda s: s["score"] >= THRESHOLD)
    return df.withColumn(f"__{kind.name}", found).drop("__m", "__x", "__e")


_SPANS = "array<struct<start:bigint,order:int,end:bigint,kind:string,score:double>>"


def find(docs: DataFrame, text_col: str = "text", base_as: str = "base_spans", all_as: str = "spans") -> DataFrame:
    """Add the base spans and all spans: arrays of (start, order, end, kind, score), sorted."""
    df = docs.withColumn("__text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    for kind in BASE + ADDED:
        df = _proposals(df, kind, "__text")
    base = F.concat(*[F.col(f"__{k.name}") for k in BASE])
    df = df.withColumn(base_as, F.array_sort(base).cast(_SPANS))
    free = lambda s: ~F.exists(F.col(base_as), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter(F.concat(*[F.col(f"__{k.name}") for k in ADDED]), free)
    df = df.withColumn(all_as, F.array_sort(F.concat(F.col(base_as), added.cast(_SPANS))))
    return df.drop("__text", *[f"__{k.name}" for k in BASE + ADDED])


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans."""
    df = find(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__in")), "__in")
    counts = [F.size(F.expr(f"filter(base_spans, s -> s.kind = '{k.name}')")).cast("long").alias(f"n_{k.name}") for k in BASE]
    return df.select(F.col(f"`{id_col}`"), *counts, F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace each span by its kind in brackets; a null text stays null. All columns are kept."""
    # the input travels in one column, so that no name clashes
    df = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__in")), "__in", "__base", "__all")
    # where spans overlap, the first gives its kind and the rest go with it
    ends = F.transform("__all", lambda s: s["end"])
    df = df.withColumn("__cuts", F.when(F.size("__all") > 0, _running_max(ends)).otherwise(F.array().cast("array<bigint>")))
    text = F.col("__in")

    def piece(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get("__cuts", i - 1), F.lit(0).cast("long"))
        return F.when(s["start"] < before, F.lit("")).otherwise(F.concat(F.substring(text, before + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]")))

    parts = F.transform("__all", piece)
    rest = F.substring(text, F.try_element_at("__cuts", F.lit(-1)) + 1, F.length(text))
    new = F.when(F.size("__all") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
    return df.select(*[new.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def _running_max(values: Column) -> Column:
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), zero)
    run = lambda xs: F.aggregate(xs, none, lambda a, v: F.concat(a, F.array(F.greatest(last(a), v))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    inner = F.transform(blocks, run)
    tops = run(F.transform(inner, last))
    before = F.slice(F.concat(F.array(zero), tops), F.lit(1), F.size(tops))
    return F.flatten(F.zip_with(inner, before, lambda i, o: F.transform(i, lambda v: F.greatest(v, o))))
