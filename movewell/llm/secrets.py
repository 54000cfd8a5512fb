"""Secret scans: three fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a run of key characters that mixes letters and digits. It belongs to the narrowest
character class that holds it (hex, alphanumeric, base64), each with its own least entropy. The
window's counts change by the character that leaves and the one that enters, and the sum over the
counts is corrected by these two alone; it is kept in whole millionths, so no rounding depends on
the order. Candidates on the allow-list are suppressed; spans of the fixed patterns always stay.

Everything is columns of Spark; there is no Python on the data path.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewell.llm.common import let, texts_of

#: The patterns of the base scan, and the least length of what counts.
ASSIGN = (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
          r"[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Runs are maximal, so the least length may stand in the pattern: it finds what is left of all runs.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
UNIT = 1_000_000
#: c * log2(c) of a count c up to the window's length, in millionths.
TERMS = [round(UNIT * c * log2(c)) if c else 0 for c in range(WINDOW + 1)]


@dataclass(frozen=True)
class Settings:
    """Least entropy, in bits a character, of some window of a candidate of each class; allowed: patterns
    of whole candidates that are no secrets (digests of nothing, ids, examples, paths, words)."""

    hex_bits: float = 3.0
    alphanumeric_bits: float = 3.6
    base64_bits: float = 3.9
    allowed: tuple[str, ...] = (
        r"^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709)$",
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"EXAMPLE", r"^[A-Za-z]+([/_-][A-Za-z]+)*[/_-]?[0-9]{1,4}$", r"^[0-9/_=+-]+$")

    def most(self, bits: float) -> int:
        """The largest sum of terms at which a window still has the entropy."""
        return int(WINDOW * (log2(WINDOW) - bits) * UNIT)


def _spans(text: Column, pattern: str) -> Column:
    """(start, end, value) of leftmost non-overlapping matches: the running length of what lies before."""
    def placed(between: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v, i: F.struct(
            F.char_length(F.get(between, i)).alias("gap"), F.char_length(v).alias("size"), v.alias("value")))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("made"))

        def step(acc: Column, x: Column) -> Column:
            start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["size"]
            span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["made"], F.array(span)).alias("made"))

        return F.aggregate(matches, none, step, lambda acc: acc["made"])

    return let(F.split(text, pattern), placed)


def _kept(spans: Column, kind: str) -> Column:
    """Spans of one kind that are long enough, as start, place of the kind, and label."""
    counted = (lambda v: F.regexp_extract(v, ASSIGN, 2)) if kind == "assign" else (lambda v: v)
    kept = F.filter(spans, lambda s: F.char_length(counted(s["value"])) >= LEAST[kind])
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def least_window_sum(value: Column) -> Column:
    """The smallest sum of c * log2(c) over any window of the string, that is its highest entropy.

    ``counts`` holds the count in the window of each character of the alphabet; a step changes the
    count that leaves and the count that enters, and the sum by the four terms of these two.
    """
    terms = F.array(*[F.lit(t).cast("long") for t in TERMS])
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    first = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).cast("long").alias("sum"),
                     F.lit(None).cast("long").alias("least"))

    def moved(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda c, k: F.when(k == at, c + by).otherwise(c))

    def step(acc: Column, x: Column) -> Column:
        leaves, into = x["out"] > 0, x["into"]
        had = F.get(acc["counts"], x["out"])
        has = F.get(acc["counts"], into) - F.when(x["out"] == into, 1).otherwise(0)
        total = (acc["sum"] - F.when(leaves, F.get(terms, had) - F.get(terms, had - 1)).otherwise(F.lit(0))
                 - F.get(terms, has) + F.get(terms, has + 1))
        less = F.when(leaves, moved(acc["counts"], x["out"], -1)).otherwise(acc["counts"])
        return F.struct(moved(less, into, 1).alias("counts"), total.alias("sum"),
                        F.when(x["full"], F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    moves = let(codes, lambda known: F.transform(known, lambda c, i: F.struct(
        F.when(i >= WINDOW, F.get(known, i - WINDOW)).otherwise(F.lit(0)).alias("out"), c.alias("into"),
        (i >= WINDOW - 1).alias("full"))))
    return F.aggregate(moves, first, step, lambda acc: acc["least"])


def _suspicious(value: Column, settings: Settings) -> Column:
    most = (F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(settings.most(settings.hex_bits)))
            .when(value.rlike("^[0-9A-Za-z]+$"), F.lit(settings.most(settings.alphanumeric_bits)))
            .otherwise(F.lit(settings.most(settings.base64_bits))))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    allowed = value.rlike("|".join(f"(?:{pattern})" for pattern in settings.allowed))
    return F.when(mixed & ~allowed, least_window_sum(value) <= most).otherwise(F.lit(False))


def with_spans(rows: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` (columns doc_id, text and any others) with base and found: arrays of (start, kind, end).

    base has the spans of the fixed patterns, found these and the entropy spans that no base span
    holds whole, both in order of start, then kind. Places are code points, ends exclusive.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    placed = rows.select("*", *[_spans(text, pattern).alias(f"_{kind}") for kind, pattern in patterns.items()])
    based = placed.select(*rows.columns, F.array_sort(F.concat(*[_kept(F.col(f"_{k}"), k) for k in LEAST])).alias("base"),
                          F.filter("_entropy", lambda s: _suspicious(s["value"], settings)).alias("_windows"))
    new = F.filter("_windows", lambda w: ~F.exists("base", lambda b: (b["start"] <= w["start"]) & (b["end"] >= w["end"])))
    extra = F.transform(new, lambda w: F.struct(
        w["start"].alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), w["end"].alias("end")))
    return based.select(*rows.columns, "base", F.array_sort(F.concat("base", extra)).alias("found"))


def _labels(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every input row, one row for each.

    Null and empty texts have no spans; a null doc_id stays null. Further columns change nothing.
    """
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return with_spans(texts_of(docs), settings).select(
        "doc_id", *map(count, LEAST), F.sha2(_labels(F.col("base")), 256).alias("base_sha256"), _labels(F.col("found")).alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def step(acc: Column, s: Column) -> Column:
        gap = s["start"] - acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when((gap < 0) | ((gap == 0) & (acc["at"] > 0)), acc["made"]).otherwise(
            F.concat(acc["made"], F.substring(text, acc["at"] + 1, gap), F.lit(mask))).alias("made"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["made"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, settings: Settings = Settings(), mask: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by ``mask`` and n_chars counted anew.

    All rows and columns stay, in their order; a null text stays null.
    """
    carried = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    clean = with_spans(carried, settings).select(
        "_row", F.when(F.size("found") == 0, F.col("text")).otherwise(masked(F.col("text"), F.col("found"), mask)).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_text").isNull(), F.col("_row.n_chars")).otherwise(
        F.char_length("_text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return clean.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
