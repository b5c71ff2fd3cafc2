"""Scalar functions of the catalogue and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_odds(p: Column, offset: float = 0.001) -> Column:
    return F.ln((p + offset) / (1 + offset - p))


def likelihood_bar(value: Column) -> tuple[Column, Column]:
    """Pixels and colour of a likelihood bar."""
    pixels = F.lit(30) + value * 60 / 14
    return pixels, F.when(pixels >= 30, "green").otherwise("red")


def certainty_bucket(value: Column) -> Column:
    return F.when(value >= 0.7, "High").when(value >= 0.4, "Medium").otherwise("Low")


def decimal_text(value: Column) -> Column:
    """At most eight decimals (half to even), no trailing zeros, a zero before the point."""
    return F.regexp_replace(F.bround(value.cast("double"), 8).cast("decimal(38,8)").cast("string"), r"\.?0+$", "")


def number_text(value: Column, places: int = 3) -> Column:
    """Rounded, with commas between thousands."""
    return F.format_number(value, places)


def percent_text(value: Column) -> Column:
    """One decimal of a hundredfold, half up."""
    return F.format_string("%.1f", value * 100)


def descriptor_name(name: Column) -> Column:
    """A column name of a descriptor: ``-`` and ``.`` become ``_``, and a name TPSA becomes TopoPSA."""
    plain = F.translate(name, "-.", "__")
    return F.when(plain.startswith("TPSA"), F.concat(F.lit("TopoPSA"), F.substring(plain, 5, 1 << 30))).otherwise(plain)


def with_breaks(text: Column) -> Column:
    """A line break tag before each line's end."""
    return F.regexp_replace(text, r"(\r\n|\n\r|\n|\r)", "<br />$1")


def job_stamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd_HH-mm-ss")


def report_line(mol_id: Column, name: Column, main: Column, rest: Column) -> Column:
    """A line of a prediction report: padded key, padded class with a star, distribution."""
    return F.concat(pad_right(mol_id.cast("string"), 15), pad_right(name, 27), main, F.lit("\t"), rest)


#: The forms of names, addresses and labels that a job request may have.
INPUT_FORMS = {"username": r"^[A-Za-z0-9_.@-]+$", "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "class_tag": r"^[A-Za-z0-9_]+$", "data_type": r"^[A-Za-z0-9]+$", "class_scheme": r"^[A-Za-z0-9]+$"}


def valid_input(kind: str, value: Column) -> Column:
    return F.coalesce(value.rlike(INPUT_FORMS[kind]), F.lit(False))


def pad_right(text: Column, width: int) -> Column:
    """Padded to width; longer text stays whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def distribution(text: Column) -> Column:
    """Tab-separated numbers, with or without a tab at the end, to doubles."""
    return F.transform(F.filter(F.split(text, "\t"), lambda x: x != ""), lambda x: x.cast("double"))


def render_distribution(values: Column) -> Column:
    return F.concat(F.array_join(F.transform(values, decimal_text), "\t"), F.lit("\t"))


def infer_type(text: Column) -> Column:
    """int, float or string; null for empty text."""
    return F.when(F.trim(text) == "", None).when(text.rlike(r"^[+-]?[0-9]+$"), "int").when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float").otherwise("string")


def varchar_bucket(width: Column) -> Column:
    """A declared type by the widest value."""
    steps = [(5, "VARCHAR(10)"), (10, "VARCHAR(20)"), (25, "VARCHAR(50)"), (50, "VARCHAR(100)"), (100, "VARCHAR(200)"), (200, "VARCHAR(255)")]
    out = F.when(width < steps[0][0], steps[0][1])
    for limit, name in steps[1:]:
        out = out.when(width < limit, name)
    return out.otherwise("TEXT")


def first_named(*candidates: Column) -> Column:
    """The first candidate that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in candidates))


def zero_filled(key: Column, width: int = 8) -> Column:
    return F.lpad(key.cast("string"), width, "0")


def sanitise(text: Column, words: tuple[str, ...] = ("select", "insert", "update", "delete", "drop", "union"), width: int = 40) -> Column:
    """Quotes to backticks, comment marks to tildes, listed words out, cut to width."""
    out = F.regexp_replace(F.translate(text, "'\"", "``"), "--|;", "~~")
    return F.substring(F.regexp_replace(out, "(?i)" + "|".join(words), ""), 1, width)


def wrap(text: Column, width: int = 60) -> Column:
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def bounds_from(pairs: str, exact: set[str] = frozenset()) -> Column:
    """``n_c:6;n_o:2`` to n_c >= 6 and n_o >= 2; names in exact are compared by equality."""
    parts = [p.split(":") for p in pairs.strip(";").split(";") if p]
    return reduce(lambda a, b: a & b, [(F.col(n) == int(v)) if n in exact else (F.col(n) >= int(v)) for n, v in parts], F.lit(True))


def matches(who: str, you: str) -> Column:
    """The ownership predicate of list queries."""
    c = F.col("username")
    return c != you if who == "other" else c == (you if who == "you" else who)


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))
