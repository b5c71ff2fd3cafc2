"""SD files: records, tags, mol blocks, schema inference, import and export. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import infer_type, varchar_bucket

_TAG = r"(?m)^>[^\n<]*<([^>\n]+)>[^\n]*\n((?:(?!>|\$\$\$\$)[^\n]*[^\s][^\n]*(?:\n|\z))*)"


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """record_no (ascending in file order, with gaps), record (text without the terminator) of each non-blank record.

    Files are split at line ends followed by ``$$$$``, so a large file is read by many tasks; indented terminators are
    looked for within what that leaves. Line ends become ``\\n``; a line that only begins with ``$$$$`` ends a record, too.
    """
    chunks = spark.read.option("lineSep", "\n$$$$").text(path).select(F.monotonically_increasing_id().alias("chunk"), F.regexp_replace("value", r"\r\n?", "\n").alias("v"))
    rest = F.when(F.col("v").rlike(r"^[ \t]*\n"), F.regexp_replace("v", r"^[ \t]*\n", "")).otherwise(F.col("v"))  # of the terminator's line
    parts = F.split(rest, r"(?m)^[ \t]*\$\$\$\$[ \t]*(?:\n|\z)")
    rows = chunks.select("chunk", F.posexplode(parts).alias("i", "record"))
    return rows.select((F.col("chunk") * 1024 + F.col("i")).alias("record_no"), "record").where(F.trim(F.regexp_replace("record", r"\s", "")) != "")


def append_tag(record: Column, name: str, value: Column) -> Column:
    """The record with one more tag at its end."""
    return F.concat(F.regexp_replace(record, r"\s+$", ""), F.lit(f"\n\n>  <{name}>\n"), value, F.lit("\n"))


def tags(record: Column) -> Column:
    """Map of tag to value: lines after ``> <TAG>`` up to a blank line; the last of equal tags wins."""
    names = F.regexp_extract_all(record, F.lit(_TAG), F.lit(1))
    values = F.transform(F.regexp_extract_all(record, F.lit(_TAG), F.lit(2)), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), x["k"]))
    return F.map_from_entries(last)


def molfile(record: Column) -> Column:
    """The lines before the first tag, with ``M  END`` appended if it is missing."""
    block = F.regexp_replace(F.regexp_extract(record, r"(?s)\A(.*?)(?=^>|\z)".replace("(?s)", "(?sm)"), 1), r"\s+$", "")
    return F.when(block.contains("M  END"), block).otherwise(F.concat(block, F.lit("\nM  END")))


def atom_lines(block: Column) -> Column:
    """The atom block of a V2000 mol block, as many lines as its counts line says."""
    lines = F.split(block, "\n")
    count = F.coalesce(F.trim(F.substring(F.element_at(lines, 4), 1, 3)).try_cast("int"), F.lit(0))
    return F.slice(lines, 5, count)


def coordinates_valid(block: Column) -> Column:
    """At most one atom at the origin (all coordinates below 1e-5)."""
    at_origin = F.filter(atom_lines(block), lambda a: (F.abs(F.substring(a, 1, 10).try_cast("double")) < 1e-5) & (F.abs(F.substring(a, 11, 10).try_cast("double")) < 1e-5) & (F.abs(F.substring(a, 21, 10).try_cast("double")) < 1e-5))
    return F.size(at_origin) <= 1


def infer_tags(records: DataFrame, most: int | None = None) -> DataFrame:
    """tag, n, width, type and declared column of each tag, over all records, or the first ``most`` ones; types widen int < float < string."""
    rows = records if most is None else records.orderBy("record_no").limit(most)
    values = rows.select(F.explode(tags(F.col("record"))).alias("tag", "value"))
    rank = F.create_map(*(F.lit(x) for kv in (("int", 1), ("float", 2), ("string", 3)) for x in kv))
    out = values.groupBy("tag").agg(F.count("*").alias("n"), F.max(F.length("value")).alias("width"), F.max(rank[infer_type(F.col("value"))]).alias("r"))
    kind = F.element_at(F.array(F.lit("int"), F.lit("float"), F.lit("string")), F.coalesce("r", F.lit(1)))
    declared = F.when(kind == "int", "INT").when(kind == "float", "DOUBLE").otherwise(varchar_bucket(F.col("width")))
    return out.select("tag", "n", "width", kind.alias("type"), declared.alias("declared"))


def parse_definition(text: str) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """``key=value`` lines and ``label:column:TYPE`` mappings of a mapping file; # starts a comment; unsafe or repeated columns go."""
    import re

    config, mapping, seen = {}, [], {"mol_id"}
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        parts = line.split(":")
        if len(parts) >= 3:
            label, column, kind = parts[:3]
            if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", column) and column.lower() not in seen:
                seen.add(column.lower())
                mapping.append((label, column, kind))
        elif "=" in line:
            key, _, value = line.partition("=")
            config[key.strip()] = value.strip()
    return config, mapping


def render_record(block: Column, values: Column) -> Column:
    """A record of a mol block and a map of tags."""
    body = F.transform(F.map_entries(values), lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n\n")))
    return F.concat(block, F.lit("\n"), F.array_join(body, ""), F.lit("$$$$\n"))


def export_tags(records: DataFrame, columns: list[str], path: str, separator: str = "\t") -> None:
    """Tags as separated text; lines of a value joined by ;."""
    rows = records.select(tags(F.col("record")).alias("t")).select(*(F.regexp_replace(F.try_element_at("t", F.lit(c)), "\n", ";").alias(c) for c in columns))
    rows.write.option("sep", separator).option("header", True).csv(path)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The data rows of an ARFF file, as string columns named by its attributes (a small file; its header is read first)."""
    import re

    lines = [r.value for r in spark.read.text(path).where(F.lower("value").startswith("@attribute")).collect()]
    names = [re.split(r"\s+", x.strip())[1].strip("'\"") for x in lines]
    rows = spark.read.text(path).where(~F.trim("value").rlike("^[@%]") & (F.trim("value") != "")).select(F.split("value", ",").alias("c"))
    return rows.select(*(F.trim(F.element_at("c", i + 1)).alias(n) for i, n in enumerate(names)))


def parse_printout(df: DataFrame, column: str = "printout") -> DataFrame:
    """Rows of a stored prediction report: what follows its header line, without stars, split at blanks."""
    lines = df.select("pred_id", F.posexplode(F.split(column, "\n")).alias("i", "line"))
    head = lines.where(F.col("line").contains("mol_id")).groupBy("pred_id").agg(F.min("i").alias("head"))
    body = lines.join(head, "pred_id").where("i > head and trim(line) <> ''")
    parts = F.split(F.trim(F.translate("line", "*", "")), r"\s+")
    return body.select("pred_id", F.element_at(parts, 1).cast("long").alias("mol_id"), F.element_at(parts, 2).alias("main_class"), F.array_join(F.slice(parts, 3, F.size(parts) - 2), "\t").alias("distribution"))
