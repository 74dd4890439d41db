"""Tables as SQL text: one INSERT statement per row, written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wardops.schemas import FOREIGN_KEYS, SCHEMAS


def _literal(field: T.StructField) -> Column:
    """Whole and floating numbers stand bare; all else is quoted text."""
    column = F.col(field.name)
    if isinstance(field.dataType, (T.IntegralType, T.FloatType, T.DoubleType)):
        text = column.cast("string")
    else:
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            value = column.cast("string")
            value = F.when(F.length(value) == 19, value).otherwise(F.rpad(value, 26, "0"))
        else:
            value = column.cast("string")
        doubled = F.replace(value, F.lit("'"), F.lit("''"))
        text = F.concat(F.lit("'"), doubled, F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(name: str, table: DataFrame) -> DataFrame:
    values = F.concat_ws(", ", *[_literal(f) for f in table.schema.fields])
    return table.select(
        F.concat(F.lit(f"INSERT INTO `{name}` VALUES ("), values, F.lit(");")).alias("statement")
    )


def write_insert_statements(name: str, table: DataFrame, folder: str) -> None:
    insert_statements(name, table).write.mode("errorifexists").text(folder)


def read_insert_statements(spark: SparkSession, name: str, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows that ``write_insert_statements`` wrote.

    Files are cut where one statement ends and the next one of the table begins,
    so quoted line ends stay in their values, and large files are split among
    tasks.  A statement whose number of values is not the schema's fails.
    """
    fields = (schema or SCHEMAS[name]).fields
    head, tail = f"INSERT INTO `{name}` VALUES (", ");"
    cut = spark.read.option("lineSep", f"{tail}\n{head}").text(folder)
    body = F.regexp_replace(F.regexp_replace("value", f"^\\Q{head}\\E", ""), r"\);\n?$", "")
    # A quoted text with doubled quotes, or a bare word; possessive, so long texts need no stack.
    values = F.regexp_extract_all(body, F.lit(r"('[^']*+(?:''[^']*+)*+'|[^,'\s]++)"), F.lit(1))
    rows = cut.filter(F.length("value") > 0).select(values.alias("values"))
    wrong = F.raise_error(F.concat(F.lit(f"{name}: {len(fields)} values expected in "), F.to_json("values")))
    checked = rows.select(F.when(F.size("values") == len(fields), F.col("values")).otherwise(wrong).alias("values"))

    def value(at: int, field: T.StructField) -> Column:
        raw = F.col("values")[at]
        text = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))
        plain = F.when(raw == "NULL", None).when(F.startswith(raw, F.lit("'")), text).otherwise(raw)
        return plain.cast(field.dataType).alias(field.name)

    return checked.select(*[value(i, f) for i, f in enumerate(fields)])


def load_order(names: list[str]) -> list[str]:
    """Tables so that each comes after those it refers to."""
    left, out = sorted(names), []
    while left:
        waits = {child for child, _, parent in FOREIGN_KEYS if parent in left and parent != child}
        ready = [name for name in left if name not in waits]
        out += ready
        left = [name for name in left if name in waits]
    return out
