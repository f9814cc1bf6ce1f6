"""Rules as files: tables, and the line form of one rule a line with its reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The line form of a rule, in both spellings of the interval, and of a literal.
RULE_LINE = r"TGFD\{dependency=DataDependency\{x=\[(.*?)\], y=\[(.*?)\]\}, delta=Pair\(min=(\d+), max=(\d+)\), tgfdSupport=([\d.eE+-]+), level=(\d+)\}"
RULE_LINE_YEARS = r"TGFD\{dependency=DataDependency\{x=\[(.*?)\], y=\[(.*?)\]\}, delta=Delta\{min=P(\d+)[YMD], max=P(\d+)[YMD]\}, support=([\d.eE+-]+)\}"
LITERAL = r"ConstantLiteral\{vertexType='(.*?)', attrName='(.*?)', attrValue='(.*?)'\}"
VARIABLE = r"VariableLiteral\(vertexType=(.*?), attrName=(.*?)\)"
FILES = {"constant": "Constant-TGFD", "general": "General-TGFD"}


def _variable(s: Column) -> Column:
    return F.concat(F.lit("VariableLiteral(vertexType="), s["vtype"], F.lit(", attrName="), s["attr"], F.lit(")"))


def _constant(s: Column) -> Column:
    return F.concat(F.lit("ConstantLiteral{vertexType='"), s["vtype"], F.lit("', attrName='"), s["attr"], F.lit("', attrValue='"), s["val"], F.lit("'}"))


def rule_lines(rules: DataFrame) -> DataFrame:
    """rules: x (array of literals), y, dmin, dmax, support, level -> value. Literals without ``val`` are variables."""
    _literal = _constant if "val" in rules.schema["y"].dataType.names else _variable
    x = F.array_join(F.transform("x", _literal), ", ")
    line = F.concat(F.lit("TGFD{dependency=DataDependency{x=["), x, F.lit("], y=["), _literal(F.col("y")), F.lit("]}, delta=Pair(min="), F.col("dmin").cast("string"), F.lit(", max="), F.col("dmax").cast("string"), F.lit("), tgfdSupport="), F.col("support").cast("string"), F.lit(", level="), F.col("level").cast("string"), F.lit("}"))
    return rules.select(line.alias("value"))


def parse_rule_lines(lines: DataFrame, kind: str = "constant") -> DataFrame:
    """value -> x, y, dmin, dmax, support, level; x is sorted. Lines in neither form are left out, and so are those whose literals are
    of the other kind."""
    part = lambda p, k: F.regexp_extract("value", p, k)
    new = F.col("value").rlike(RULE_LINE)
    pick = lambda k: F.when(new, part(RULE_LINE, k)).otherwise(part(RULE_LINE_YEARS, k))
    rows = lines.where(new | F.col("value").rlike(RULE_LINE_YEARS)).select(pick(1).alias("xs"), pick(2).alias("ys"), pick(3).cast("int").alias("dmin"), pick(4).cast("int").alias("dmax"), pick(5).cast("double").alias("support"), F.when(new, part(RULE_LINE, 6).cast("int")).otherwise(F.lit(0)).alias("level"))
    form, names = (LITERAL, ("vtype", "attr", "val")) if kind == "constant" else (VARIABLE, ("vtype", "attr"))
    each = lambda c: F.transform(F.regexp_extract_all(c, F.lit(form), F.lit(0)), lambda s: F.struct(*[F.trim(F.regexp_extract(s, form, k + 1)).alias(n) for k, n in enumerate(names)]))
    return rows.select(F.array_sort(each("xs")).alias("x"), F.try_element_at(each("ys"), F.lit(1)).alias("y"), "dmin", "dmax", "support", "level").where("y is not null")


def write_rules(rules: DataFrame, folder: str, kind: str = "constant", form: str = "text") -> None:
    """form: ``text`` for lines, or a table format such as ``parquet`` or ``json``."""
    to = f"{folder}/{FILES[kind]}"
    if form == "text":
        rule_lines(rules).write.mode("overwrite").text(to)
    else:
        rules.write.mode("overwrite").format(form).save(to)


def read_rules(spark: SparkSession, folder: str, kind: str = "constant") -> DataFrame:
    return parse_rule_lines(spark.read.text(f"{folder}/{FILES[kind]}"), kind)
