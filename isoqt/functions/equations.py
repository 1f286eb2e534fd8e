"""User-supplied correction equations as Column expressions."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoqt.functions.clean import finite
from isoqt.functions.formulas import col

# Variable names accepted in equations and the columns they stand for (fixed values).
VARIABLES = {
    "QT_interval_ms": "qt_ms", "RR_interval_sec": "rr_s", "heart_rate_bpm": "hr_bpm",
    "QT": "qt_ms", "RR": "rr_s", "HR": "hr_bpm",
}
# Functions accepted in equations (fixed values).
FUNCTIONS = {
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "inv": lambda x: F.try_divide(F.lit(1.0), x),
    "square": lambda x: F.pow(x, F.lit(2.0)),
    "cube": lambda x: F.pow(x, F.lit(3.0)),
    "exp": F.exp,
    "log": F.ln,
    "abs": F.abs,
}
OPERATORS = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.Pow: F.pow,
}


def equation_column(equation: str) -> Column | None:
    """An equation as a Column, or None if it holds anything but the accepted words.

    Only numbers, the variables, the functions and + - * / ^ above are turned into expressions;
    nothing is ever evaluated as Python.
    """
    def build(node) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in VARIABLES:
            return F.col(VARIABLES[node.id]).cast("double")
        if (isinstance(node, ast.Call) and isinstance(node.func, ast.Name)
                and node.func.id in FUNCTIONS and len(node.args) == 1 and not node.keywords):
            return FUNCTIONS[node.func.id](build(node.args[0]))
        raise ValueError(equation)

    try:
        return build(ast.parse(equation.strip().replace("^", "**"), mode="eval").body)
    except (ValueError, SyntaxError):
        return None


def formula_column(equation: str, approach: str = "direct") -> Column | None:
    """The whole correction: the equation itself, QT times it (factor) or QT plus it (additive).

    NaN and infinite results become null.
    """
    value = equation_column(equation)
    if value is None:
        return None
    qt = F.col("qt_ms").cast("double")
    return finite({"factor": qt * value, "additive": qt + value}.get(approach, value))


def usable_formulas(spark: SparkSession, formulas: list[tuple[str, str]]) -> list[bool]:
    """Which (equation, approach) pairs parse and are finite at QT 400, RR 1, HR 60: one job."""
    columns = [formula_column(equation, approach) for equation, approach in formulas]
    known = {f"f{i}": c for i, c in enumerate(columns) if c is not None}
    if not known:
        return [False] * len(columns)
    probe = spark.range(1).select(F.lit(400.0).alias("qt_ms"), F.lit(1.0).alias("rr_s"),
                                  F.lit(60.0).alias("hr_bpm"))
    values = probe.select(*[c.alias(n) for n, c in known.items()]).first().asDict()
    return [values.get(f"f{i}") is not None for i in range(len(columns))]


# ---- columns over a table of equations ----------------------------------------------------
def extract_k_c(df: DataFrame, equation: str = "equation") -> DataFrame:
    """Coefficients k (number divided by RR) and c (last signed number at an end)."""
    eq = F.col(equation)
    k = F.regexp_extract(eq, r"([\d.]+)\s*/\s*(?:RR_interval_sec|RR|x1)", 1).try_cast("double")
    tails = F.regexp_extract_all(eq, F.lit(r"([+-]\s*[\d.]+)(?:\s*$|\s*\))"), F.lit(1))
    c = F.replace(F.try_element_at(tails, F.lit(-1)), F.lit(" "), F.lit("")).try_cast("double")
    return df.withColumns({"k": k, "c": c})


def formula_features(df: DataFrame, equation: str = "equation", approach: str = "approach") -> DataFrame:
    """Operator count, functions used and likeness to a standard formula."""
    eq = F.lower(F.col(equation))
    has = {f"has_{w}": F.contains(eq, F.lit(w)) for w in ("sqrt", "cbrt", "log", "exp")}
    novelty = (F.when((F.col(approach) == "factor") & has["has_sqrt"] & ~has["has_cbrt"], "Similar to Bazett")
               .when((F.col(approach) == "factor") & has["has_cbrt"] & ~has["has_sqrt"],
                     "Similar to Fridericia")
               .when(F.col(approach) == "factor", "Novel structure")
               .when(F.col(approach) == "additive", "Similar to Framingham/Hodges")
               .otherwise("Direct approach (novel)"))
    count = F.regexp_count(F.col(equation), F.lit(r"[+\-*/^]")).cast("bigint")
    return df.withColumns({"n_operations": count, **has, "similarity": novelty})


def full_formula(approach="approach", equation="equation") -> Column:
    """Readable text of the whole correction."""
    eq = col(equation)
    return (F.when(col(approach) == "direct", F.concat(F.lit("QTc = "), eq))
            .when(col(approach) == "factor", F.concat(F.lit("QTc = QT × ("), eq, F.lit(")")))
            .otherwise(F.concat(F.lit("QTc = QT + ("), eq, F.lit(")"))))
