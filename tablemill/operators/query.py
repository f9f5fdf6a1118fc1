"""One guarded, read-only SELECT over named DataFrames, and relational helpers Spark SQL has no syntax for."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablemill.functions.ordering import RANGE_ROWS, running
from tablemill.operators.ranges import clock, equal_ranges
from tablemill.functions.text import js_trim

RESTRICTED = "DATA_QUERY_RESTRICTED"

# The policy, in the order in which it is tested. (pattern, must it match?, reason)
POLICY = [
    (r"^(select|with)\b", True, "Only SELECT or WITH queries are allowed."),
    (r";", False, "Multiple SQL statements are blocked."),
    (r"://|\b(?:https?|ftp|file):", False, "Network/filesystem URLs are blocked."),
    (r"\b(?:install|load|attach|detach|copy|export|import|pragma|call|create|insert|replace|update|delete|drop"
     r"|alter|vacuum|reindex|analyze)\b", False, "Mutating, extension, and attachment statements are blocked."),
    (r"\b(?:read_[a-z0-9_]+|glob|sqlite_scan|parquet_scan|csv_scan|json_scan|readfile|writefile|load_extension)\s*\(",
     False, "External file-reader functions are blocked."),
]
# Spark's own ways out of a SELECT.
SPARK_POLICY = [
    (r"\b(?:reflect|try_reflect|java_method)\s*\(", False, "JVM calls are blocked."),
    (r"\btransform\s*\([^)]*\)\s*(?:row\s+format\b.*?)?using\b", False, "Script transforms are blocked."),
]


def validate_query(query: str) -> str:
    """The trimmed query, or an error naming the first broken rule; empty text stays empty."""
    trimmed = query.strip()
    if not trimmed:
        return ""
    for pattern, must_match, reason in POLICY + SPARK_POLICY:
        if bool(re.search(pattern, trimmed, re.I | re.A | re.S)) != must_match:
            raise ValueError(f"{RESTRICTED}: {reason}")
    return trimmed


def audit_queries(df: DataFrame, sql_col: str, spark_rules: bool = True) -> DataFrame:
    """The same policy over a column of SQL text: adds ``allowed, code, reason`` (first broken rule wins)."""
    text = js_trim(F.col(sql_col))
    reason: Column = F.when(text == "", F.lit(None).cast("string"))
    for pattern, must_match, message in POLICY + (SPARK_POLICY if spark_rules else []):
        hit = text.rlike("(?is)" + pattern)
        reason = reason.when(~hit if must_match else hit, message)
    return (
        df.withColumn("reason", reason)
        .withColumn("allowed", F.col("reason").isNull())
        .withColumn("code", F.when(~F.col("allowed"), RESTRICTED))
    )


# Parsed nodes that only read and combine; every other kind is refused.
READING = set("""
    Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join LateralJoin AsOfJoin Union Except Intersect
    SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedHaving WithWindowDefinition Window Generate Pivot Unpivot
    UnresolvedPivot OneRowRelation UnresolvedInlineTable LocalRelation UnresolvedRelation UnresolvedWith UnresolvedHint Sample
    Expand UnresolvedTableValuedFunction UnresolvedTVFAliases GroupingAnalytics UnresolvedOrdinal RepartitionByExpression
""".split())
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack",
                   "json_tuple", "variant_explode", "variant_explode_outer"}
JVM_CALLS = {"reflect", "try_reflect", "java_method"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_plan(plan, names: set[str]) -> None:
    """Walk a parsed plan; ``names`` are the views and the common table expressions in scope."""
    kind = plan.getClass().getSimpleName()
    if kind not in READING:
        raise ValueError(f"{RESTRICTED}: {kind} is not a plain read.")
    if kind == "UnresolvedWith":
        inner = set(names)
        for entry in _items(plan.cteRelations()):
            own = {entry._1().lower()}
            _check_plan(entry._2(), inner | own if plan.allowRecursion() else inner)
            inner |= own
        _check_plan(plan.child(), inner)
        return
    if kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in names:
            raise ValueError(f"{RESTRICTED}: Unknown relation {'.'.join(parts)}; only the given views can be read.")
    if kind == "UnresolvedTableValuedFunction" and ".".join(_items(plan.name())).lower() not in TABLE_FUNCTIONS:
        raise ValueError(f"{RESTRICTED}: This table function is blocked.")
    for expression in _items(plan.expressions()):
        _check_expression(expression, names)
    for child in _items(plan.children()):
        _check_plan(child, names)


def _check_expression(expression, names: set[str]) -> None:
    kind = expression.getClass().getSimpleName()
    if "UnresolvedIdentifier" in kind:
        raise ValueError(f"{RESTRICTED}: Names that are computed are blocked.")
    if kind == "UnresolvedFunction" and _items(expression.nameParts())[-1].lower() in JVM_CALLS:
        raise ValueError(f"{RESTRICTED}: JVM calls are blocked.")
    if kind in SUBQUERIES:
        _check_plan(expression.plan(), names)
    for child in _items(expression.children()):
        _check_expression(child, names)


def _check_relations(spark: SparkSession, query: str, names: set[str]) -> None:
    """Every table that the parsed (not yet analysed) query names must be a given view or one of its own CTEs."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as error:
        raise ValueError(f"DATA_QUERY_INVALID: {str(error).strip().splitlines()[0]}") from error
    _check_plan(plan, names)


def restricted_sql(views: Mapping[str, DataFrame], query: str = "") -> DataFrame:
    """Validate ``query``, then run it as one Spark SQL statement over ``views``; empty means all of ``data``.

    The views exist only while the statement is analysed; views of the caller with the same names are put back.
    """
    spark = next(iter(views.values())).sparkSession
    text = validate_query(query) or "SELECT * FROM data"
    _check_relations(spark, text, {name.lower() for name in views})
    temporary = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    hidden = {name: spark.table(name) for name in views if name.lower() in temporary}
    before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", before)
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in hidden.items():
            df.createOrReplaceTempView(name)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    rows: int = RANGE_ROWS,
    suffix: str = "_right",
) -> DataFrame:
    """Each left row with the latest right row of the same key at or before it (nulls where there is none).

    Keys of more than ``rows`` rows are cut into ranges of about equal size, wherever their times crowd, so a hot key is spread
    over tasks; the last right row of each range is carried forward. Rows with a null key or time find no partner.
    """
    on = list(on)
    rename = {c: (c + suffix if c in left.columns else c) for c in right.columns if c not in on}
    tagged_left = left.select(
        *on, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    tagged_right = right.select(
        *on, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"),
        F.struct(*[F.col(c).alias(n) for c, n in rename.items()]).alias("__r"))
    for c in [*on, "__ts"]:
        tagged_right = tagged_right.where(F.col(c).isNotNull())
    both = tagged_left.unionByName(tagged_right, allowMissingColumns=True)
    ranged = equal_ranges(both, on, clock(both, "__ts"), "__part", rows)
    found = running(ranged, on, ["__ts", "__side"], {"__m": ("last", F.col("__r"))}, F.col("__part"))
    usable = F.col("__ts").isNotNull()
    for c in on:
        usable = usable & F.col(c).isNotNull()
    return found.where(F.col("__side") == 1).select(
        "__l.*", *[F.when(usable, F.col("__m")[n]).alias(n) for n in rename.values()])


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows per key with their rank; Spark drops rows beyond ``k`` before the shuffle as well."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def sample_by_hash(df: DataFrame, key: str, mod: int, keep: int) -> DataFrame:
    """A repeatable ``keep``-out-of-``mod`` sample by a hash of ``key``; equal keys go in or out together."""
    bits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.where(bits % mod < keep)


def sample_by_weight(df: DataFrame, strata: Sequence[str], k: int, weight: Column, identity: Sequence[str], seed: int = 0) -> DataFrame:
    """``k`` rows of every stratum, drawn without replacement with chances in proportion to ``weight`` (all, if it has fewer).

    Every row draws ``u ** (1 / weight)``, with u from a hash of the seed and ``identity``, and the greatest stay (Efraimidis and
    Spirakis), so a sample is repeatable and does not depend on how the rows are spread. Rows beyond a task's first ``k`` of a
    stratum leave before the shuffle. Rows of a weight that is null or not above 0 are never drawn; nulls are a stratum.
    """
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity])), 1, 12)
    drawn = (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << 48)
    weighted = df.withColumn("__w", weight.cast("double")).where("__w > 0").withColumn("__draw", F.ln(drawn) / F.col("__w"))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(F.desc("__draw"), *identity))
    return weighted.withColumn("__place", place).where(F.col("__place") <= k).select(*df.columns)
