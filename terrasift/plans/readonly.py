"""Ad-hoc SQL over the visible tables, read-only. Spark's own parser says what a statement is and what it reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .catalog import joins_for, visible

#: What a parsed plan may consist of. Scripts, table functions, commands and hints of any other kind are refused.
_READS = {
    "Aggregate", "Distinct", "Except", "Filter", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias",
    "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "WithWindowDefinition",
}
#: What a parsed expression may consist of: names, values, operators, casts, conditions, windows and calls by a plain
#: name. Anything else, such as a function whose name is worked out, is refused.
_EXPRESSIONS = set(
    "Add Alias AliasIdentifier And Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Concat Cube CurrentDate CurrentRow CurrentTimestamp Divide EqualNullSafe EqualTo Exists Extract GreaterThan "
    "GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsNotNull IsNull IsNotUnknown IsUnknown LambdaFunction LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Lower MultiAlias Multiply "
    "NamedArgumentExpression NamedParameter Not NotLikeAll NotLikeAny Or PosParameter RLike Remainder Rollup ScalarSubquery SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight "
    "Substring Subtract TryCast UnaryMinus UnaryPositive UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedNamedLambdaVariable "
    "UnresolvedOrdinal UnresolvedRegex UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedStarWithColumns UnresolvedSubqueryColumnAliases UnresolvedWindowExpression UnspecifiedFrame WindowExpression "
    "WindowSpecDefinition".split()
)
#: Functions a statement may call; operators and casts are no functions to the parser.
_FUNCTIONS = set(
    "abs acos add_months any_value approx_count_distinct array array_contains array_distinct array_sort asin atan atan2 avg between bool_and bool_or ceil ceiling char_length coalesce collect_list "
    "collect_set concat concat_ws contains corr cos count count_if cume_dist current_date current_timestamp date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek degrees "
    "dense_rank element_at endswith every exp extract first first_value floor from_json get_json_object greatest hour if ifnull in initcap instr isnotnull isnull json_tuple lag last last_day last_value lcase "
    "lead least left len length ln locate log log10 lower lpad ltrim max max_by md5 mean median min min_by minute mod month months_between named_struct ntile nullif nvl nvl2 percent_rank percentile "
    "percentile_approx percentile_cont percentile_disc pow power quarter radians rank regexp_extract regexp_like regexp_replace repeat replace reverse right rlike round row_number rpad rtrim second sign sin size "
    "some split split_part sqrt startswith stddev stddev_pop stddev_samp struct substr substring substring_index sum tan to_date to_timestamp trim trunc try_cast try_divide try_to_timestamp ucase upper var_pop "
    "var_samp variance weekofyear year".split()
)


class NotAllowed(ValueError):
    """The statement is not one query, or reads something it may not."""


def cleaned(sql: str) -> str:
    """Without a code fence or a last semicolon."""
    text = re.sub(r"^```(?:sql)?\s*|\s*```$", "", sql.strip(), flags=re.I).strip()
    return text.rstrip("; \n\t")


def _refused(expression) -> list[str]:
    """Of an expression the parts that are not of a listed kind, and the functions that are not listed."""
    kind, found = expression.getClass().getSimpleName().rstrip("$"), []
    if kind not in _EXPRESSIONS:
        found.append(kind)
    elif kind == "UnresolvedFunction" and (name := expression.nameParts().mkString(".").lower()) not in _FUNCTIONS:
        found.append(name)
    children = expression.children()
    for i in range(children.size()):
        found += _refused(children.apply(i))
    return found


def _judged(plan) -> None:
    """Raises for any node, in a subquery too, that is no plain read, and for any expression or function that is not listed."""
    if (kind := plan.getClass().getSimpleName()) not in _READS:
        raise NotAllowed(f"only queries are allowed, not {kind}")
    expressions = plan.expressions()
    for i in range(expressions.size()):
        if unknown := _refused(expressions.apply(i)):
            raise NotAllowed(f"not an allowed function or expression: {', '.join(sorted(set(unknown)))}")
    parts = [plan.children(), plan.subqueries()]
    if kind == "UnresolvedWith":
        relations = plan.cteRelations()
        for i in range(relations.size()):
            _judged(relations.apply(i)._2())
    for part in parts:
        for i in range(part.size()):
            _judged(part.apply(i))


def _names(plan, hidden: frozenset[str]) -> set[str]:
    """Relations that a parsed plan reads. The names a WITH defines count only inside it."""
    kind = plan.getClass().getSimpleName()
    found: set[str] = set()
    if kind == "UnresolvedRelation":
        name = plan.multipartIdentifier().mkString(".").lower()
        return set() if name in hidden else {name}
    if kind == "UnresolvedWith":
        inner = hidden
        relations = plan.cteRelations()
        recursive = plan.allowRecursion()
        for i in range(relations.size()):
            pair = relations.apply(i)
            name = pair._1().lower()
            found |= _names(pair._2(), inner | {name} if recursive else inner)
            inner = inner | {name}
        return found | _names(plan.child(), inner)
    for part in (plan.children(), plan.subqueries()):
        for i in range(part.size()):
            found |= _names(part.apply(i), hidden)
    return found


def checked(spark: SparkSession, sql: str, tables: list[str] | None = None) -> tuple[str, set[str]]:
    """The statement and the tables it reads; raises NotAllowed for anything but one query over allowed tables."""
    text = cleaned(sql)
    if not text:
        raise NotAllowed("empty statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise NotAllowed(f"not one readable statement: {str(e)[:200]}") from None
    _judged(plan)
    names = _names(plan, frozenset())
    if unknown := names - set(tables if tables is not None else visible()):
        raise NotAllowed(f"not an allowed table: {', '.join(sorted(unknown))}")
    if not names:
        raise NotAllowed("the statement reads no table")
    return text, names


def run(spark: SparkSession, sql: str, tables: list[str] | None = None, args: dict | list | None = None) -> DataFrame:
    """``args``: values of the statement's ``:name`` or ``?`` parameters; they are never spliced into its text."""
    return spark.sql(checked(spark, sql, tables)[0], args=args)


def why_empty(spark: SparkSession, names: set[str]) -> str:
    """For a query without rows: the tables that are empty, else the documented joins of its tables."""
    empty = sorted(n for n in names if spark.table(n).isEmpty())
    if empty:
        return "Empty tables: " + ", ".join(empty)
    return "\n".join(f"{r.left}.{r.left_key} = {r.right}.{r.right_key} ({r.cardinality})" for r in joins_for(names))
