"""SQL over guarded frames: ``{}`` placeholders, checked sources, and provenance from the analysed plan."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloister import lineage
from cloister.frame import GuardedFrame
from cloister.policy import Stats
from cloister.session import RequestRejected

#: The settings under which queries are analysed: quoted identifiers, and no files as tables.
_SETTINGS = {"spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.runSQLOnFiles": "false"}


def sql(text: str, *frames: GuardedFrame) -> GuardedFrame:
    """A query in which the i-th ``{}`` stands for the i-th frame; the result is lazy.

    Only SELECT queries (WITH included) over the given frames are accepted, with built-in functions that depend on their arguments
    alone: other tables, views and paths, statements that change anything, scripts, calls of Java methods, user-defined
    functions and facts about the session are rejected.  Double quotes are for identifiers.
    """
    if not frames:
        raise ValueError("a query needs at least one frame")
    session = frames[0].session
    if any(f.session is not session for f in frames):
        raise ValueError("all frames must belong to the same session")
    if text.count("{}") != len(frames):
        raise ValueError(f"{text.count('{}')} placeholders for {len(frames)} frames")
    names: dict[int, str] = {}
    used: dict[str, GuardedFrame] = {}
    for f in frames:
        name = names.setdefault(id(f), f"__{len(names)}")
        used[name] = f
    parts = text.split("{}")
    body = "".join(p + (f"{{{names[id(frames[i])]}}}" if i < len(frames) else "") for i, p in enumerate(parts))
    spark = session.spark
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        _check(spark, "".join(p + (names[id(frames[i])] if i < len(frames) else "") for i, p in enumerate(parts)), set(used))
        df = spark.sql(body, **{n: f.df for n, f in used.items()})
        _check_resolved(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    provenance = lineage.once(lambda: _provenance(df, list(used.values()), session.strict), {n for f in used.values() for n in f.provenance.sources})
    sensitive = _shown(df, frozenset(c for f in used.values() for c in f.blacklist))
    return GuardedFrame(session, df, provenance, sensitive, (), None, f"sql({text})")


#: What a parsed query is made of.  Anything else (commands, scripts, table functions, other versions of a table, names made by expressions) is rejected.
NODES = {
    "Aggregate", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator",
    "Pivot", "Project", "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "WithWindowDefinition",
}
#: Groups of Spark's function registry whose functions depend on their arguments alone; and such functions of the group for others, which also
#: holds calls of Java methods, errors that show their text, and facts about the session.
GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs",
    "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs",
}
MORE_FUNCTIONS = {"bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "hll_sketch_estimate", "hll_union", "typeof"}
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}
#: Expressions that name a function, table or value by another expression.
_INDIRECT = {"ExpressionWithUnresolvedIdentifier", "NamedParameter", "PosParameter", "FunctionTableSubqueryArgumentExpression"}
#: Functions that are not Spark's own.
_FOREIGN = {"ScalaUDF", "ScalaUDAF", "ScalaAggregator", "PythonUDF", "PythonUDAF", "PythonUDTF", "UnresolvedPythonUDTF", "HiveSimpleUDF", "HiveGenericUDF", "HiveGenericUDTF", "HiveUDAFFunction", "TypedScalaUDF"}


@functools.cache
def _functions(spark) -> tuple[frozenset[str], frozenset[str]]:
    """(names of the functions that queries may use; classes of all other built-in ones)."""
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    names, others, kinds = set(), set(), set()
    for f in _sequence(registry.listFunction().toSeq()):
        info, name = registry.lookupFunction(f).get(), f.funcName()
        allowed = info.getGroup() in GROUPS or name in MORE_FUNCTIONS
        (names if allowed else others).add(name)
        (kinds if allowed else set()).add(info.getClassName())
    blocked = {c for f in _sequence(registry.listFunction().toSeq()) if f.funcName() in others and (c := registry.lookupFunction(f).get().getClassName()) not in kinds}
    return frozenset(names), frozenset(c.rpartition(".")[2] for c in blocked)


def _check(spark, text: str, allowed: set[str]) -> None:
    """The parsed query, with all that is nested in it, holds nothing but ``NODES``, functions that depend on their arguments alone, and the
    placeholders and its own common table expressions, each where it is in scope."""
    names, _ = _functions(spark)

    def plan(node, known: frozenset[str]) -> None:
        kind = node.nodeName()
        if kind not in NODES:
            raise RequestRejected(f"only SELECT queries over the given frames are accepted, without {kind}")
        if kind == "UnresolvedRelation":
            parts = _sequence(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in known:
                raise RequestRejected(f"{'.'.join(parts)} is not one of the query's frames")
        if kind == "UnresolvedWith":
            for definition in _sequence(node.innerChildren()):
                plan(definition, known)
                known = known | {definition.alias().lower()}
        if kind == "WithWindowDefinition":
            for window in _sequence(node.windowDefinitions().values().toSeq()):
                expression(window, known)
        for child in _nodes(node):
            plan(child, known)
        for e in _sequence(node.expressions()):
            expression(e, known)

    def expression(e, known: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind in _INDIRECT:
            raise RequestRejected("names and values must be written out")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = _sequence(e.nameParts()) if kind == "UnresolvedFunction" else [x for x in (e.name().funcName(),) if x]
            if len(parts) != 1 or parts[0].lower() not in names or (kind == "UnresolvedGenerator" and e.name().database().isDefined()):
                raise RequestRejected(f"the function {'.'.join(parts)} is not accepted")
        if kind in _SUBQUERIES:
            plan(e.plan(), known)
        for child in _sequence(e.children()):
            expression(child, known)

    plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(text), frozenset(n.lower() for n in allowed))


def _check_resolved(df: DataFrame) -> None:
    """The resolved query reads the frames alone, and no function of another kind has taken the name of a built-in one."""
    _, blocked = _functions(df.sparkSession)

    def plan(node) -> None:
        if node.nodeName() == "View":  # a frame
            return
        children = [d.child() for d in _sequence(node.cteDefs())] + [node.plan()] if node.nodeName() == "WithCTE" else _nodes(node)
        if not children and node.nodeName() not in ("OneRowRelation", "LocalRelation", "CTERelationRef"):
            raise RequestRejected(f"{node.nodeName()} is not one of the query's frames")
        for child in children:
            plan(child)
        for e in _sequence(node.expressions()):
            expression(e)

    def expression(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind in blocked or kind in _FOREIGN:
            raise RequestRejected(f"the function {e.prettyName()} is not accepted")
        if kind in _SUBQUERIES:
            plan(e.plan())
        for child in _sequence(e.children()):
            expression(child)

    plan(df._jdf.queryExecution().analyzed())


def _nodes(plan) -> list:
    return _sequence(plan.children())


def _outputs(plan) -> dict[str, str]:
    out = plan.output()
    return {str(out.apply(i).exprId().id()): out.apply(i).name() for i in range(out.size())}


#: Aggregates that show no value of what they aggregate.
SUMMARIES = {"count", "count_if", "approx_count_distinct", "sum", "try_sum", "avg", "try_avg", "mean", "std", "stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop", "skewness", "kurtosis", "corr", "covar_pop", "covar_samp"}


#: Aggregates that hold values of single rows.
RAW = {"first", "first_value", "last", "last_value", "any_value", "nth_value", "collect_list", "collect_set", "array_agg", "max_by", "min_by", "listagg", "string_agg", "histogram_numeric", "approx_top_k", "count_min_sketch"}


def _raw(e) -> bool:
    return (e.getClass().getSimpleName() == "AggregateExpression" and e.aggregateFunction().prettyName() in RAW) or any(map(_raw, _sequence(e.children())))


def _sequence(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _shown(df: DataFrame, secret: frozenset[str]) -> frozenset[str]:
    """Output columns that may show a sensitive column, under any name.

    Attribute ids are followed from the leaves of the analysed plan up.  An expression over a hidden attribute is hidden, inside
    aggregates too, unless it is within one of ``SUMMARIES`` that is not a window's.  Where a node makes
    new attributes in another way than by named expressions, they are hidden if anything below it is.
    """
    if not secret:
        return frozenset()
    hidden: set[str] = set()
    shared: dict[str, list[bool]] = {}  # columns of common table expressions

    def shows(e) -> bool:
        kind = e.getClass().getSimpleName()
        if kind == "AttributeReference":
            return str(e.exprId().id()) in hidden
        if kind == "OuterReference":
            return shows(e.e())
        if kind == "AggregateExpression" and e.aggregateFunction().prettyName() in SUMMARIES:
            return False
        if kind == "WindowExpression":  # a partition may be one row, whose count shows no value
            inner = e.windowFunction()
            counts = inner.getClass().getSimpleName() == "AggregateExpression" and inner.aggregateFunction().prettyName() == "count"
            return any_attribute(e.windowSpec()) if counts else any(map(any_attribute, _sequence(e.children())))
        if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            walk(e.plan())
            return any(i in hidden for i in _outputs(e.plan()))
        return any(map(shows, _sequence(e.children())))

    def any_attribute(e) -> bool:
        return str(e.exprId().id()) in hidden if e.getClass().getSimpleName() == "AttributeReference" else any(map(any_attribute, _sequence(e.children())))

    def walk(plan) -> None:
        name = plan.nodeName()
        if name == "WithCTE":
            for definition in _sequence(plan.cteDefs()):
                walk(definition.child())
                shared[str(definition.id())] = [i in hidden for i in _outputs(definition.child())]
            walk(plan.plan())
        elif name == "CTERelationRef":
            hidden.update(i for i, h in zip(_outputs(plan), shared.get(str(plan.cteId()), []), strict=False) if h)
        below = [] if name == "WithCTE" else _nodes(plan)
        for child in below:
            walk(child)
        outputs = _outputs(plan)
        hidden.update(i for i, n in outputs.items() if n in secret)
        named = {"Project": "projectList", "Aggregate": "aggregateExpressions", "Window": "windowExpressions"}.get(name)
        if named:
            for e in _sequence(getattr(plan, named)()):
                if shows(e):
                    hidden.add(str(e.exprId().id()))
        elif name in ("Union", "Intersect", "Except"):
            for position, i in enumerate(outputs):
                if any(list(_outputs(child))[position] in hidden for child in below):
                    hidden.add(i)
        elif below:
            known = {i for child in below for i in _outputs(child)}
            if known & hidden:
                hidden.update(i for i in outputs if i not in known)

    plan = df._jdf.queryExecution().analyzed()
    walk(plan)
    return frozenset(n for i, n in _outputs(plan).items() if i in hidden)


def _provenance(df: DataFrame, frames: list[GuardedFrame], strict: bool) -> dict[str, Stats]:
    """Statistics bottom-up over the analysed plan: groups at aggregations, matches at joins, merges elsewhere.

    Sub-plans become DataFrames to count groups and join keys.  A join whose equalities can't be
    read off its condition counts as if every row met every other.
    """
    spark, dataset = df.sparkSession, df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset
    base: dict[str, Stats] = {}
    for f in frames:
        for k, s in f.provenance().items():
            base[k] = base[k].merge(s) if k in base else s

    whole = df._jdf.queryExecution().analyzed()
    common: dict[str, dict[str, Stats]] = {}  # of the query's common table expressions

    def frame(plan) -> DataFrame:
        if whole.nodeName() == "WithCTE":
            plan = spark._jvm.org.apache.spark.sql.catalyst.plans.logical.WithCTE(plan, whole.cteDefs())
        return DataFrame(dataset.ofRows(spark._jsparkSession, plan), spark)

    def combined(parts: list[dict[str, Stats]]) -> dict[str, Stats]:
        out: dict[str, Stats] = {}
        for part in parts:
            for k, s in part.items():
                out[k] = out[k].merge(s) if k in out else s
        return out

    def times(stats: dict[str, Stats], size: float = 1, scaling: float = 1) -> dict[str, Stats]:
        def product(a: float, b: float) -> float:
            return 0 if 0 in (a, b) else a * b

        return {k: Stats(product(s.agg_size, size), product(s.join_scaling, scaling)) for k, s in stats.items()}

    def walk(plan) -> dict[str, Stats]:
        name = plan.nodeName()
        if name == "WithCTE":
            for definition in _sequence(plan.cteDefs()):
                common[str(definition.id())] = walk(definition.child())
            return walk(plan.plan())
        if name == "CTERelationRef":
            return common.get(str(plan.cteId()), dict(base))
        children = _nodes(plan)
        if not children:
            return dict(base)
        found = [walk(c) for c in children]
        if name == "Aggregate":
            keys = [plan.groupingExpressions().apply(i).toString() for i in range(plan.groupingExpressions().size())]
            inner = frame(children[0])
            if strict and any(map(_raw, _sequence(plan.aggregateExpressions()))):
                return found[0]
            if not keys:
                return times(found[0], inner.count() if strict else math.inf)
            ids = _outputs(children[0])
            columns = [inner.columns.index(ids[m[1]]) for k in keys if (m := re.fullmatch(r".*#(\d+)L?", k)) and m[1] in ids]
            if len(columns) < len(keys):
                return found[0]  # a computed key: no group size is credited
            inner = inner.toDF(*[f"c{i}" for i in range(len(inner.columns))])
            return times(found[0], lineage.smallest_group(inner, [F.col(f"c{i}") for i in columns]))
        if name == "Join":
            left, right = children
            kind = plan.joinType().toString()
            if kind in ("LeftSemi", "LeftAnti"):
                return combined([found[0], times(found[1], scaling=0)])
            a, b = frame(left), frame(right)
            lefts, rights = list(_outputs(left)), list(_outputs(right))
            condition = plan.condition().get().toString() if plan.condition().isDefined() else ""
            pairs = re.findall(r"\([\w.`\"]+#(\d+)L? = [\w.`\"]+#(\d+)L?\)", condition) if " OR " not in condition else []
            pairs = [(x, y) if x in lefts else (y, x) for x, y in pairs if (x in lefts and y in rights) or (y in lefts and x in rights)]
            if not pairs:
                return combined([times(found[0], scaling=b.count()), times(found[1], scaling=a.count())])
            a, b = (d.toDF(*[f"{side}{i}" for i in range(len(d.columns))]) for d, side in ((a, "l"), (b, "r")))
            more, less = lineage.key_matches(a, b, [F.col(f"l{lefts.index(x)}") for x, _ in pairs], [F.col(f"r{rights.index(y)}") for _, y in pairs])()
            return combined([times(found[0], scaling=more), times(found[1], scaling=less)])
        return combined(found)

    return walk(whole)
