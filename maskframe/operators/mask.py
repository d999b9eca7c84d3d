"""The masking operator, its change log and its counters.

``mask`` is one projection: it keeps the columns, their order and the
partitioning, and adds no shuffle.  Apply it last; a filter placed after it
tests fakes, and Spark would compute the mask twice to push it down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import patterns as P
from maskframe.functions.detect import case_by_type, is_json_sql
from maskframe.functions.nested import (
    TEXT_TYPES,
    containers,
    holds_text,
    mask_json_sql,
    mask_nested_sql,
    mask_text_sql,
    may_hold_pii,
)
from maskframe.functions.partial import mask_sample_sql, preview_sql
from maskframe.functions.prose import mask_prose_sql
from maskframe.functions.sqltext import bind, case, lit, quote
from maskframe.functions.strategies import (
    CONSTANTS,
    custom_strategy,
    fake_of_type,
    fake_sql,
    mask_value,
    mask_value_sql,
)
from maskframe.policy import MaskPolicy, resolve_rules

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

# The counters; any other strategy counts as "other".
BUCKETS = (
    "email", "phone", "address", "credit_card", "ssn", "ip", "dob",
    "passport", "hash", "json", "other",
)


def _text_sql(v: str, dt: T.DataType) -> str:
    if isinstance(dt, TEXT_TYPES):
        return v
    return f"to_json({v})" if isinstance(dt, _NESTED) else f"CAST({v} AS STRING)"


def _as_text(df: DataFrame, rules: dict[str, str], coerce: bool) -> DataFrame:
    """Cast the columns that are masked in text form.

    The casts are a projection of their own: the expressions above name each
    column many times, and Spark keeps the two apart for that reason.
    """

    def cast(f: T.StructField) -> bool:
        if isinstance(f.dataType, TEXT_TYPES):
            return False
        if f.name in rules:
            kept = (isinstance(f.dataType, _NESTED) and rules[f.name] == "json") or (
                isinstance(f.dataType, T.DateType) and rules[f.name] == "dob"
            )
            return not kept
        return coerce and not isinstance(f.dataType, (*_NESTED, T.BinaryType))

    fields = df.schema.fields
    if not any(cast(f) for f in fields):
        return df
    return df.selectExpr(
        *[
            f"{_text_sql(quote(f.name), f.dataType)} AS {quote(f.name)}"
            if cast(f)
            else quote(f.name)
            for f in fields
        ]
    )


def _by_position(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Give columns names of their own where two have the same one.

    A join result may hold a name twice, and Spark cannot tell them apart.
    """
    names = df.columns
    if len({n.lower() for n in names}) == len(names):
        return df, rules
    fresh = [f"__c{i}" for i in range(len(names))]
    return df.toDF(*fresh), {n: rules[c] for n, c in zip(fresh, names) if c in rules}


def _json_rule_sql(v: str, salt: str) -> str:
    valid = (is_json_sql(v), mask_json_sql(v, salt))
    return case([valid], otherwise=mask_value_sql(v, "json"))


def _by_rule(name: str, dt: T.DataType, strategy: str, salt: str, strict: bool) -> Column:
    v = quote(name)
    if isinstance(dt, T.DateType):
        return F.expr(case([(f"{v} IS NOT NULL", f"DATE {lit(CONSTANTS['dob'])}")]))
    if strategy == "json":
        nested = isinstance(dt, _NESTED)
        return F.expr(mask_nested_sql(v, dt, salt) if nested else _json_rule_sql(v, salt))
    if strategy == "prose":
        return F.expr(mask_prose_sql(v, salt))
    return mask_value(name, strategy, salt, strict)


def _by_heuristic(name: str, dt: T.DataType, salt: str, coerce: bool) -> Column | None:
    if isinstance(dt, TEXT_TYPES):
        return bind(name, lambda v: mask_text_sql(v, salt))
    if isinstance(dt, _NESTED):
        return F.expr(mask_nested_sql(quote(name), dt, salt)) if holds_text(dt) else None
    if coerce and isinstance(dt, T.BinaryType):
        text = bind(_utf8(name), lambda v: f"encode({mask_text_sql(v, salt)}, 'UTF-8')")
        return F.coalesce(text, F.col(quote(name)))
    return None


def _utf8(name: str) -> Column:
    return F.try_validate_utf8(F.col(quote(name)).cast("string"))


def mask(
    df: DataFrame,
    policy: MaskPolicy,
    table: str | None = None,
    coerce: bool = False,
    salt: str = "",
    ignore_table: bool = False,
    strict_reference: bool = False,
) -> DataFrame:
    """Mask a batch or streaming DataFrame.

    A column with a rule is masked wherever it is not null (by ``prose``: wherever
    personal data stands in its text); any other text column is masked where its
    value is detected, alone or inside JSON, array text or a nested type.  A rule
    turns a non-text column into STRING (``dob`` keeps DATE).  ``coerce`` also searches the text form of numbers, dates,
    booleans and binaries; all but binaries become STRING.
    """
    if not policy.masking_enabled:
        return df
    names = df.columns
    rules = resolve_rules(df.schema, policy, table, ignore_table)
    df, rules = _by_position(df, rules)
    df = _as_text(df, rules, coerce)
    cells = [_cell(f, rules, salt, coerce, strict_reference) for f in df.schema.fields]
    return df.select(
        *[
            (F.col(quote(f.name)) if cell is None else cell).alias(name)
            for name, f, cell in zip(names, df.schema.fields, cells)
        ]
    )


def _cell(
    f: T.StructField, rules: dict[str, str], salt: str, coerce: bool, strict: bool
) -> Column | None:
    """The masked form of a column, or None if it never changes."""
    if f.name in rules:
        return _by_rule(f.name, f.dataType, rules[f.name], salt, strict)
    return _by_heuristic(f.name, f.dataType, salt, coerce)


def mask_sql(
    spark: SparkSession,
    query: str,
    policy: MaskPolicy,
    table: str | None = None,
    tables: dict[str, DataFrame] | None = None,
    **kw,
) -> DataFrame:
    """Run a query on raw values and mask its result.

    ``tables`` are the DataFrames that the query names in braces; without them it is
    taken as it is, and reads the session's tables and views.
    """
    result = spark.sql(query, **tables) if tables else spark.sql(query)
    return mask(result, policy, table, **kw)


_HIDDEN = "'(JSON Masked)'"


def _change(
    f: T.StructField, idx: int, label: str, rule: str | None, salt: str, coerce: bool,
    previews: str, strict: bool,
) -> Column | None:
    """A detail struct where the cell changes, null where it does not."""
    dt, name = f.dataType, quote(f.name)

    def detail(v: str, strategy: str, masked: str) -> str:
        shown = {
            "none": "CAST(NULL AS STRING)",
            "sample": mask_sample_sql(v),
            "raw": preview_sql(v),
        }[previews]
        return (
            f"named_struct('column_idx', {idx}, 'column_name', {lit(label)}, "
            f"'strategy', {lit(strategy)}, 'original', {shown}, 'masked', {masked})"
        )

    def differs(v: str, masked: str, strategy: str, shown: str | None = None) -> str:
        # The masked text is computed once and compared in the next step.
        kept = f"filter(array({masked}), _m -> _m <> {v})"
        change = detail(v, strategy, shown or "_m")
        return f"get(transform({kept}, _m -> {change}), 0)"

    if isinstance(dt, T.DateType) and rule is not None:
        v = f"CAST({name} AS STRING)"
        return F.expr(case([(f"{v} IS NOT NULL", detail(v, rule, fake_sql(v, rule)))]))
    if isinstance(dt, _NESTED):
        if not holds_text(dt):
            return None
        kind = "array (heuristic)" if isinstance(dt, T.ArrayType) else "json (heuristic)"
        masked = f"to_json({mask_nested_sql(name, dt, salt)})"
        return F.expr(differs(f"to_json({name})", masked, rule or kind, _HIDDEN))
    if rule == "json":
        hit = differs(name, mask_json_sql(name, salt), "json", _HIDDEN)
        miss = detail(name, "json", fake_sql(name, "json"))
        return F.expr(case([(is_json_sql(name), hit), (f"{name} IS NOT NULL", miss)]))
    if rule == "prose":
        return F.expr(differs(name, mask_prose_sql(name, salt), "prose"))
    if rule is not None and custom_strategy(rule) is not None:
        pieces = F.expr(case([(f"{name} IS NOT NULL", detail(name, rule, name))]))
        return pieces.withField("masked", mask_value(f.name, rule))
    if rule is not None:
        found = detail(name, rule, fake_sql(name, rule, salt, strict))
        return F.expr(case([(f"{name} IS NOT NULL", found)]))

    def heuristic(v: str) -> str:
        single = case_by_type(
            v, lambda t: detail(v, P.TYPE_STRATEGY[t], fake_of_type(v, t, salt))
        )
        container = case(
            [
                (test, differs(v, masked, kind, _HIDDEN if kind.startswith("json") else None))
                for test, masked, kind in containers(v, salt)
            ]
        )
        return f"coalesce({single}, {case([(may_hold_pii(v), container)])})"

    if isinstance(dt, TEXT_TYPES):
        return bind(f.name, heuristic)
    if coerce and isinstance(dt, T.BinaryType):
        return bind(_utf8(f.name), heuristic)
    return None


def change_log(
    df: DataFrame,
    policy: MaskPolicy,
    table: str | None = None,
    keys: tuple[str, ...] = (),
    coerce: bool = False,
    salt: str = "",
    previews: str = "none",
    event_type: str = "DataMasked",
    ignore_table: bool = False,
    strict_reference: bool = False,
) -> DataFrame:
    """One entry per row that ``mask`` changes, with one detail per field.

    ``keys`` are carried from the row.  ``previews`` says what the log shows of
    the original: ``none``, ``sample`` (ends only) or ``raw`` (50 characters of
    personal data).  Projections only; no shuffle.
    """
    if previews not in ("none", "sample", "raw"):
        raise ValueError("previews is 'none', 'sample' or 'raw'")
    names = df.columns
    rules = resolve_rules(df.schema, policy, table, ignore_table)
    df, rules = _by_position(df, rules)
    sources = [df.columns[names.index(k)] for k in keys]
    # The keys go along under names of their own: they may be cast for masking.
    kept = [f"__k{i}" for i in range(len(keys))]
    carried = df.select("*", *[F.col(quote(c)).alias(n) for c, n in zip(sources, kept)])
    text = _as_text(carried, rules, coerce)
    if kept and coerce:
        text = text.withColumns(
            {n: F.col(n).cast(df.schema[c].dataType) for c, n in zip(sources, kept)}
        )
    changes = []
    if policy.masking_enabled:
        for i, f in enumerate(text.schema.fields[: len(df.columns)]):
            one = _change(
                f, i, names[i], rules.get(f.name), salt, coerce, previews, strict_reference
            )
            if one is not None:
                changes.append(one.alias(f"__d{i}"))
    none = (
        "CAST(array() AS array<struct<column_idx:int,column_name:string,strategy:string,"
        "original:string,masked:string>>)"
    )
    # Three steps that Spark keeps apart, because each names the columns of the
    # one before it twice: the cells, their list, and the rows with a list.  A
    # filter would be pushed into the first step and compute every cell twice.
    cells = text.select(*kept, *changes)
    lists = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN array({c}) ELSE {none} END"
        for c in cells.columns[len(kept) :]
    )
    listed = cells.selectExpr(*kept, f"{f'concat({lists})' if lists else none} AS __all")
    where = "MySQL ResultRow" if event_type == "MySqlDataMasked" else "DataRow"
    return listed.selectExpr(
        *kept, "explode(CASE WHEN size(__all) > 0 THEN array(__all) END) AS details"
    ).selectExpr(
        *[f"{n} AS {quote(k)}" for k, n in zip(keys, kept)],
        f"{lit(event_type)} AS event_type",
        f"concat('Masked ', CAST(size(details) AS STRING), {lit(f' fields in {where}')}) "
        "AS content",
        "details",
    )


def bucket_of(strategy: Column) -> Column:
    """Counter that a logged strategy belongs to."""
    bare = F.when(strategy == "json (heuristic)", F.lit("json")).otherwise(strategy)
    return F.when(bare.isin(*BUCKETS), bare).otherwise("other")


def masking_counters(log: DataFrame) -> DataFrame:
    """``(strategy, n)``: masked fields per counter.

    The details are reduced to their strategy before they are exploded, and the
    eleven counters are combined in every map task.
    """
    return (
        log.select(F.explode("details.strategy").alias("s"))
        .select(bucket_of(F.col("s")).alias("strategy"))
        .groupBy("strategy")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def masking_counters_wide(log: DataFrame) -> DataFrame:
    """All counters in one row, zeros included, and their total."""
    counts = masking_counters(log)
    return counts.agg(
        *[
            F.expr(f"coalesce(sum(CASE WHEN strategy = {lit(b)} THEN n END), 0)").alias(b)
            for b in BUCKETS
        ],
        F.expr("coalesce(sum(n), 0)").alias("total"),
    )


def observed(
    df: DataFrame,
    policy: MaskPolicy,
    name: str,
    table: str | None = None,
    coerce: bool = False,
    salt: str = "",
    ignore_table: bool = False,
    strict_reference: bool = False,
) -> DataFrame:
    """``mask`` with in-flight totals: rows, and changed cells of every column that may change.

    A cell counts where its text is no longer what it was, by rule or by heuristic.  The
    totals arrive as the observation ``name`` when the query finishes, at no extra pass.
    """
    names = df.columns
    if not policy.masking_enabled:
        return df.observe(name, F.count(F.lit(1)).alias("rows"))
    rules = resolve_rules(df.schema, policy, table, ignore_table)
    rules = {f"__m{i}": rules[n] for i, n in enumerate(names) if n in rules}
    fresh = df.toDF(*[f"__m{i}" for i in range(len(names))])
    # The originals go along in text form, in columns that are not masked.
    before = [f"{_text_sql(f.name, f.dataType)} AS __o{i}" for i, f in enumerate(fresh.schema.fields)]
    fresh = _as_text(fresh.selectExpr("*", *before), rules, coerce)
    cells = {f.name: _cell(f, rules, salt, coerce, strict_reference) for f in fresh.schema.fields[: len(names)]}
    changing = [i for i in range(len(names)) if cells[f"__m{i}"] is not None]
    out = fresh.select(
        *[(F.col(n) if c is None else c).alias(n) for n, c in cells.items()],
        *[f"__o{i}" for i in changing],
    )

    def changed(i: int) -> Column:
        now = F.expr(_text_sql(f"__m{i}", out.schema[f"__m{i}"].dataType))
        return F.count_if(~now.eqNullSafe(F.col(f"__o{i}"))).alias(f"masked_{names[i]}")

    watched = out.observe(name, F.count(F.lit(1)).alias("rows"), *[changed(i) for i in changing])
    return watched.select(*[F.col(f"__m{i}").alias(n) for i, n in enumerate(names)])
