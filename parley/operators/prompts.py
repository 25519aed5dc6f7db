"""Prompt tables: render templates from columns, check the fields a template
needs, choose the prompt kind from state changes, keep only the variables
the code uses, and bounded text previews of values and whole rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import quote, render_template, template_fields
from parley.plans.ordered import ordered_scan

# Names an interactive shell defines, never sent as variables
SHELL_NAMES = ["In", "Out", "_dh", "_ih", "_ii", "_iii", "_oh"]
SHELL_NAME_PATTERN = r"(?U)^_{1,2}i?\d*$"
# Fixed value: default preview size in characters
PREVIEW_MAX_LEN = 400
# Field-check messages (unexpected fields are reported first)
UNEXPECTED_MSG = "Received unexpected kwarg(s): "
MISSING_MSG = "Missing required kwarg(s): "
# O10: code rows of a slice of a frequent token; frequent tokens told by the
# sketch, and items it tracks.
HOT_ROWS, HOT_NAMES, HOT_TRACKED = 1_000_000, 1_000, 100_000
CONTEXTFUL, CONTEXTLESS = "contextful", "contextless"


# ---------------------------------------------------------------- O7 -----
def prompt_render(df: DataFrame, templates: Mapping[str, str] | Sequence[tuple[str, str]],
                  *, name: str | None = None, choose: str | None = None,
                  out: str = "prompt") -> DataFrame:
    """Render a ``{field}`` template from the columns of each row.

    ``templates`` is ordered; the first one is the default. ``name`` picks
    one template for all rows; ``choose`` names a column holding the template
    name per row (unknown names fall back to the default). The template is
    compiled once on the driver into ``concat`` of literals and columns."""
    items = list(templates.items()) if isinstance(templates, Mapping) else list(templates)
    cols = {c: F.col(c) for c in df.columns}
    rendered = {k: render_template(v, cols) for k, v in items}
    default_key = items[0][0]
    if choose is None:
        return df.withColumn(out, rendered[name or default_key])
    expr = None
    for k, r in rendered.items():
        expr = F.when(F.col(choose) == k, r) if expr is None else expr.when(F.col(choose) == k, r)
    return df.withColumn(out, expr.otherwise(rendered[default_key]))


# ---------------------------------------------------------------- O8 -----
def prompt_field_check(df: DataFrame, template: str, *, fields: str = "fields") -> DataFrame:
    """Per row: ``unexpected`` (given but not used by the template) and
    ``missing`` (used but not given) field names, sorted, and the first error
    in the reference's order (unexpected before missing). A field is given if
    its key is in the map, whatever its value; a NULL map gives none."""
    expected = F.array(*[F.lit(f) for f in sorted(template_fields(template))])
    given = F.coalesce(F.map_keys(F.col(fields)), F.array().cast("array<string>"))
    unexpected = F.array_sort(F.array_except(given, expected))
    missing = F.array_sort(F.array_except(expected, given))
    fmt = lambda a: F.concat(F.lit("{"), F.array_join(
        F.transform(a, lambda x: quote(x)), ", "), F.lit("}"))
    error = (F.when(F.size(unexpected) > 0,
                    F.concat(F.lit(UNEXPECTED_MSG), fmt(unexpected)))
             .when(F.size(missing) > 0,
                   F.concat(F.lit(MISSING_MSG), fmt(missing))))
    return (df.withColumn("unexpected", unexpected).withColumn("missing", missing)
            .withColumn("error", error))


def prompt_field_report(checked: DataFrame, by: str | None = None) -> DataFrame:
    """Data-quality summary of ``prompt_field_check`` (no row is dropped)."""
    g = checked.groupBy(by) if by else checked.groupBy()
    return g.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.size("missing") > 0).alias("rows_missing"),
                 F.count_if(F.size("unexpected") > 0).alias("rows_unexpected"),
                 F.count_if(F.col("error").isNull()).alias("rows_ok"))


# ---------------------------------------------------------------- O9 -----
def prompt_kind(questions: DataFrame, *, session: str = "session_id",
                order: Sequence[str] = ("seq",), state: Sequence[str] = ("state",),
                answered: str | Column = "answered", single_template: bool = False,
                parts: int | None = None) -> DataFrame:
    """``contextless`` iff the state equals the state at the previous
    *answered* question of the session (failed calls do not move the
    reference point); otherwise ``contextful``. A one-template prompt is
    always ``contextful``.

    The previous answered state is a carry-forward of ``struct(state)`` (so a
    NULL state differs from no state) over the skew-safe ordered scan."""
    ans = F.col(answered) if isinstance(answered, str) else answered
    st = F.struct(*[F.col(c) for c in state])
    q = questions.withColumn("_st", F.when(ans, st))
    s = ordered_scan(q, session, list(order), carries=["_st"], parts=parts)
    same = F.col("_st_prev").isNotNull() & F.col("_st_prev").eqNullSafe(st)
    kind = F.lit(CONTEXTFUL) if single_template else \
        F.when(same, F.lit(CONTEXTLESS)).otherwise(F.lit(CONTEXTFUL))
    return s.withColumn("prompt_kind", kind).drop("_st", "_st_prev")


# ---------------------------------------------------------------- O10 ----
def is_shell_name(name: Column) -> Column:
    return (name.rlike(SHELL_NAME_PATTERN) | (F.regexp_replace(name, "_", "") == "")
            | name.isin(SHELL_NAMES))


IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def code_tokens(df: DataFrame, code: str, keys: Sequence[str],
                tokens: str = "whitespace") -> DataFrame:
    """Distinct tokens of each code text: ``keys..., token``. ``whitespace``
    (the reference's rule: ``nums[j]`` is one token) or ``identifier``
    (``nums`` and ``j``)."""
    text = F.coalesce(F.col(code), F.lit(""))
    if tokens == "identifier":
        arr = F.regexp_extract_all(text, F.lit(IDENTIFIER), 0)
    elif tokens == "whitespace":
        arr = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    else:
        raise ValueError("tokens must be 'whitespace' or 'identifier'")
    return df.select(*keys, F.explode(F.array_distinct(arr)).alias("token"))


def hot_tokens(toks: DataFrame, hot_rows: int) -> DataFrame:
    """``_hot, _slices``: the tokens of more than ``hot_rows`` rows and how many
    slices of that size they make, by a frequent-items sketch: one pass with
    partial aggregation, ``HOT_NAMES`` rows at most. The sketch only decides
    how tokens are dealt; what it misses is joined all the same, in one slice."""
    top = toks.agg(F.call_function("approx_top_k", F.col("token"), F.lit(HOT_NAMES), F.lit(HOT_TRACKED)).alias("top"))
    return top.select(F.inline("top").alias("_hot", "_count")).where(F.col("_count") > hot_rows) \
        .select("_hot", F.ceil(F.col("_count") / hot_rows).cast("long").alias("_slices"))


def used_variables(variables: DataFrame, code: DataFrame, *,
                   keys: Sequence[str] = (), code_col: str = "code",
                   code_keys: Sequence[str] = (), name: str = "name",
                   tokens: str = "whitespace", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Variables whose name is a whitespace token of the code (``nums[j]``
    does not use ``nums``), minus shell names.

    ``keys`` join variables to their code (session, seq); with no keys the
    variables are one global namespace shared by every code row. An equi-join
    on ``(keys, name, slice)``: Catalyst chooses broadcast or shuffle from
    sizes. Tokens of more than ``hot_rows`` code rows are dealt to slices of
    about that many by a hash of the row, and the variables of such a name are
    there once a slice (see ``hot_tokens``); others have one slice."""
    keys = list(keys)
    own = list(code_keys) or keys
    code = code.withColumn("_row", F.xxhash64(*own, code_col))
    toks = code_tokens(code, code_col, [*own, "_row"], tokens).withColumnsRenamed({c: f"_code_{c}" for c in own})
    hot = F.broadcast(hot_tokens(toks, hot_rows))  # HOT_NAMES rows at most
    toks = toks.join(hot, F.col("token") == F.col("_hot"), "left") \
        .withColumn("_slice", F.coalesce(F.pmod("_row", "_slices"), F.lit(0))).drop("_hot", "_slices", "_row")
    v = variables.where(~is_shell_name(F.col(name)))
    sliced = v.join(hot, F.col(name) == F.col("_hot"), "left").withColumn(
        "_of", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_slices"), F.lit(1)) - 1)))
    cond = [F.col(f"_code_{k}") == F.col(k) for k in keys] + [F.col("token") == F.col(name), F.col("_slice") == F.col("_of")]
    extra = [c for c in own if c not in keys]
    return toks.join(sliced, cond, "inner").select(*[F.col(f"_code_{c}").alias(c) for c in extra],
                                              *[F.col(c) for c in v.columns])


def used_variables_in_row(df: DataFrame, variables: str, code: str, *,
                          out: str | None = None, tokens: str = "whitespace") -> DataFrame:
    """Row-local form of O10: ``variables`` is a ``MAP<name, value>`` in the
    same row as the code; keep entries whose name is a token of the code and
    not a shell name. No join, no shuffle (works on streams as is)."""
    text = F.coalesce(F.col(code), F.lit(""))
    toks = F.regexp_extract_all(text, F.lit(IDENTIFIER), 0) if tokens == "identifier" else \
        F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    kept = F.map_filter(F.col(variables),
                        lambda k, v: F.array_contains(toks, k) & ~is_shell_name(k))
    return df.withColumn(out or variables, kept)


# ---------------------------------------------------------------- O12 ----
def _float_repr(c: Column) -> Column:
    """Shortest text of a double with Python's layout: positional from 1e-4 up
    to 1e16, else with an exponent of at least two digits."""
    d = c.cast("double")
    s = d.cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(s, r"^-?([0-9.]+)E", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    e = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int")
    whole = F.rpad(digits, F.greatest(F.length(digits), e + 1), "0")
    above = F.concat(F.substring(whole, F.lit(1), e + 1), F.lit("."),
                     F.when(F.length(whole) > e + 1, F.substring(whole, e + 2, F.length(whole))).otherwise(F.lit("0")))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    scientific = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")),
                          F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))),
                                 F.lit("0")))
    return (F.when(F.isnan(d), F.lit("nan")).when(d == float("inf"), F.lit("inf"))
            .when(d == float("-inf"), F.lit("-inf"))
            .when(F.abs(d) == 5e-324, F.concat(sign, F.lit("5e-324")))  # the JVM tells two digits at least
            .when(~F.contains(s, F.lit("E")), s)
            .otherwise(F.concat(sign, F.when((e >= 0) & (e < 16), above).when((e < 0) & (e >= -4), below)
                                .otherwise(scientific))))


NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _value_preview(c: Column, dt: T.DataType, max_len: int) -> Column:
    """A single value; one too long to tell is told by ``.3e`` if it is a
    number, else by its type's name."""
    r = _scalar_repr(c, dt)
    short = F.format_string("%.3e", c.cast("double")) if isinstance(dt, NUMBERS) else F.lit(f"<{dt.simpleString()}>")
    return F.when(F.length(r) < max_len, r).otherwise(short)


def _scalar_repr(c: Column, dt: T.DataType) -> Column:
    """Text of a value inside a preview; a type without a rule of its own is
    told by its type name alone."""
    if isinstance(dt, T.StringType):
        r = quote(c)
    elif isinstance(dt, T.BooleanType):
        r = F.when(c, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(dt, T.FloatType):
        r = _float_repr(c.cast("string").cast("double"))  # the float's own shortest text
    elif isinstance(dt, T.DoubleType):
        r = _float_repr(c)
    elif isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType,
                         T.TimestampType, T.TimestampNTZType)):
        r = c.cast("string")
    elif isinstance(dt, T.ArrayType):
        r = F.concat(F.lit("["), F.array_join(F.transform(
            c, lambda x: _scalar_repr(x, dt.elementType)), ", "), F.lit("]"))
    elif isinstance(dt, T.MapType):
        r = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(
            _scalar_repr(e["key"], dt.keyType), F.lit(": "), _scalar_repr(e["value"], dt.valueType))), ", "),
            F.lit("}"))
    elif isinstance(dt, T.StructType):
        r = F.concat(F.lit("{"), F.concat_ws(", ", *[e["whole"] for e in _field_items(c, dt)]), F.lit("}"))
    else:
        r = F.lit(f"<{dt.simpleString()}>")
    return F.when(c.isNull(), F.lit("None")).otherwise(r)


def _field_items(c: Column, dt: T.StructType) -> list[dict[str, Column]]:
    """A struct's fields as the items of a map from names: ``name: value`` and
    the pair that a cut map shows."""
    told = [(quote(F.lit(f.name)), _scalar_repr(c.getField(f.name), f.dataType)) for f in dt.fields]
    return [{"whole": F.concat(n, F.lit(": "), v), "pair": F.concat(F.lit("("), n, F.lit(", "), v, F.lit(")"))} for n, v in told]


def _scalar_len(c: Column, dt: T.DataType) -> Column:
    """Length of ``_scalar_repr``; for texts without building the quoted text."""
    if isinstance(dt, T.StringType):
        n = F.length(c) + 2
    elif isinstance(dt, T.BooleanType):
        n = F.when(c, F.lit(4)).otherwise(F.lit(5))
    else:
        n = F.length(_scalar_repr(c, dt))
    return F.when(c.isNull(), F.lit(4)).otherwise(n).cast("bigint")


def _cut(s: Column, k: int) -> Column:
    """Python ``s[:k]`` for a driver-side int ``k`` (negative counts from the end)."""
    if k >= 0:
        return F.substring(s, 1, k)
    return F.substring(s, F.lit(1), F.greatest(F.lit(0), F.length(s) + F.lit(k)))


def _until_last_comma(s: Column) -> Column:
    """Python ``s[:s.rfind(',')]`` (``rfind`` = -1 drops the last char)."""
    p = F.instr(F.reverse(s), ",")
    n = F.when(p == 0, F.length(s) - 1).otherwise(F.length(s) - p)
    return F.substring(s, F.lit(1), F.greatest(n, F.lit(0)))


def preview_string(c: Column, max_len: int = PREVIEW_MAX_LEN) -> Column:
    """Quoted text when shorter than ``max_len``, else its first
    ``max_len - 16`` characters and a marker. Long texts are cut, never
    copied whole."""
    k = max_len - 16
    head = F.concat(F.lit("'"), F.substring(c, 1, k - 1)) if k >= 1 else _cut(quote(c), k)
    return (F.when(c.isNull(), F.lit("None"))
            .when(F.length(c) + 2 < max_len, quote(c))
            .otherwise(F.concat(head, F.lit("...' (truncated)"))))


def _seq_preview(arr: Column, render, length, label: str, opener: str, closer: str,
                 max_len: int) -> Column:
    """Shared cut rule for arrays and maps (as pair lists). ``render(x)`` is
    the element text in the whole form and ``length(x)`` its length; the
    slice is rendered as pairs for maps. The length of the whole text is
    summed from element lengths, so only short texts and the kept head are
    built."""
    size = F.size(arr)
    full_len = F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, x: acc + length(x)) \
        + F.greatest(size - 1, F.lit(0)) * 2 + 2
    n = F.greatest(F.lit(1), (F.lit(float(max_len)) / full_len * size).cast("int"))
    whole = F.concat(F.lit(opener), F.array_join(F.transform(arr, render[0]), ", "),
                     F.lit(closer))
    head = F.transform(F.slice(arr, 1, n), render[1])
    sliced = F.concat(F.lit("["), F.array_join(head, ", "), F.lit(", ...]"))
    as_list = F.concat(F.lit("["), F.array_join(F.transform(arr, render[1]), ", "), F.lit("]"))
    same_len = _until_last_comma(_cut(as_list, max_len - 10))
    tail = F.concat(F.lit(", len="), size.cast("string"), F.lit(">"))
    return (F.when(full_len < max_len, whole)
            .when(n == size, F.concat(F.lit(f"<{label}, truncated_data="), same_len, tail))
            .otherwise(F.concat(F.lit(f"<{label}, truncated_data="), sliced, tail)))


def preview_array(c: Column, elem: T.DataType, max_len: int = PREVIEW_MAX_LEN) -> Column:
    """Bounded text of an array of scalars (a ``list`` in the reference)."""
    r = lambda x: _scalar_repr(x, elem)
    return F.when(c.isNull(), F.lit("None")).otherwise(
        _seq_preview(c, (r, r), lambda x: _scalar_len(x, elem), "list", "[", "]", max_len))


def preview_map(c: Column, key: T.DataType, value: T.DataType,
                max_len: int = PREVIEW_MAX_LEN) -> Column:
    """Bounded text of a map (a ``dict``): whole as ``{k: v, ...}``, cut as a
    list of ``(k, v)`` pairs."""
    kv = lambda e: F.concat(_scalar_repr(e["key"], key), F.lit(": "),
                            _scalar_repr(e["value"], value))
    pair = lambda e: F.concat(F.lit("("), _scalar_repr(e["key"], key), F.lit(", "),
                              _scalar_repr(e["value"], value), F.lit(")"))
    ln = lambda e: _scalar_len(e["key"], key) + _scalar_len(e["value"], value) + 2
    return F.when(c.isNull(), F.lit("None")).otherwise(
        _seq_preview(F.map_entries(c), (kv, pair), ln, "dict", "{", "}", max_len))


def preview_struct(c: Column, dt: T.StructType, max_len: int = PREVIEW_MAX_LEN) -> Column:
    """Bounded text of a struct, as of a map from its fields' names."""
    if not dt.fields:
        return F.when(c.isNull(), F.lit("None")).otherwise(F.lit("{}"))
    items = F.array(*[F.struct(e["whole"].alias("whole"), e["pair"].alias("pair")) for e in _field_items(c, dt)])
    return F.when(c.isNull(), F.lit("None")).otherwise(_seq_preview(
        items, (lambda e: e["whole"], lambda e: e["pair"]), lambda e: F.length(e["whole"]).cast("bigint"),
        "dict", "{", "}", max_len))


def preview(c: Column, dt: T.DataType, max_len: int = PREVIEW_MAX_LEN) -> Column:
    if isinstance(dt, T.StringType):
        return preview_string(c, max_len)
    if isinstance(dt, T.ArrayType):
        return preview_array(c, dt.elementType, max_len)
    if isinstance(dt, T.MapType):
        return preview_map(c, dt.keyType, dt.valueType, max_len)
    if isinstance(dt, T.StructType):
        return preview_struct(c, dt, max_len)
    return _value_preview(c, dt, max_len)


def bounded_preview(df: DataFrame, cols: Sequence[str], *, max_len: int = PREVIEW_MAX_LEN,
                    suffix: str = "_preview") -> DataFrame:
    """Add ``{c}_preview`` for each column: strings, numbers, booleans,
    dates and times, arrays, maps and structs of them, nested too (a struct is
    told as a map from its fields' names); any other type is told by its name."""
    sch = {f.name: f.dataType for f in df.schema.fields}
    return df.select("*", *[preview(F.col(c), sch[c], max_len).alias(c + suffix)
                            for c in cols])


# ---------------------------------------------------------------- O11 ----
def state_snapshot(df: DataFrame, cols: Sequence[str], *, out: str = "snapshot",
                   max_len: int = PREVIEW_MAX_LEN) -> DataFrame:
    """Per row, a ``{`` ... ``}`` text with one
    ``\\n    'name': value,   # type: T`` line per column (T is Spark's type
    name); values use the bounded preview. A projection: no shuffle."""
    sch = {f.name: f.dataType for f in df.schema.fields}
    lines = [F.concat(F.lit("\n    " + "'" + c + "': "), preview(F.col(c), sch[c], max_len),
                      F.lit(",   # type: " + sch[c].simpleString())) for c in cols]
    return df.withColumn(out, F.concat(F.lit("{"), *lines, F.lit("\n}")))


def map_snapshot(m: Column, value_type: str = "string",
                 max_len: int = PREVIEW_MAX_LEN) -> Column:
    """Same text for a ``MAP<STRING, STRING>`` column (entries in map order)."""
    line = lambda e: F.concat(F.lit("\n    "), quote(e["key"]), F.lit(": "),
                              preview_string(e["value"], max_len),
                              F.lit(",   # type: " + value_type))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), line), ""),
                    F.lit("\n}"))


def table_preview(df: DataFrame, cols: Sequence[str], order: Sequence[str], *, k: int = 3,
                  max_len: int = PREVIEW_MAX_LEN) -> DataFrame:
    """Per column of a table: ``column, type, non_null, first_values`` where
    ``first_values`` previews the column's values in the first ``k`` rows by
    ``order``, as a list.

    The first rows are a top-k (each partition keeps ``k`` rows, then one
    merge): the limit is the feature here. Counts are one global aggregate.
    Both results are a few rows, combined per column without a join."""
    sch = {f.name: f.dataType for f in df.schema.fields}
    first = df.orderBy(*order).limit(k).select(
        F.lit(1).alias("_one"), F.struct(*[F.col(o) for o in order]).alias("_o"),
        *[F.col(c) for c in cols])
    heads = first.groupBy("_one").agg(*[
        F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(c).alias("v")))),
                    lambda x: x["v"]).alias(c) for c in cols])
    counts = df.agg(*[F.count(F.col(c)).alias(f"_n_{c}") for c in cols]) \
        .withColumn("_one", F.lit(1))
    both = counts.join(heads, "_one", "left")  # one row with one row
    rows = [F.struct(F.lit(c).alias("column"), F.lit(sch[c].simpleString()).alias("type"),
                     F.col(f"_n_{c}").alias("non_null"),
                     preview_array(F.coalesce(F.col(c), F.array().cast(T.ArrayType(sch[c]))),
                                   sch[c], max_len).alias("first_values"))
            for c in cols]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
