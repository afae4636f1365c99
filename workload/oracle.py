"""The results of the registered queries in plain SQL over the same tables.

Every statement is written out per column from the schema. It shares with the operators the fixed
values of ``tablegauge.constants`` and the expressions of the generated messy table, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import combinations

from tablegauge.constants import FINDING_RULES, ID_NAME_WORDS, NONNEGATIVE_KEYWORDS, TARGET_NAME_WORDS
from tablegauge.sources.messy import messy_columns_sql, source_row_sql

from .queries import GATE_LIMITS
from .tables import MESSY_COLUMNS, NUMERIC, TEXT, messy_sql

SCHEMAS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate"
    ),
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
ALL = list(MESSY_COLUMNS)
AT = {c: i for i, c in enumerate(ALL)}
MESSY = f"WITH messy AS ({messy_sql()})"

ID_WORDS, TARGET_WORDS, QUANTITY_PARTS = list(ID_NAME_WORDS), list(TARGET_NAME_WORDS), list(NONNEGATIVE_KEYWORDS)


def each(columns: Iterable[str], select: Callable[[int, str], str], joiner: str = " UNION ALL ") -> str:
    return joiner.join(select(i, c) for i, c in enumerate(columns))


def per_column(columns: Iterable[str], figures: str, table: str = "messy", suffix: str = "", at=None) -> str:
    """One row per column: position, name and figures, where {c} is the column."""
    at = AT if at is None else at
    return each(
        columns,
        lambda _, c: f"SELECT {at[c]} AS position, '{c}' AS \"column\", {figures.replace('{c}', c)} FROM {table} {suffix.replace('{c}', c)}",
    )


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def words_of(name: str) -> str:
    spaced = f"regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({spaced}), '[^a-z0-9]+'), lambda w: w <> '')"


def is_target(name: str) -> str:
    return f"(lower(trim({name})) = 'y' OR list_has_any({words_of(name)}, {listed(TARGET_WORDS)}))"


def is_id(name: str) -> str:
    return f"list_has_any({words_of(name)}, {listed(ID_WORDS)})"


def is_quantity(name: str) -> str:
    return "(" + " OR ".join(f"contains(lower({name}), '{p}')" for p in QUANTITY_PARTS) + ")"


PCT = "round((count(*) - count({c})) / nullif(count(*), 0) * 100, 2)"
REACH = "1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
LOWER = f"quantile_cont({{c}}, 0.25) - {REACH}"
UPPER = f"quantile_cont({{c}}, 0.75) + {REACH}"
DATE = r"'[0-9]{4}-[0-9]{2}-[0-9]{2}'"


# Per group (``keys`` may be empty) and column, the figures the score and the findings need. ------


def facts(columns: list[str], numeric: list[str], text: list[str], table: str, keys: list[str] = []) -> str:
    """WITH entry ``facts``: a row per group and column."""
    k = "".join(f"{g}, " for g in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""

    def one(i: int, c: str) -> str:
        is_number = c in numeric
        d = f"CAST({c} AS DOUBLE)"
        cells = f"(SELECT {k}{c} AS v, {d} AS d FROM {table} WHERE {c} IS NOT NULL)"
        on = " AND ".join(f"a.{g} IS NOT DISTINCT FROM b.{g}" for g in keys) or "true"
        top = f"SELECT {k}max(n) AS top FROM (SELECT {k}count(*) AS n FROM {cells} GROUP BY {k}v) {by}"
        base = (
            f"SELECT {k}count(*) AS n_rows, count({c}) AS filled, count(DISTINCT {c}) AS uniques, "
            + (
                f"min({d}) AS low, max({d}) AS high, count(*) FILTER (WHERE {c} < 0) AS negatives, "
                f"coalesce(bool_and({d} % 1 = 0), false) AS integral, "
                f"CASE WHEN count({c}) >= 3 THEN round(coalesce(CASE WHEN min({d}) = max({d}) THEN 0 ELSE skewness({d}) END, 0), 3) END AS skew, "
                f"quantile_cont({d}, 0.5) AS med, quantile_cont({d}, 0.25) AS q1, quantile_cont({d}, 0.75) AS q3, mad({d}) AS mad, "
                if is_number
                else "NULL::DOUBLE AS low, NULL::DOUBLE AS high, 0 AS negatives, false AS integral, NULL::DOUBLE AS skew, "
                "NULL::DOUBLE AS med, NULL::DOUBLE AS q1, NULL::DOUBLE AS q3, NULL::DOUBLE AS mad, "
            )
            + (f"count(*) FILTER (WHERE regexp_full_match({c}, {DATE})) AS dates" if c in text else "0 AS dates")
            + f" FROM {table} {by}"
        )
        far = "0 AS far_iqr, 0 AS far_mad"
        if is_number:
            far = (
                "count(*) FILTER (WHERE b.d < a.q1 - 1.5 * (a.q3 - a.q1) OR b.d > a.q3 + 1.5 * (a.q3 - a.q1)) AS far_iqr, "
                "count(*) FILTER (WHERE a.mad > 0 AND abs(0.6745 * (b.d - a.med) / a.mad) > 3.5) AS far_mad"
            )
        figures = "n_rows, filled, uniques, low, high, negatives, integral, skew, dates"
        a = "".join(f"a.{g}, " for g in keys)
        return (
            f"SELECT {i} AS pos, '{c}' AS name, {str(is_number).lower()} AS is_number, {a}{', '.join('a.' + f for f in figures.split(', '))}, "
            f"coalesce(t.top, 0) AS top, {far} FROM ({base}) a "
            f"LEFT JOIN ({top}) t ON {on.replace('b.', 't.')} LEFT JOIN {cells} b ON {on} "
            f"GROUP BY ALL"
        )

    rows = each(columns, one)
    return (
        f"facts AS (SELECT *, round((n_rows - filled) / nullif(n_rows, 0) * 100, 2) AS pct, "
        f"uniques <= 1 AS is_constant, uniques > 1 AND top / filled >= 0.95 AS is_near_constant, {is_target('name')} AS is_target, "
        f"coalesce(uniques / nullif(n_rows, 0) >= 0.9 AND uniques >= 10 AND ({is_id('name')} OR NOT is_number "
        f"OR (integral AND uniques = filled AND high - low + 1 = filled)), false) AS is_id, "
        f"coalesce(dates / nullif(filled, 0) >= 0.8, false) AS is_date, negatives > 0 AND {is_quantity('name')} AS is_negative, "
        f"is_number AND filled >= 3 AND abs(skew) > 2 AS is_skewed FROM ({rows}))"
    )


def _pearson(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_pop({a}::DOUBLE, {b}::DOUBLE) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0)"


def pairs(numeric: list[str], table: str, keys: list[str] = []) -> str:
    """WITH entry ``pairs``: correlations of numeric columns a < b, null where undefined."""
    k = "".join(f"{g}, " for g in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    rows = " UNION ALL ".join(
        f"SELECT {k}{i} AS pos_a, {j} AS pos_b, '{a}' AS a, '{b}' AS b, {_pearson(a, b)} AS r FROM {table} {by}"
        for (i, a), (j, b) in combinations([(AT.get(c, n), c) for n, c in enumerate(numeric)], 2)
    )
    return f"pairs AS ({rows or 'SELECT 0 AS pos_a, 0 AS pos_b, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS r WHERE false'})"


def twins(columns: dict[str, str], table: str, keys: list[str] = []) -> str:
    """WITH entry ``twins``: identical columns of one type."""
    k = "".join(f"{g}, " for g in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    names = list(columns)
    rows = " UNION ALL ".join(
        f"SELECT {k}{names.index(a)} AS pos_a, {names.index(b)} AS pos_b, '{a}' AS a, '{b}' AS b, "
        f"bool_and({a} IS NOT DISTINCT FROM {b}) AS same FROM {table} {by}"
        for a, b in combinations(names, 2)
        if columns[a] == columns[b]
    )
    return f"twins AS (SELECT * FROM ({rows}) WHERE same)"


def copies(columns: list[str], table: str, keys: list[str] = []) -> str:
    """WITH entry ``copies``: rows and duplicate rows."""
    k = "".join(f"{g}, " for g in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    every = ", ".join(dict.fromkeys([*keys, *columns]))
    return (
        f"copies AS (SELECT {k}coalesce(sum(n), 0) AS n_rows, coalesce(sum(n - 1), 0) AS n_copies "
        f"FROM (SELECT {every}, count(*) AS n FROM {table} GROUP BY ALL) {by})"
    )


CATEGORIES = (
    "missing_values", "duplicate_rows", "outliers", "duplicate_columns", "constant_columns",
    "mixed_type_columns", "negative_values", "skewed_distributions", "correlated_columns",
)


def points(keys: list[str] = []) -> str:
    """WITH entry ``points``: what each category costs, per group."""
    on = " AND ".join(f"x.{g} IS NOT DISTINCT FROM c.{g}" for g in keys) or "true"
    k = "".join(f"c.{g}, " for g in keys)

    def over(table: str, figure: str) -> str:
        return f"(SELECT {figure} FROM {table} x WHERE {on})"

    raw = {
        "missing_values": (25, "25 * " + over("facts", "0.7::DOUBLE * (max(pct) / 100) + 0.3::DOUBLE * (avg(pct) / 100)")),
        "duplicate_rows": (20, "20 * (c.n_copies / nullif(c.n_rows, 0))"),
        "outliers": (15, "15 * 100 * " + over("facts", "sum(far_mad) / nullif(sum(filled), 0)").replace("FROM facts x WHERE", "FROM facts x WHERE is_number AND")),
        "duplicate_columns": (10, "3 * " + over("twins", "count(*)")),
        "constant_columns": (10, "3 * " + over("facts", "count(*) FILTER (WHERE is_constant)")),
        "mixed_type_columns": (5, "0"),
        "negative_values": (5, "2.5 * " + over("facts", "count(*) FILTER (WHERE is_negative)")),
        "skewed_distributions": (
            5, "5 * 2 * " + over("facts", "count(*) FILTER (WHERE is_skewed) / nullif(count(*) FILTER (WHERE is_number AND filled >= 3), 0)"),
        ),
        "correlated_columns": (5, over("pairs", "count(*) FILTER (WHERE abs(r) >= 0.9)")),
    }
    rows = " UNION ALL ".join(
        f"SELECT {k}'{c}' AS category, round_even(least({cap}::DOUBLE, coalesce(({sql})::DOUBLE, 0)), 1) AS points FROM copies c"
        for c, (cap, sql) in raw.items()
    )
    return f"points AS ({rows})"


def scored(keys: list[str] = []) -> str:
    k = "".join(f"{g}, " for g in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    costs = ", ".join(f"max(points) FILTER (WHERE category = '{c}') AS {c}" for c in CATEGORIES)
    return (
        f"scored AS (SELECT {k}greatest(0, round_even(100 - ({' + '.join(CATEGORIES)}), 0))::INTEGER AS score, "
        f"{', '.join(CATEGORIES)} FROM (SELECT {k}{costs} FROM points {by})), "
        f"graded AS (SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 "
        f"THEN 'Fair' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END AS grade FROM scored)"
    )


def bases(keys: list[str] = []) -> str:
    """All of the above for the messy view."""
    keyed = {c: t for c, (t, _) in MESSY_COLUMNS.items() if c not in keys}
    numeric, text = [c for c in NUMERIC if c in keyed], [c for c in TEXT if c in keyed]
    return ", ".join([
        MESSY, facts(list(keyed), numeric, text, "messy", keys), pairs(numeric, "messy", keys),
        twins(keyed, "messy", keys), copies(ALL, "messy", keys), points(keys), scored(keys),
    ])


def rules(method: str) -> str:
    """The findings over the entries facts, twins and pairs; the sentences are the fixed ones."""
    none = "NULL::VARCHAR"
    # rule -> entry, names of the columns, what hits, value
    hits = {
        "missingness": ("facts", ("name",), "pct > 30", "pct::VARCHAR"),
        "constant": ("facts", ("name",), "is_constant", none),
        "near_constant": ("facts", ("name",), "is_near_constant", none),
        "possible_target": ("facts", ("name",), "is_target", none),
        "id_like": ("facts", ("name",), "is_id", none),
        "outliers": ("facts", ("name",), f"far_{method} > 0", f"far_{method}::VARCHAR"),
        "duplicate_columns": ("twins", ("a", "b"), "true", none),
        "correlated": ("pairs", ("a", "b"), "abs(r) >= 0.9", "round(abs(r), 3)::VARCHAR"),
        "date_like": ("facts", ("name",), "is_date", none),
        "negative": ("facts", ("name",), "is_negative", none),
        "skewed": ("facts", ("name",), "is_skewed", "skew::VARCHAR"),
    }
    parts = []
    for number, (rule, severity, sentence) in enumerate(FINDING_RULES, start=1):
        if rule not in hits:  # no typed column is mixed
            continue
        entry, names, hit, value = hits[rule]
        words = [*names, value, f"'{method.upper()}'"][: sentence.count("%s")]
        text = sentence.replace("'", "''")
        parts.append(
            f"SELECT {number} AS rule_no, '{rule}' AS rule, '{severity}' AS severity, {names[0]} AS column_a, "
            f"{names[1] if len(names) > 1 else none} AS column_b, {value} AS value, printf('{text}', {', '.join(words)}) AS message "
            f"FROM {entry} WHERE {hit}"
        )
    return " UNION ALL ".join(parts)


# Statements ---------------------------------------------------------------------------------------


def _types() -> str:
    named = "CASE typeof(any_value({c})) WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(typeof(any_value({c}))) END"
    return per_column(ALL, f"{named} AS type, count({{c}}) AS filled")


def _bytes(column: str, data_type: str) -> str:
    widths = {"bigint": 8, "int": 4, "double": 8, "boolean": 1, "date": 4}
    return f"count(*) * {widths[data_type]}" if data_type in widths else f"coalesce(sum(strlen({column})), 0)"


def _memory(columns: dict[str, str], table: str) -> str:
    return each(
        columns, lambda i, c: f"SELECT {i} AS position, '{c}' AS \"column\", round(({_bytes(c, columns[c])})::DOUBLE / 1024, 2) AS kilobytes FROM {table}"
    )


def _sequential(columns: list[str], at: dict[str, int], table: str) -> str:
    run = (
        "coalesce(bool_and({c}::DOUBLE % 1 = 0) AND count(DISTINCT {c}) = count({c}) "
        "AND max({c}) - min({c}) + 1 = count({c}), false) AS sequential"
    )
    return per_column(columns, run, table, at=at)


def _shape_of(columns: list[str], at: dict[str, int], table: str) -> str:
    flat = "min({c}) = max({c})"
    return per_column(
        columns,
        f"round(CASE WHEN {flat} THEN 0 ELSE skewness({{c}}::DOUBLE) END, 3)::DOUBLE AS skewness, "
        f"round(CASE WHEN count({{c}}) < 4 THEN NULL WHEN {flat} THEN 0 ELSE kurtosis({{c}}::DOUBLE) END, 3)::DOUBLE AS kurtosis",
        table, "HAVING count({c}) >= 3", at,
    )


def _outliers(columns: list[str], at: dict[str, int], table: str, method: str) -> str:
    def one(_: int, c: str) -> str:
        if method == "iqr":
            limits = f"SELECT {LOWER.replace('{c}', c)} AS lo, {UPPER.replace('{c}', c)} AS hi FROM {table}"
            hit = f"{c} < lo OR {c} > hi"
        else:
            limits = f"SELECT quantile_cont({c}, 0.5) AS med, mad({c}) AS mad FROM {table}"
            hit = f"mad > 0 AND abs(0.6745 * ({c} - med) / mad) > 3.5"
        return (
            f"SELECT {at[c]} AS position, '{c}' AS \"column\", count(*) FILTER (WHERE {hit}) AS outliers "
            f"FROM {table}, ({limits}) AS s"
        )

    return each(columns, one)


def _histogram(columns: list[str], at: dict[str, int], table: str, bins: int) -> str:
    def one(_: int, c: str) -> str:
        ends = f"SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, (max({c})::DOUBLE - min({c})::DOUBLE) / {bins} AS step FROM {table}"
        # A value belongs to the last bin whose lower edge it reaches.
        edges = f"SELECT i AS bin, lo + (i - 1) * step AS lower, CASE WHEN i = {bins} THEN hi ELSE lo + i * step END AS upper, i = {bins} AS is_last FROM ends, range(1, {bins + 1}) AS r(i)"
        return (
            f"SELECT {at[c]} AS position, '{c}' AS \"column\", bin::INTEGER AS bin, round(lower, 3) AS lower, round(upper, 3) AS upper, "
            f"coalesce(sum(n) FILTER (WHERE v >= lower AND (v < upper OR is_last)), 0)::BIGINT AS count "
            f"FROM (WITH ends AS ({ends}) {edges}) e, (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"WHERE lower < upper GROUP BY ALL"
        )

    return each(columns, one)


def _boxes(columns: list[str], at: dict[str, int], table: str) -> str:
    def one(_: int, c: str) -> str:
        limits = f"SELECT {LOWER.replace('{c}', c)} AS lo, {UPPER.replace('{c}', c)} AS hi FROM {table}"
        near = f"{c} >= lo AND {c} <= hi"
        figures = {
            "min": f"min({c})", "q1": f"quantile_cont({c}, 0.25)", "median": f"quantile_cont({c}, 0.5)",
            "q3": f"quantile_cont({c}, 0.75)", "max": f"max({c})",
            "whisker_low": f"coalesce(min({c}) FILTER (WHERE {near}), min({c}))",
            "whisker_high": f"coalesce(max({c}) FILTER (WHERE {near}), max({c}))",
        }
        rounded = ", ".join(f'round(({sql})::DOUBLE, 3) AS "{name}"' for name, sql in figures.items())
        return f"SELECT {at[c]} AS position, '{c}' AS \"column\", {rounded} FROM {table}, ({limits}) AS s HAVING count({c}) > 0"

    return each(columns, one)


def _points_of(columns: list[str], at: dict[str, int], table: str, order: str) -> str:
    def one(_: int, c: str) -> str:
        limits = f"SELECT {LOWER.replace('{c}', c)} AS lo, {UPPER.replace('{c}', c)} AS hi FROM {table}"
        return (
            f"SELECT {at[c]} AS position, '{c}' AS \"column\", (row_number() OVER (ORDER BY {order.replace('{c}', c)}))::INTEGER AS nth, "
            f"round({c}::DOUBLE, 3) AS value FROM {table}, ({limits}) AS s WHERE {c} < lo OR {c} > hi QUALIFY nth <= 50"
        )

    return each(columns, one)


def _lexical() -> str:
    classes = (
        "CASE WHEN regexp_full_match({c}, '\\s*[+-]?[0-9]+\\s*') THEN 'integer' "
        "WHEN regexp_full_match({c}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN 'decimal' "
        "WHEN lower(trim({c})) IN ('true', 'false') THEN 'boolean' "
        f"WHEN regexp_full_match({{c}}, {DATE}) THEN 'date' ELSE 'text' END AS class, count(*) AS count"
    )
    return per_column(TEXT, classes, suffix="WHERE {c} IS NOT NULL GROUP BY ALL")


def _lengths(columns: list[str], at: dict[str, int], table: str, keys: str = "") -> str:
    figures = (
        "round(avg(length({c})), 1) AS avg_length, min(length({c}))::INTEGER AS min_length, "
        "max(length({c}))::INTEGER AS max_length, count(*) FILTER (WHERE regexp_full_match({c}, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]*')) AS blank"
    )
    by = f"GROUP BY {keys} HAVING count({{c}}) > 0" if keys else "HAVING count({c}) > 0"
    return per_column(columns, (f"{keys}, " if keys else "") + figures, table, by, at)


def _matrix() -> str:
    pair = ", ".join([MESSY, pairs(NUMERIC, "messy")])
    own = each(
        NUMERIC, lambda _, c: f"SELECT '{c}' AS column_a, '{c}' AS column_b, CASE WHEN min({c}) < max({c}) THEN 1 ELSE 0 END::DOUBLE AS corr FROM messy"
    )
    r = "round(coalesce(r, 0), 3) + 0 AS corr"
    return f"{pair} SELECT a AS column_a, b AS column_b, {r} FROM pairs UNION ALL SELECT b, a, {r} FROM pairs UNION ALL {own}"


def _catalog() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, {i} AS position, '{c}' AS \"column\", count({c}) AS filled FROM {t}"
        for t, names in SCHEMAS.items()
        for i, c in enumerate(names.split())
    )


def _documents_findings() -> str:
    columns = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    numeric, text = ["doc_id", "n_chars"], ["text", "lang", "source"]
    entries = [facts(list(columns), numeric, text, "documents"), pairs(numeric, "documents"), twins(columns, "documents")]
    return f"WITH {', '.join(entries)} {rules('iqr')}"


def _by_group(table: str, columns: list[str], keys: str, figures: str) -> str:
    return each(columns, lambda i, c: f"SELECT {keys}, {i} AS position, '{c}' AS \"column\", {figures.replace('{c}', c)} FROM {table} GROUP BY {keys}")


_GENERATED = messy_columns_sql("n")
_GENERATED["signup_date"] = "strftime(TIMESTAMP '2020-01-01' + to_minutes(n::INTEGER), '%Y-%m-%d %H:%M:%S')"
_GENERATED_ORDER = ("id", "age", "income", "score", "signup_date", "category", "region", "notes", "email", "active")
_GENERATED_TYPES = dict(zip(_GENERATED_ORDER, "bigint double double double string string string string string boolean".split()))
GENERATED_ROWS = (
    f"SELECT {', '.join(f'{_GENERATED[c]} AS {c}' for c in _GENERATED_ORDER)} "
    f"FROM (SELECT {source_row_sql('o_orderkey')} AS n FROM orders)"
)


def _generated_score() -> str:
    numeric = ["id", "age", "income", "score"]
    text = ["signup_date", "category", "region", "notes", "email"]
    date = facts(list(_GENERATED_TYPES), numeric, text, "made")
    entries = [
        f"made AS ({GENERATED_ROWS})", date, pairs(numeric, "made"), twins(_GENERATED_TYPES, "made"),
        copies(list(_GENERATED_TYPES), "made"), points(), scored(),
    ]
    return f"WITH {', '.join(entries)} SELECT score, grade, {', '.join(CATEGORIES)} FROM graded"


def _gate() -> str:
    checks = {
        "rows": "SELECT max(n_rows) FROM copies", "duplicate_rows": "SELECT max(n_copies) FROM copies",
        "missing_percentage": "SELECT max(pct) FROM facts", "outliers_iqr": "SELECT sum(far_iqr) FROM facts",
        "outliers_mad": "SELECT sum(far_mad) FROM facts",
        "outlier_columns": "SELECT count(*) FROM facts WHERE far_mad > 0",
        "constant_columns": "SELECT count(*) FROM facts WHERE is_constant", "score": "SELECT score FROM graded",
    }
    rows = " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", ({sql})::DOUBLE AS actual, '{GATE_LIMITS[check][0]}' AS bound, {GATE_LIMITS[check][1]}::DOUBLE AS \"limit\""
        for check, sql in checks.items()
    )
    return f"{bases()} SELECT *, CASE WHEN bound = 'min' THEN actual >= \"limit\" ELSE actual <= \"limit\" END AS passed FROM ({rows})"


def _full_profile() -> str:
    def listing(flag: str) -> str:
        return f"(SELECT coalesce(string_agg(name, ',' ORDER BY pos), '') FROM facts WHERE {flag})"

    def fact(column: str, name: str) -> str:
        return f"(SELECT {column} FROM facts WHERE name = '{name}')"

    figures = {
        "score": "score", "grade": "grade", "rows": "(SELECT n_rows::BIGINT FROM copies)",
        "columns": f"{len(ALL)}::BIGINT", "duplicates": "(SELECT n_copies::BIGINT FROM copies)", "tax_type": "'double'",
        "tax_missing": fact("n_rows - filled", "tax"), "empty_percentage": fact("pct", "empty_col"),
        "ship_days": fact("uniques", "ship_text"), "constants": listing("is_constant"),
        "near_constants": listing("is_near_constant"), "targets": listing("is_target"), "dates": listing("is_date"),
        "negatives": listing("is_negative"), "amount_iqr": fact("far_iqr", "amount"), "amount_mad": fact("far_mad", "amount"),
        "amount_skewness": fact("skew", "amount"), "twin": "(SELECT b FROM twins ORDER BY pos_a, pos_b LIMIT 1)",
        "correlated": "(SELECT count(*)::INTEGER FROM pairs WHERE abs(r) >= 0.9)",
        "price_gross": "(SELECT round(r, 3) FROM pairs WHERE a = 'price' AND b = 'gross')",
        "price_binned": fact("filled", "price"),
        "quantity_median": "(SELECT round(quantile_cont(quantity, 0.5), 3) FROM messy)",
        "amount_points": f"least(50, {fact('far_iqr', 'amount')})::INTEGER",
        "blank_notes": "(SELECT count(*) FROM messy WHERE trim(note) = '')",
        "batch_kb": "(SELECT round(count(*) / 1024, 2) FROM messy)",
        "insights": f"(SELECT count(*)::INTEGER FROM ({rules('mad')}))",
    }
    return f"{bases()} SELECT {', '.join(f'{sql} AS {name}' for name, sql in figures.items())} FROM graded"


def _as_read(column: str) -> str:
    data_type = MESSY_COLUMNS[column][0]
    return {"int": f"{column}::BIGINT AS {column}", "date": f"{column}::VARCHAR AS {column}"}.get(data_type, column)


def _read_types(narrow: bool) -> str:
    def one(i: int, c: str) -> str:
        data_type = {"int": "bigint", "date": "string"}.get(MESSY_COLUMNS[c][0], MESSY_COLUMNS[c][0])
        made = f"'{data_type}'"
        if narrow and data_type == "bigint":
            fits = [(8, "tinyint"), (16, "smallint"), (32, "int")]
            whens = " ".join(f"WHEN min({c}) >= {-(1 << b - 1)} AND max({c}) < {1 << b - 1} THEN '{t}'" for b, t in fits)
            made = f"CASE {whens} ELSE 'bigint' END"
        return f"SELECT {i} AS position, '{c}' AS \"column\", {made} AS type, count({c}) AS filled FROM messy"

    return f"{MESSY} {each(ALL, one)}"


_DOC = ["doc_id", "text", "lang", "source", "n_chars"]
_DOC_AT = {c: i for i, c in enumerate(_DOC)}
_EVENT_AT = {"event_id": 0, "user_id": 2, "value": 4}
_ORDER_COLUMNS = SCHEMAS["orders"].split()
_ORDER_AT = {c: i for i, c in enumerate(_ORDER_COLUMNS)}



def _near_constant() -> str:
    def one(i: int, c: str) -> str:
        return (
            f"SELECT {i} AS position, '{c}' AS \"column\", round(max(n) / sum(n), 4) AS share "
            f"FROM (SELECT {c}, count(*) AS n FROM messy WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"HAVING count(*) > 1 AND max(n) / sum(n) >= 0.95"
        )

    return f"{MESSY} {each(ALL, one)}"


def _constant() -> str:
    return f"{MESSY} {per_column(ALL, '', suffix='HAVING count(DISTINCT {c}) <= 1').replace(', ' + ' FROM', ' FROM')}"


def _messy_facts(select: str) -> str:
    return f"{MESSY}, {facts(ALL, NUMERIC, TEXT, 'messy')} {select}"


_NAMED = 'pos AS position, name AS "column"'


_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def oracle() -> dict[str, str]:
    made = {
        "shape": f"{MESSY} SELECT count(*) AS rows, {len(ALL)}::BIGINT AS columns FROM messy",
        "column_types": f"{MESSY} {_types()}",
        "missing_values": f"{MESSY} {per_column(ALL, 'count(*) - count({c}) AS missing')}",
        "missing_percentage": f"{MESSY} {per_column(ALL, PCT + ' AS percentage')}",
        "duplicate_rows": f"{MESSY}, {copies(ALL, 'messy')} SELECT n_copies::BIGINT AS duplicates FROM copies",
        "duplicate_rows_by_group": (
            f"{MESSY}, {copies(ALL, 'messy', ['return_flag', 'finished'])} "
            "SELECT return_flag, finished, n_copies::BIGINT AS duplicates FROM copies"
        ),
        "unique_counts": f"{MESSY} {per_column(ALL, 'count(DISTINCT {c}) AS distinct_values')}",
        "unique_counts_documents": per_column(_DOC, "count(DISTINCT {c}) AS distinct_values", "documents", at=_DOC_AT),
        "unique_counts_approx_near": " UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS \"column\", true AS near" for i, c in enumerate(_LINEITEM)
        ),
        "near_constant_columns_approx": _near_constant(),
        "sequential_integers_approx": _sequential(["o_orderkey", "o_custkey", "o_totalprice"], _ORDER_AT, "orders"),
        "high_cardinality_approx": (
            f"WITH {facts(_ORDER_COLUMNS, ['o_orderkey', 'o_custkey', 'o_totalprice'], ['o_orderstatus', 'o_orderpriority'], 'orders')} "
            f"SELECT {_NAMED} FROM facts WHERE is_id"
        ),
        "iqr_bounds_approx_near": " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", true AS q1, true AS q3" for c in _LINEITEM[:8]
        ),
        "merged_states": " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, true AS distinct_near, "
            + ", ".join(f"{'true' if i < 8 else 'NULL::BOOLEAN'} AS {q}" for q in ("q1", "median", "q3")) + " FROM lineitem"
            for i, c in enumerate(_LINEITEM)
        ),
        "non_finite_values": (
            "SELECT 0 AS position, 'l_extendedprice' AS \"column\", 0::BIGINT AS non_finite UNION ALL "
            "SELECT 1, 'ratio', count(*) FROM lineitem WHERE l_tax = 0 AND l_discount <> 0 UNION ALL SELECT 2, 'l_linenumber', 0"
        ),
        "mixed_type_columns_lexical": (
            "SELECT 1 AS position, 'kind' AS \"column\", 2::INTEGER AS types FROM events HAVING bool_or(event_type = 'error' "
            "AND value IS NOT NULL) AND bool_or(event_type <> 'error')"
        ),
        "score_mixed_type_columns_lexical": (
            "SELECT 'mixed_type_columns' AS category, CASE WHEN bool_or(event_type = 'error' AND value IS NOT NULL) "
            "AND bool_or(event_type <> 'error') THEN 2.5 ELSE 0 END::DOUBLE AS points FROM events"
        ),
        "lexical_types_approx": f"{MESSY} {_lexical()}",
        "constant_columns": _constant(),
        "near_constant_columns": _near_constant(),
        "duplicate_columns": (
            f"{MESSY}, {twins({c: t for c, (t, _) in MESSY_COLUMNS.items()}, 'messy')} "
            "SELECT a AS column_a, b AS column_b FROM twins"
        ),
        "memory_usage": f"{MESSY} {_memory({c: t for c, (t, _) in MESSY_COLUMNS.items()}, 'messy')}",
        "memory_usage_documents": _memory(
            {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}, "documents"
        ),
        "sequential_integers": _sequential(["o_orderkey", "o_custkey", "o_totalprice"], _ORDER_AT, "orders"),
        "sequential_integers_messy": f"{MESSY} {_sequential(NUMERIC, AT, 'messy')}",
        "high_cardinality": (
            f"WITH {facts(_DOC, ['doc_id', 'n_chars'], ['text', 'lang', 'source'], 'documents')} "
            f"SELECT {_NAMED}, uniques AS distinct_values FROM facts WHERE is_id"
        ),
        "high_cardinality_orders": (
            f"WITH {facts(_ORDER_COLUMNS, ['o_orderkey', 'o_custkey', 'o_totalprice'], ['o_orderstatus', 'o_orderpriority'], 'orders')} "
            f"SELECT {_NAMED}, uniques AS distinct_values FROM facts WHERE is_id"
        ),
        "possible_target_columns": _messy_facts(f"SELECT {_NAMED} FROM facts WHERE is_target"),
        "target_names": f"SELECT * FROM ({_catalog()}) WHERE " + is_target('"column"'),
        "name_words": (
            f"WITH names AS ({_catalog()} UNION ALL SELECT 'events.props', NULL, k, count(*) FROM "
            "(SELECT unnest(json_keys(props::JSON)) AS k FROM events) GROUP BY k) "
            f"SELECT names.*, (i - 1)::INTEGER AS nth, words[i] AS word FROM (SELECT *, {words_of('\"column\"')} AS words FROM names) AS names, "
            "range(1, 20) AS r(i) WHERE i <= len(words)"
        ).replace("SELECT names.*,", 'SELECT dataset, position, "column", filled,'),
        "id_like_name": f"SELECT *, {is_id('\"column\"')} AS id_like FROM ({_catalog()})",
        "iqr_bounds": f"{MESSY} " + per_column(
            NUMERIC,
            "round(quantile_cont({c}, 0.25)::DOUBLE, 3) AS q1, round(quantile_cont({c}, 0.75)::DOUBLE, 3) AS q3, "
            f"round(({LOWER})::DOUBLE, 3) AS lower, round(({UPPER})::DOUBLE, 3) AS upper",
            suffix="HAVING count({c}) > 0",
        ),
        "iqr_bounds_by_group": _by_group(
            "events", ["user_id", "value"], "event_type",
            "round(quantile_cont({c}, 0.25)::DOUBLE, 3) AS q1, round(quantile_cont({c}, 0.75)::DOUBLE, 3) AS q3, "
            f"round(({LOWER})::DOUBLE, 3) AS lower, round(({UPPER})::DOUBLE, 3) AS upper",
        ),
        "outliers_iqr": f"{MESSY} {_outliers(NUMERIC, AT, 'messy', 'iqr')}",
        "outliers_iqr_events": _outliers(list(_EVENT_AT), _EVENT_AT, "events", "iqr"),
        "outliers_mad": f"{MESSY} {_outliers(NUMERIC, AT, 'messy', 'mad')}",
        "outliers_mad_documents": _outliers(["doc_id", "n_chars"], _DOC_AT, "documents", "mad"),
        "outliers_mad_by_group": (
            "SELECT lang, source, 0 AS position, 'n_chars' AS \"column\", "
            "count(*) FILTER (WHERE mad > 0 AND abs(0.6745 * (n_chars - med) / mad) > 3.5) AS outliers FROM documents JOIN "
            "(SELECT lang, source, quantile_cont(n_chars, 0.5) AS med, mad(n_chars) AS mad FROM documents GROUP BY lang, source) "
            "USING (lang, source) GROUP BY lang, source"
        ),
        "distribution_shape": f"{MESSY} {_shape_of(NUMERIC, AT, 'messy')}",
        "distribution_shape_labels": _shape_of(["doc_id", "quality", "toxic"], {"doc_id": 0, "quality": 1, "toxic": 2}, "labels"),
        "correlation_matrix": _matrix(),
        "correlated_columns": (
            f"{MESSY}, {pairs(NUMERIC, 'messy')} SELECT a AS column_a, b AS column_b, round(abs(r), 3) AS strength "
            "FROM pairs WHERE abs(r) >= 0.9"
        ),
        "histogram": f"{MESSY} {_histogram(NUMERIC, AT, 'messy', 10)}",
        "histogram_events": _histogram(list(_EVENT_AT), _EVENT_AT, "events", 25),
        "boxplot_stats": f"{MESSY} {_boxes(NUMERIC, AT, 'messy')}",
        "boxplot_outliers": f"{MESSY} " + _points_of(NUMERIC, AT, "messy", "greatest(lo - {c}, {c} - hi) DESC, {c} DESC"),
        "boxplot_outliers_first": _points_of(list(_EVENT_AT), _EVENT_AT, "events", "event_id, {c}"),
        "negative_in_nonnegative": _messy_facts(f"SELECT {_NAMED}, negatives FROM facts WHERE is_negative"),
        "chartable_columns": _messy_facts(f"SELECT {_NAMED} FROM facts WHERE is_number AND uniques > 1 AND NOT is_id"),
        "date_like_columns": _messy_facts(f"SELECT {_NAMED}, round(dates / filled, 4) AS share FROM facts WHERE is_date"),
        "date_like_columns_first": f"{MESSY} " + each(
            TEXT,
            lambda _, c: (
                f"SELECT {AT[c]} AS position, '{c}' AS \"column\", round(avg(CASE WHEN regexp_full_match({c}, {DATE}) THEN 1 ELSE 0 END), 4) AS share "
                f"FROM (SELECT {c} FROM messy WHERE {c} IS NOT NULL ORDER BY order_id, {c} LIMIT 20) HAVING share >= 0.8"
            ),
        ),
        "mixed_type_columns": (
            "SELECT 2 AS position, 'payload_or_value' AS \"column\", count(DISTINCT t)::INTEGER AS types FROM "
            "(SELECT json_type((CASE WHEN event_type = 'error' THEN value::VARCHAR ELSE props END)::JSON) AS t FROM events) "
            "HAVING count(DISTINCT t) > 1"
        ),
        "lexical_types": f"{MESSY} {_lexical()}",
        "text_column_stats": f"{MESSY} {_lengths(TEXT, AT, 'messy')}",
        "text_column_stats_conversations": _lengths(["text"], {"text": 2}, "conversations", "role"),
        **{f"score_{c}": f"{bases()} SELECT category, points FROM points WHERE category = '{c}'" for c in CATEGORIES},
        "health_score": f"{bases()} SELECT score, grade, {', '.join(CATEGORIES)} FROM graded",
        "health_score_by_group": f"{bases(['return_flag'])} SELECT return_flag, score, grade, {', '.join(CATEGORIES)} FROM graded",
        "health_score_generated": _generated_score(),
        "score_breakdown": f"{bases()} SELECT category, points FROM points WHERE points > 0",
        "findings": f"{bases()} {rules('mad')}",
        "findings_iqr_documents": _documents_findings(),
        "quality_gate": _gate(),
        "full_profile": _full_profile(),
        "report_json": (
            f"{bases()} SELECT score::VARCHAR AS score, grade, (SELECT n_copies::BIGINT::VARCHAR FROM copies) AS duplicates, "
            "NULL::VARCHAR AS empty_kurtosis, (SELECT pct::VARCHAR FROM facts WHERE name = 'tax') AS missing_tax FROM graded"
        ),
        "json_safe": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS ratio FROM lineitem",
        "profile_tables": (
            f"{MESSY} SELECT 'first' AS run, * FROM ({per_column(ALL, PCT + ' AS percentage')}) UNION ALL "
            f"SELECT 'second' AS run, * FROM ({per_column(ALL, PCT + ' AS percentage', suffix=_SECOND)})"
        ),
        "read_csv": f"{MESSY} SELECT {', '.join(map(_as_read, ALL))} FROM messy",
        "read_csv_latin1": "SELECT doc_id, lang, source, replace(text, chr(10), ' ') AS text FROM documents",
        "read_csv_short_rows": (
            "SELECT o_orderkey AS \"order\", o_custkey AS customer, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status FROM orders"
        ),
        "na_tokens": (
            "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS event_type, "
            "CASE WHEN value >= 1 AND value <= 50 THEN trunc(value)::INTEGER::VARCHAR END AS value FROM events"
        ),
        "infer_types": _read_types(narrow=False),
        "encoding_check": (
            "SELECT lang, lang <> 'fr' OR NOT bool_or(regexp_matches(text, '[^\\x00-\\x7f]')) AS valid_utf8 FROM documents GROUP BY lang"
        ),
        "header_names": 'SELECT c_custkey AS "key", c_nationkey::BIGINT AS "key.1", c_mktsegment AS "Unnamed: 2" FROM customer',
        "ragged_rows": "SELECT o_orderkey, 4 AS cells FROM orders WHERE o_orderpriority = '1-URGENT'",
        "downcast": _read_types(narrow=True),
        "quick_scan": (
            "SELECT o_orderstatus AS status, count(*) AS rows, 6::BIGINT AS columns, "
            "CASE o_orderstatus WHEN 'F' THEN ',' WHEN 'O' THEN ';' ELSE '|' END AS delimiter FROM orders GROUP BY o_orderstatus"
        ),
        "detect_delimiter": (
            "SELECT p_partkey, CASE WHEN p_size > 40 THEN ',' WHEN p_size > 25 THEN ';' ELSE '|' END AS delimiter, 4::BIGINT AS columns FROM part"
        ),
        "generate_messy": GENERATED_ROWS,
        "profile_files_mixed": " UNION ALL ".join(
            f"SELECT '{status}' AS file, {i} AS position, '{c}' AS \"column\", '{t}' AS type, "
            f"{'0::BIGINT' if c == 'remark' else 'count(*)'} AS filled FROM orders WHERE o_orderstatus = '{status}' HAVING count(*) > 0"
            for status, columns in (
                ("F", {"key": "bigint", "amount": "double"}), ("O", {"key": "string", "amount": "bigint"}),
                ("P", {"buyer": "bigint", "urgent": "boolean", "remark": "double"}),
            )
            for i, (c, t) in enumerate(columns.items())
        ),
        "load_errors": "SELECT DISTINCT o_orderstatus AS status, o_orderstatus = 'P' AS unclosed FROM orders",
        "read_csv_quoted_breaks": "SELECT doc_id, nullif(replace(text, ' ', chr(10)), '') AS text FROM documents",
        "bom_strip": 'SELECT o_orderkey AS "order", o_custkey AS customer FROM orders',
        "profile_files": f"{MESSY} " + each(
            ALL,
            lambda i, c: (
                f"SELECT return_flag AS file, {i} AS position, '{c}' AS \"column\", {PCT.replace('{c}', c)} AS percentage FROM messy GROUP BY return_flag"
            ),
        ),
    }
    return made


_SECOND = "WHERE return_flag <> 'N'"
