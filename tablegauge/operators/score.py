"""The health score with its breakdown, the findings, and a gate on them.

All of it is computed from the small per-column and per-pair tables of a profile, per group where there
are groups. Each category and each check names the facts it needs, and only their bases are computed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEDUCTION_CAPS, FINDING_RULES, GRADES
from ..functions.expressions import PERCENTAGE
from ..plans.profile import PAIRS, SKEWNESS, Profile
from ..plans.stats import aggregate
from ..plans.table import quoted
from .numeric import correlated


def _figures(p: Profile) -> dict[str, tuple[tuple[str, ...], str]]:
    """category -> (facts it needs, points before the cap as an aggregate over the columns)."""
    flags, numeric = p.flags, p.table.among(p.table.numeric)
    shaped, skewed = flags["shaped"][1], flags["skewed"][1]
    caps = DEDUCTION_CAPS

    def each(flag: str, points: str) -> tuple[tuple[str, ...], str]:
        needs, hit = flags[flag]
        return needs, f"count_if({hit}) * {points}"

    return {
        # The worst column counts most; the average of all columns still registers.
        "missing_values": (
            ("missing", "rows"),
            f"(0.7D * (max({PERCENTAGE}) / 100) + 0.3D * (avg({PERCENTAGE}) / 100)) * {caps['missing_values']}",
        ),
        # Always by distance from the median. One outlier in a hundred cells costs all points.
        "outliers": (
            ("outliers_mad", "filled"),
            f"try_divide(sum(outliers_mad), sum(if({numeric}, filled, 0))) * 100 * {caps['outliers']}",
        ),
        "constant_columns": each("constant", "3"),
        "mixed_type_columns": each("mixed_type", "2.5D"),
        "negative_values": each("negative", "2.5D"),
        # Half of the numeric columns skewed costs all points.
        "skewed_distributions": (
            flags["skewed"][0],
            f"try_divide(count_if({shaped} and {skewed}), count_if({shaped})) * 2 * {caps['skewed_distributions']}",
        ),
    }


def _points(p: Profile, categories: Iterable[str], groups: DataFrame) -> DataFrame:
    """(groups, category, points): one row per group and category, one decimal, half to even.

    ``groups`` has a row per group, with ``rows``. Where a group has no figures, it has no deduction.
    """
    keys, figures = p.table.groups, _figures(p)
    categories = list(categories) if p.table.fields else []
    made = groups.select(*keys, "rows")
    of_columns = [c for c in categories if c in figures]
    if of_columns:
        needs = dict.fromkeys(n for c in of_columns for n in figures[c][0])
        costs = aggregate(p.facts(*needs), keys, [f"{figures[c][1]} as {c}" for c in of_columns])
        made = p.table.attach(made, costs, how="left")
    if "duplicate_rows" in categories:
        share = f"try_divide(duplicates, rows) * {DEDUCTION_CAPS['duplicate_rows']} as duplicate_rows"
        made = p.table.attach(made, p.duplicates().selectExpr(*keys, share), how="left")
    for category, pairs, points in (
        ("duplicate_columns", p.equal_pairs, 3), ("correlated_columns", lambda: correlated(p), 1)
    ):
        if category in categories:
            made = p.table.attach(made, aggregate(pairs(), keys, [f"count(1) * {points} as {category}"]), how="left")
    rows = [
        f"struct({quoted(c)} as category, bround(least({DEDUCTION_CAPS[c]}D, coalesce(cast({c} as double), 0D)), 1) as points)"
        for c in categories
    ] or [f"struct({quoted(c)} as category, 0D as points)" for c in DEDUCTION_CAPS]
    return made.selectExpr(*keys, f"inline(array({', '.join(rows)}))")


def deduction(source, category: str, **options) -> DataFrame:
    """(category, points) of one category, from only the bases it needs."""
    p = Profile.of(source, **options)
    groups = aggregate(p.table.df, p.table.groups, ["count(1) as rows"])
    return p.table.present(_points(p, [category], groups).where(f"category = {quoted(category)}"), "category", "points")


def all_points(p: Profile) -> DataFrame:
    """(groups, category, points) of every category."""
    p.gather(*dict.fromkeys(n for needs, _ in _figures(p).values() for n in needs), *PAIRS)
    return p.small("points", lambda: _points(p, DEDUCTION_CAPS, p.duplicates()))


def scored(p: Profile) -> DataFrame:
    """(groups, score, grade, one column per category)."""
    wide = aggregate(
        all_points(p), p.table.groups, [f"max(if(category = '{c}', points, null)) as {c}" for c in DEDUCTION_CAPS]
    )
    score = f"greatest(0, cast(bround(100 - ({' + '.join(DEDUCTION_CAPS)})) as int)) as score"
    grade = " ".join(f"when score >= {least} then '{name}'" for least, name in GRADES)
    return wide.selectExpr("*", score).selectExpr(
        *p.table.groups, "score", f"case {grade} end as grade", *DEDUCTION_CAPS
    )


def health_score(source, **options) -> DataFrame:
    """(score, grade, and the points each category cost): one row, or one per group."""
    p = Profile.of(source, **options)
    return p.table.present(scored(p), "score", "grade", *DEDUCTION_CAPS)


def score_breakdown(source, **options) -> DataFrame:
    """(category, points): what cost points, the most expensive first."""
    p = Profile.of(source, **options)
    shown = p.table.present(all_points(p).where("points > 0"), "category", "points")
    ascending = [True] * len(p.table.group_cols) + [False, True]
    return shown.orderBy(*p.table.group_cols, "points", "category", ascending=ascending)


# What a rule reports beside the names: a SQL text over the facts.
_VALUES = {
    "missingness": f"cast({PERCENTAGE} as string)",
    "skewed": f"cast({SKEWNESS} as string)",
    "duplicate_columns": "cast(null as string)",
    "correlated": "cast(strength as string)",
}


def found(p: Profile, outlier_method: str) -> DataFrame:
    """(groups, slot_a, slot_b, rule_no, rule, severity, column_a, column_b, value, message)."""
    p.gather()
    known = _VALUES | {"outliers": f"cast(outliers_{outlier_method} as string)"}
    flags = {rule: hit for rule, (_, hit) in p.flags.items()}
    flags |= {"outliers": f"outliers_{outlier_method} > 0", "skewed": f"{flags['shaped']} and {flags['skewed']}"}

    def hit(number: int, rule: str, severity: str, sentence: str) -> str:
        names = [f"column_{x}" for x in ("ab" if rule in ("duplicate_columns", "correlated") else "a")]
        value = known.get(rule, "cast(null as string)")
        words = [*names, *([value] if sentence.count("%s") > len(names) else [])]
        if rule == "outliers":
            words.append(quoted(outlier_method.upper()))
        message = f"format_string({quoted(sentence)}, {', '.join(words)})"
        return (
            f"struct({number} as rule_no, {quoted(rule)} as rule, {quoted(severity)} as severity, "
            f"{value} as value, {message} as message)"
        )

    rules = [(n, *rule) for n, rule in enumerate(FINDING_RULES, start=1)]
    of_pairs = {n: r for n, *r in rules if r[0] in ("duplicate_columns", "correlated")}
    of_columns = [
        f"if(coalesce({flags[rule]}, false), {hit(n, rule, severity, sentence)}, null)"
        for n, rule, severity, sentence in rules if n not in of_pairs
    ]
    groups = p.table.groups
    named = p.facts(*dict.fromkeys((*FACTS_SHOWN, *p.mixed_facts)), f"outliers_{outlier_method}").selectExpr(
        "*", "slot as slot_a", "cast(null as int) as slot_b",
        f"{p.table.names()} as column_a", "cast(null as string) as column_b",
    )
    shown = [*groups, "slot_a", "slot_b", "column_a", "column_b"]
    parts = [named.selectExpr(*shown, f"inline(filter(array({', '.join(of_columns)}), f -> f is not null))")]
    for n, rule in of_pairs.items():
        pairs = p.equal_pairs() if rule[0] == "duplicate_columns" else correlated(p)
        both = pairs.selectExpr("*", *[f"{p.table.names(f'slot_{x}')} as column_{x}" for x in "ab"])
        parts.append(both.selectExpr(*shown, f"inline(array({hit(n, *rule)}))"))
    return p.union(parts)


FACTS_SHOWN = (
    "rows", "missing", "filled", "uniques", "top", "integral", "low", "high", "low_whole", "high_whole",
    "dates", "variant_types", "negatives", "skew",
)


def findings(source, outlier_method: str = "mad", **options) -> DataFrame:
    """(rule_no, rule, severity, column_a, column_b, value, message), in report order."""
    p = Profile.of(source, **options)
    if outlier_method not in ("iqr", "mad"):
        raise ValueError("outlier_method is 'iqr' or 'mad'")
    ordered = found(p, outlier_method).orderBy(*p.table.groups, "rule_no", "slot_a", "slot_b")
    return p.table.present(ordered, "rule_no", "rule", "severity", "column_a", "column_b", "value", "message")


# check -> facts or bases it needs; constant columns: those of their detector
CHECKS: dict[str, tuple[str, ...]] = {
    "missing_percentage": ("missing", "rows"),
    "outliers_iqr": ("outliers_iqr",),
    "outliers_mad": ("outliers_mad",),
    "outlier_columns": ("outliers_mad",),
    "constant_columns": (),
    "rows": (),
    "duplicate_rows": ("duplicates",),
    "score": (),
}


def measures(p: Profile, checks: Iterable[str] = tuple(CHECKS)) -> DataFrame:
    """(groups, check, actual): the figures a gate can test, from only the bases behind them."""
    groups, checks = p.table.groups, [c for c in CHECKS if c in set(checks)]
    if "score" in checks:
        all_points(p)
    of_columns = {
        "missing_percentage": f"max({PERCENTAGE})",
        "outliers_iqr": "sum(outliers_iqr)",
        "outliers_mad": "sum(outliers_mad)",
        "outlier_columns": "count_if(outliers_mad > 0)",
        "constant_columns": f"count_if({p.flags['constant'][1]})",
    }
    of_columns = {c: sql for c, sql in of_columns.items() if c in checks}

    def listed(figures: Iterable[str]) -> str:
        rows = ", ".join(
            f"struct('{check}' as check, coalesce(cast({check} as double), 0D) as actual)" for check in figures
        )
        return f"inline(array({rows}))"

    needs = dict.fromkeys(n for c in checks for n in (p.flags["constant"][0] if c == "constant_columns" else CHECKS[c]))
    if needs:
        p.gather(*needs)
    parts = []
    if of_columns:
        facts = p.facts(*[n for n in needs if n != "duplicates"])
        columns = aggregate(facts, groups, [f"{sql} as {check}" for check, sql in of_columns.items()])
        parts.append(columns.selectExpr(*groups, listed(of_columns)))
    if "duplicate_rows" in checks:
        counted = p.duplicates().selectExpr(*groups, "rows", "duplicates as duplicate_rows")
        parts.append(counted.selectExpr(*groups, listed(c for c in ("rows", "duplicate_rows") if c in checks)))
    elif "rows" in checks:
        parts.append(aggregate(p.table.df, groups, ["count(1) as rows"]).selectExpr(*groups, listed(["rows"])))
    if "score" in checks:
        parts.append(scored(p).selectExpr(*groups, listed(["score"])))
    return p.union(parts) if parts else p.table.empty("check string, actual double")


def quality_gate(source, limits: dict[str, tuple[str, float]] | DataFrame, **options) -> DataFrame:
    """(check, actual, bound, limit, passed): measures against limits.

    ``limits`` maps a check to ("max" or "min", limit), or is a table (check, bound, limit). A check
    that does not exist is an error in the first case, and fails with no actual value in the second.
    """
    p = Profile.of(source, **options)
    if isinstance(limits, dict):
        unknown = sorted(set(limits) - set(CHECKS))
        if unknown:
            raise ValueError(f"no such check: {', '.join(unknown)}")
        rows = [(check, bound, float(limit)) for check, (bound, limit) in limits.items()]
        limits, checks = p.table.spark.createDataFrame(rows, "check string, bound string, limit double"), list(limits)
    else:
        checks = [r["check"] for r in limits.where(F.col("check").isin(*CHECKS)).select("check").distinct().collect()]
    tested = measures(p, checks).join(limits, "check", "right")
    passed = "coalesce(if(bound = 'min', actual >= limit, actual <= limit), false) as passed"
    return p.table.present(tested, "check", "actual", "bound", "limit", passed)
