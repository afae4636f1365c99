"""One table under measurement, with the bases its operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame

from ..constants import NONNEGATIVE_KEYWORDS, Thresholds
from ..functions.expressions import PERCENTAGE, finite_sql, not_nan_sql, target_name_sql, id_name_sql
from . import pairs, rows, stats, values
from .order_stats import block_index, median_distance, order_statistics, range_index, write_ranges
from .sketches import approximate_distinct, approximate_order_statistics, undecided_sql
from .staging import Staging
from .stats import aggregate
from .table import TEXT, VARIANT, Field, Table, quoted

QUARTILES = (0.25, 0.5, 0.75)

# Which base a column of the facts comes from; all others are measures of ``stats``.
_FROM = {
    "uniques": "uniques", "top": "uniques",
    "dates": "text", **{f"n_{c}": "text" for c in values.LEXICAL_CLASSES},
    "outliers_iqr": "iqr", "whisker_low": "iqr", "whisker_high": "iqr",
    "q1": "quartiles", "median": "quartiles", "q3": "quartiles",
    "outliers_mad": "mad",
    "varied": "varied",
}
_ZERO_WITHOUT_VALUES = ("uniques", "top", "outliers_iqr", "outliers_mad", "dates")
# With the distinct values known, nothing else has to tell which columns vary.
FACTS = [n for n in (*stats.MEASURES, *_FROM) if n not in ("differs", "varied")]
PAIRS = ("duplicates", "correlations", "equal_pairs")


class Profile:
    """The table, its groups and thresholds, and its shared bases.

    An operator on a plain DataFrame makes its own profile and computes only what it needs. To run
    many operators on one table, make one profile, ``gather()`` it, and pass it to all of them:
    every base is then computed once. ``close()`` removes the tables it wrote.

    ``mixed`` says which columns are of mixed type: "typed" looks at the types of variant values only,
    "lexical" also at what the values of a text column spell (numbers, truth values, dates, other text).
    """

    def __init__(
        self,
        df: DataFrame,
        *,
        group_cols: Sequence[str] = (),
        columns: Sequence[str] | None = None,
        mode: str = "exact",
        mixed: str = "typed",
        thresholds: Thresholds | None = None,
    ):
        if mode not in ("exact", "approx"):
            raise ValueError("mode is 'exact' or 'approx'")
        if mixed not in ("typed", "lexical"):
            raise ValueError("mixed is 'typed' or 'lexical'")
        self.mode, self.mixed = mode, mixed
        self.thresholds = thresholds or Thresholds()
        self.table = Table(df, group_cols, columns)
        self.staging = Staging(df.sparkSession)
        self.gathered = False  # bases that are asked for are computed once
        self.complete = False  # all of them are there
        self._known: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, source: DataFrame | Profile, **options) -> Profile:
        return source if isinstance(source, Profile) else cls(source, **options)

    def __enter__(self) -> Profile:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        self.staging.close()
        self._known.clear()
        self.gathered = self.complete = False

    @property
    def keys(self) -> list[str]:
        return [*self.table.groups, "slot"]

    def _pin(self, df: DataFrame, name: str) -> DataFrame:
        return self.staging.pin(df, name, bounded=not self.table.groups)

    def _pinned(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._pin(build(), name)
        return self._known[name]

    def _pin_again(self, df: DataFrame, name: str) -> DataFrame:
        """Pinned under a name of its own, for what may be asked for several times."""
        return self._pin(df, f"{name}-{uuid.uuid4().hex}")

    def small(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A small base: computed once while gathering, else a part of the plan that asks for it."""
        return self._pinned(name, build) if self.gathered or name in self._known else build()

    # Numeric values -----------------------------------------------------------------------

    def cells(self) -> DataFrame:
        """(groups, slot, whole, value, cnt = 1): numeric cells as they are."""
        return values.numeric_cells(self.table, self.table.numeric).selectExpr("*", "cast(1 as bigint) as cnt")

    def value_counts(self) -> DataFrame:
        """(groups, slot, value, cnt) of the numeric columns, sorted in ranges and written."""
        if self.mode == "approx":
            return self.cells()
        if "ranges" not in self._known:
            # Two integers beyond 2^53 may have the same double: they stay two rows, as two values.
            counted = values.numeric_values(self.table, self.table.numeric).drop("whole")
            self._known["ranges"] = write_ranges(self.table, counted, "value", self.staging, "ranges")
        return self._known["ranges"]

    def index(self) -> DataFrame:
        """(groups, slot, block, part, inside, low, high) of the sorted values, written."""
        if "index" not in self._known:
            self._known["index"] = self.staging.write(block_index(self.table, self.value_counts(), "value"), "index")
        return self._known["index"]

    def _pin_local(self, df: DataFrame) -> DataFrame:
        """Without groups, what the ranges and a few of their blocks bound is computed once; with groups it is a plan."""
        return df if self.table.groups else self.staging.pin(df, "", bounded=True)

    def parts(self) -> DataFrame:
        """(groups, slot, part, inside, low, high) of the ranges."""
        if "parts" not in self._known:
            self._known["parts"] = self._pin_local(range_index(self.table, self.index()))
        return self._known["parts"]

    def _quantiles(self, shares: Sequence[float]) -> DataFrame:
        if self.mode == "approx":
            return approximate_order_statistics(self.table, self.value_counts(), "value", shares)
        return order_statistics(
            self.table, self.value_counts(), self.index(), self.parts(), "value", shares, self._pin_local
        )

    def medians(self) -> DataFrame:
        """(groups, slot, n, median): from the quartiles where they are known."""
        if "quartiles" in self._known:
            return self._known["quartiles"].select(*self.keys, "n", "median")
        return self._pinned("medians", lambda: self._quantiles((0.5,)).selectExpr(*self.keys, "n", "at_0 as median"))

    def quartiles(self) -> DataFrame:
        """(groups, slot, n, q1, median, q3, lower, upper)."""

        def build() -> DataFrame:
            found = self._quantiles(QUARTILES)
            reach = f"{self.thresholds.iqr_multiplier}D * (at_2 - at_0)"
            return found.selectExpr(
                *self.keys, "n", "at_0 as q1", "at_1 as median", "at_2 as q3",
                f"{not_nan_sql(f'at_0 - {reach}')} as lower", f"{not_nan_sql(f'at_2 + {reach}')} as upper",
            )

        return self.small("quartiles", build)

    def deviations(self) -> DataFrame:
        """(groups, slot, median, mad): the median and the median distance from it."""

        def build() -> DataFrame:
            centre = self.medians()
            if self.mode == "approx":
                apart = self.table.attach(self.value_counts(), centre, "slot").selectExpr(
                    *self.keys, "cnt", f"{not_nan_sql('abs(value - median)')} as distance"
                ).where("distance is not null")
                found = approximate_order_statistics(self.table, apart, "distance", (0.5,)).selectExpr(*self.keys, "at_0 as mad")
            else:
                found = median_distance(
                    self.table, self.value_counts(), self.index(), self.parts(), "value", centre, self._pin_local
                )
            return self.table.attach(centre.select(*self.keys, "median"), found, "slot", how="left")

        return self.small("deviations", build)

    def outside_fences(self) -> DataFrame:
        """(groups, slot, outliers_iqr, whisker_low, whisker_high) of columns that have values."""

        def build() -> DataFrame:
            placed = self.table.attach(self.value_counts(), self.quartiles(), "slot")
            near = "value >= lower and value <= upper"
            return aggregate(placed, self.keys, [
                "sum(if(value < lower or value > upper, cnt, 0)) as outliers_iqr",
                f"coalesce(min(if({near}, value, null)), min(value)) as whisker_low",
                f"coalesce(max(if({near}, value, null)), max(value)) as whisker_high",
            ])

        return self.small("iqr", build)

    def far_from_median(self) -> DataFrame:
        """(groups, slot, outliers_mad) of columns that have values."""

        def build() -> DataFrame:
            t = self.thresholds
            scored = self.table.attach(self.value_counts(), self.deviations(), "slot")
            z = not_nan_sql(f"abs(try_divide({t.mad_z_constant}D * (value - median), mad))")
            return aggregate(scored, self.keys, [f"sum(if({z} > {t.mad_outlier}D, cnt, 0)) as outliers_mad"])

        return self.small("mad", build)

    # Other bases --------------------------------------------------------------------------

    def text(self, fields: list[Field] | None = None) -> DataFrame:
        """(groups, slot, uniques, top, dates, n_integer, ...) of the text columns; ``approx``: without the first two."""
        build = values.lexical_stats if self.mode == "exact" else values.lexical_scan
        return self.small("text", lambda: build(self.table, self.table.textual))

    def _estimated(self, fields: list[Field]) -> DataFrame:
        """(groups, slot, uniques, top) from sketches; columns near a detector's line are counted exactly."""
        t = self.thresholds
        sketched = self._pin_local(approximate_distinct(self.table, fields))
        undecided = sketched.where(undecided_sql(t.high_cardinality, t.min_unique, t.near_constant))
        # The driver reads one number per column.
        slots = {r["slot"] for r in undecided.select("slot").distinct().collect()}
        chosen = [f for f in fields if f.slot in slots]
        estimates = sketched.where("filled > 0").select(*self.keys, "uniques", "top")
        if not chosen:
            return estimates
        kept = estimates.where(f"not {self.table.among(chosen)}")
        return kept.unionByName(values.distinct_stats(self.table, chosen).select(*kept.columns))

    def uniques(self, fields: list[Field]) -> DataFrame:
        """(groups, slot, uniques, top) of columns that have values."""
        if self.mode == "approx":
            return self._pinned("uniques", lambda: self._estimated(self.table.fields)) if self.gathered else self._estimated(fields)
        if not self.gathered:
            return values.distinct_stats(self.table, fields)

        def build() -> DataFrame:
            # The frequencies of the numeric columns, and perhaps of the texts, are known already.
            rest = [f for f in self.table.fields if not self.complete or f.kind != TEXT]
            counted = values.distinct_stats(self.table, rest, self.value_counts())
            return counted.unionByName(self.text().select(*counted.columns)) if self.complete else counted

        return self._pinned("uniques", build)

    def varied(self, fields: list[Field]) -> DataFrame:
        """(groups, slot, varied): whether a column holds two values, without counting its distinct ones.

        Only columns whose hashes all agree in some group are counted; the driver reads which.
        """

        def build() -> DataFrame:
            measures = ("filled", "differs")
            told = self._measured(measures) if self.gathered else self._pin_again(
                stats.column_stats(self.table, measures, fields), "differs"
            )
            hashed = [f for f in fields if not f.ordered]
            open_slots = told.where(f"filled > 0 and not differs and {self.table.among(hashed)}").select("slot").distinct()
            slots = {r["slot"] for r in open_slots.collect()} if hashed else set()
            chosen = [f for f in hashed if f.slot in slots]
            known = told.where(f"not {self.table.among(chosen)}").selectExpr(*self.keys, "differs as varied")
            if not chosen:
                return known
            return known.unionByName(
                values.distinct_stats(self.table, chosen).selectExpr(*self.keys, "uniques > 1 as varied")
            )

        return self.small("varied", build)

    def correlations(self) -> DataFrame:
        """(groups, slot_a, slot_b, value) for pairs of numeric columns."""
        return self.small("correlations", lambda: pairs.correlations(self.table, self._pin))

    def equal_pairs(self) -> DataFrame:
        """(groups, slot_a, slot_b) of identical columns."""
        return self.small("equal_pairs", lambda: pairs.equal_pairs(self.table))

    def duplicates(self) -> DataFrame:
        """(groups, rows, duplicates)."""
        return self.small("duplicates", lambda: rows.duplicate_rows(self.table, self._pin_again))

    # Facts: a row per group and column ----------------------------------------------------

    def facts(self, *names: str, fields: list[Field] | None = None) -> DataFrame:
        """(groups, slot, names...): every column (of ``fields``) of every group has a row.

        Only the bases behind the asked names are computed.
        """
        chosen = self.table.fields if fields is None else fields
        if not self.gathered:
            return self._facts(names, chosen)
        if self.complete:
            known = self._pinned("facts", lambda: self._facts(FACTS, self.table.fields))
        else:
            known = self._facts(names, self.table.fields)
        return (known if fields is None else known.where(self.table.among(chosen))).select(*self.keys, *names)

    def _measured(self, measures: Sequence[str]) -> DataFrame:
        """The measures of all columns, computed once; more of them take another scan of the columns."""
        known = self._known.get("stats")
        if known is None or not set(measures) <= set(known.columns):
            wanted = [m for m in stats.MEASURES if m in measures or known is not None and m in known.columns]
            self._known.pop("stats", None)
            name = "stats" if known is None else f"stats{len(wanted)}"
            self._known["stats"] = self._pin(stats.column_stats(self.table, wanted), name)
        return self._known["stats"]

    def _facts(self, names: Sequence[str], fields: list[Field]) -> DataFrame:
        measures = [n for n in names if n not in _FROM]
        if self.gathered:
            made = self._measured(measures or ["rows"])
        else:
            made = stats.column_stats(self.table, measures or ["rows"], fields)
        bases = {
            "uniques": lambda: self.uniques(fields), "text": self.text, "iqr": self.outside_fences,
            "quartiles": self.quartiles, "mad": self.far_from_median, "varied": lambda: self.varied(fields),
        }
        for base in dict.fromkeys(_FROM[n] for n in names if n in _FROM):
            wanted = [n for n in names if _FROM.get(n) == base]
            made = self.table.attach(made, bases[base]().select(*self.keys, *wanted), "slot", how="left")
        made = made.fillna(0, [n for n in names if n in _ZERO_WITHOUT_VALUES])
        return made.select(*self.keys, *dict.fromkeys(names))

    @property
    def mixed_facts(self) -> tuple[str, ...]:
        return ("variant_types", *LEXICAL_COUNTS) if self.mixed == "lexical" else ("variant_types",)

    # What the detectors say of a row of facts, in SQL, with the facts each one needs.

    @property
    def flags(self) -> dict[str, tuple[tuple[str, ...], str]]:
        t, table = self.thresholds, self.table
        name = table.names()
        whole_range = "cast(high_whole as decimal(38,0)) - cast(low_whole as decimal(38,0)) + 1"
        # All values integral, all distinct, and as many as the range is long.
        gapless = (
            "coalesce(integral and uniques = filled and "
            f"if(low_whole is not null, {whole_range} = filled, high - low + 1 = filled), false)"
        )
        unique = f"uniques / nullif(rows, 0) >= {t.high_cardinality}D and uniques >= {t.min_unique}"
        by_kind = f"({id_name_sql(name)} or not {table.among(table.numeric)} or {gapless})"
        quantity = " or ".join(f"contains(lower({name}), {quoted(k)})" for k in NONNEGATIVE_KEYWORDS)
        run = ("filled", "uniques", "integral", "low", "high", "low_whole", "high_whole")
        variants = [f for f in table.fields if f.kind == VARIANT]
        mixed = f"{table.among(variants)} and variant_types > 1"
        if self.mixed == "lexical":
            mixed = f"{mixed} or {table.among(table.textual)} and {SPELLED} > 1"
        return {
            "missingness": (("missing", "rows"), f"{PERCENTAGE} > {t.missing_percentage}D"),
            # Sketches and a whole profile know the distinct values.
            "constant": (("uniques",), "uniques <= 1") if self.complete or self.mode == "approx"
            else (("varied",), "not coalesce(varied, false)"),
            "near_constant": (("uniques", "top", "filled"), f"uniques > 1 and top / filled >= {t.near_constant}D"),
            "possible_target": (("rows",), target_name_sql(name)),
            "gapless": (run, gapless),
            "id_like": ((*run, "rows"), f"({unique}) and {by_kind}"),
            "date_like": (("dates", "filled"), f"dates / nullif(filled, 0) >= {t.date_ratio}D"),
            "mixed_type": (self.mixed_facts, mixed),
            "negative": (("negatives",), f"negatives > 0 and ({quantity})"),
            "skewed": (("filled", "low", "high", "skew"), f"abs({SKEWNESS}) > {t.skewness}D"),
            "shaped": (("filled",), f"filled >= 3 and {table.among(table.numeric)}"),
        }

    def flagged(self, flag: str, *names: str, fields: list[Field] | None = None) -> DataFrame:
        """The facts of the columns a detector hits."""
        needs, hit = self.flags[flag]
        return self.facts(*dict.fromkeys((*needs, *names)), fields=fields).where(hit)

    # Gathering ----------------------------------------------------------------------------

    def gather(self, *names: str) -> Profile:
        """Compute the bases behind the named facts and bases once, or all of them.

        The operators then only combine small tables. The bases do not depend on each other, but for those
        that stand on the sorted values, so their jobs are submitted together and share the executors.
        """
        if self.complete:
            return self
        self.gathered, self.complete = True, not names
        names = names or (*FACTS, "quartiles", *PAIRS)
        needs = {_FROM.get(n, n) for n in names}
        measures = [n for n in names if n in stats.MEASURES]
        if "varied" in needs:
            measures += ["filled", "differs"]
        sorted_values = needs & {"quartiles", "iqr", "mad"}

        def numeric(pool: ThreadPoolExecutor) -> list[Future]:
            if needs & {"quartiles", "iqr"}:
                self.quartiles()
            wanted = {"iqr": self.outside_fences, "mad": self.far_from_median}
            return [pool.submit(build) for base, build in wanted.items() if base in needs]

        with ThreadPoolExecutor(8) as pool:
            pairs_and_rows = {"duplicates": self.duplicates, "correlations": self.correlations, "equal_pairs": self.equal_pairs}
            running = [pool.submit(build) for base, build in pairs_and_rows.items() if base in needs]
            if measures:
                measured = pool.submit(self._measured, measures)
                running.append(measured)
            text = [pool.submit(self.text)] if "text" in needs else []
            if self.table.numeric and (sorted_values or "uniques" in needs):
                self.value_counts()
            for done in text:
                done.result()
            # These stand on the two frequency tables.
            if "uniques" in needs:
                running.append(pool.submit(self.uniques, self.table.fields))
            if "varied" in needs:
                measured.result()
                running.append(pool.submit(self.varied, self.table.fields))
            if self.table.numeric and sorted_values:
                running += numeric(pool)
            for done in running:
                done.result()
        if self.complete:
            self.facts()
        return self

    def union(self, parts: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)


# How many classes the values of a text column spell: integers and decimals are both numbers.
LEXICAL_COUNTS = tuple(f"n_{c}" for c in values.LEXICAL_CLASSES)
SPELLED = "size(filter(array(n_integer + n_decimal, n_boolean, n_date, n_text), n -> n > 0))"

# Bias-corrected sample skewness and excess kurtosis from the population moments, three decimals.
# A column of one value has a shape of 0, and three values have no kurtosis.
SKEWNESS = "round({}, 3)".format(
    finite_sql("if(low = high, 0D, skew * try_divide(sqrt(double(filled) * (filled - 1)), filled - 2))")
)
KURTOSIS = "round({}, 3)".format(
    finite_sql(
        "case when filled < 4 then null when low = high then 0D else "
        "try_divide(filled - 1, double(filled - 2) * (filled - 3)) * ((filled + 1) * kurt + 6) end"
    )
)
