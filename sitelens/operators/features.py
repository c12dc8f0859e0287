"""Tabular feature families: rules, fitted statistics, projections.

A family is a list of ``Rule``s, one per column. Fitting is one aggregate (or,
for a large table, a sliced ranking) that ends in a one-row statistics table.
Transforming is a projection of the data joined with that one row, so train and
test go through the same expressions and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import scalars as S
from sitelens.operators.clean import InvalidInput
from sitelens.operators.metrics import ranking_metrics
from sitelens.operators.aggregates import close_relative
from sitelens.operators.ordered import is_small, quantiles
from sitelens.operators.rank_tests import fisher_test, rank_sum_test, two_by_two
from sitelens.operators.ranking import top_per_group

# Column prefixes of the families, tried in this order.
FAMILY_PREFIXES = {
    "charge": "SEQ_Charge_",
    "hotspot": "SEQ_Hotspot_",
    "zscale": "SEQ_ZScale_",
    "sequence": "SEQ_",
    "kinase": "FUNC_Kinase_",
    "alphamissense": "FUNC_AlphaMissense_",
    "evolution": "FUNC_Evolution_",
    "nls": "MOTIF_NLS_",
    "nes": "MOTIF_NES_",
    "motif1433": "MOTIF_1433_",
    "idr": "MOTIF_IDR_",
    "domain": "MOTIF_Domain_",
    "structure": "STRUCT_",
}
# Physical ranges by a word in the column name, first match counts.
STRUCTURE_RANGES = (
    (("plddt",), (0.0, 100.0)),
    (("rsa", "ratio", "fraction", "flag"), (0.0, 1.0)),
    (("sin", "cos"), (-1.0, 1.0)),
    (("count", "asa", "hse", "length"), (0.0, None)),
)
# Fills of structure columns that were never observed.
STRUCTURE_DEFAULTS = ((("plddt",), 50.0), (("rsa",), 0.5), (("ss3", "ratio"), 1.0 / 3.0))
LARGE_FILLS = ("p99_plus_1", "max_plus_1", "p95_times_2")


@dataclass(frozen=True)
class Rule:
    """How one feature column is read, filled and reshaped.

    ``fill``: median, mean, zero, constant or large. ``fit_gate``: the statistic
    uses only rows where this flag is 1. ``gate``: rows where this flag is not 1
    get ``gate_value`` (or the fill when that is None). ``clip_first`` bounds the
    raw value before it is counted; ``low``/``high`` bound the filled value, and a
    filled value below 0 becomes ``negative`` where that is set.
    """

    column: str
    aliases: tuple[str, ...] = ()
    flag: bool = False
    fill: str = "median"
    constant: float = 0.0
    large: str = "p99_plus_1"
    default: float = 0.0
    fit_gate: str | None = None
    gate: str | None = None
    gate_value: float | None = 0.0
    clip_first: bool = False
    log_first: bool = False
    low: float | None = None
    high: float | None = None
    negative: float | None = None
    log: str | None = None
    missing_flag: bool = False
    missing_suffix: str = "_missing"
    has_flag: bool = False
    wide_flags: bool = False

    @property
    def needs_statistic(self) -> bool:
        return self.fill in ("median", "mean", "large")


def _raw(df: DataFrame, rule: Rule) -> Column:
    """Value of a rule's column as read: first alias present, typed, bounded or logged when asked."""
    present = [c for c in (rule.column, *rule.aliases) if c in df.columns]
    if not present:
        return F.lit(None).cast("double")
    if rule.flag:
        return F.coalesce(S.text_flag(present[0], rule.wide_flags), F.lit(0.0))
    value = S.number(present[0])
    if rule.clip_first:
        value = S.clip(value, rule.low, rule.high)
    if rule.log_first:
        value = _logged(value, rule.log)
    return value


def _logged(value: Column, how: str | None) -> Column:
    if how == "log1p":
        return F.log1p(S.clip(value, 0.0))
    if how == "signed":
        return S.signed_log(value)
    return value


def _gate(df: DataFrame, name: str | None, wide: bool) -> Column | None:
    if name is None or name not in df.columns:
        return None
    return F.coalesce(S.text_flag(name, wide), F.lit(0.0)) == 1.0


def _fit_value(df: DataFrame, rule: Rule) -> Column:
    gate = _gate(df, rule.fit_gate, rule.wide_flags)
    value = _raw(df, rule)
    return F.when(gate, value) if gate is not None else value


def _share(rule: Rule) -> float | None:
    if rule.fill == "median":
        return 0.5
    if rule.fill == "large":
        return {"p99_plus_1": 0.99, "p95_times_2": 0.95, "max_plus_1": None}[rule.large]
    return None


def fit_fills(train: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row with ``fill__<column>`` for every rule that needs a statistic.

    Small tables use one aggregate. On large ones the exact quantiles come from
    a sliced ranking of the unpivoted columns, since the whole table is one group.
    """
    wanted = [r for r in rules if r.needs_statistic]
    if not wanted:
        return train.sparkSession.range(1).select(F.lit(0).alias("fill__none"))
    values = train.select(*[_fit_value(train, r).alias(r.column) for r in wanted])
    ranked = [r for r in wanted if _share(r) is not None]
    plain = [r for r in wanted if _share(r) is None]
    aggs = [(F.avg if r.fill == "mean" else F.max)(r.column).alias(r.column) for r in plain]
    if is_small(train):
        aggs += [F.percentile(r.column, _share(r)).alias(r.column) for r in ranked]
        row = values.agg(*aggs)
    else:
        row = values.agg(*aggs) if aggs else None
        for share in sorted({_share(r) for r in ranked}):
            names = [r.column for r in ranked if _share(r) == share]
            long = values.select(*names).unpivot([], names, "feature", "value")
            found = quantiles(long, ["feature"], "value", {"q": share})
            wide = found.agg(*[F.max(F.when(F.col("feature") == n, F.col("q"))).alias(n) for n in names])
            row = wide if row is None else row.crossJoin(F.broadcast(wide))
    return row.select(*[_finish_fill(r).alias("fill__" + r.column) for r in wanted])


def _finish_fill(rule: Rule) -> Column:
    value = F.col(rule.column)
    if rule.fill == "large":
        value = value * 2.0 if rule.large == "p95_times_2" else value + 1.0
        return F.coalesce(value, F.lit(1.0))
    return F.coalesce(S.clip(value, rule.low, rule.high) if rule.clip_first else value, F.lit(float(rule.default)))


def transform(df: DataFrame, rules: Sequence[Rule], fills: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Apply fitted rules: the ``keep`` columns and one output column per rule, plus asked-for flags."""
    joined = df.crossJoin(F.broadcast(fills))
    out = []
    for r in rules:
        raw = _raw(df, r)
        if r.needs_statistic:
            fill = F.col("fill__" + r.column)
        else:
            fill = F.lit(float(r.constant if r.fill == "constant" else 0.0))
        value = F.coalesce(raw, fill)
        gate = _gate(df, r.gate, r.wide_flags)
        if gate is not None:
            outside = fill if r.gate_value is None else F.lit(float(r.gate_value))
            value = F.when(gate, value).otherwise(outside)
        bounded = S.clip(value, r.low, r.high)
        value = bounded if r.negative is None else F.when(value < 0, F.lit(float(r.negative))).otherwise(bounded)
        if not r.log_first:
            value = _logged(value, r.log)
        if r.has_flag:
            out.append(raw.isNotNull().cast("double").alias(r.column + "__has"))
        out.append(value.alias(r.column))
        if r.missing_flag:
            out.append(raw.isNull().cast("double").alias(r.column + r.missing_suffix))
    return joined.select(*keep, *out)


def fit_transform(train: DataFrame, test: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    fills = fit_fills(train, rules)
    return transform(train, rules, fills, keep), transform(test, rules, fills, keep)


# -------------------------------------------------------------- family rules


def family_of(column: str) -> str | None:
    for family, prefix in FAMILY_PREFIXES.items():
        if column.startswith(prefix):
            return family
    return None


def route(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns of each family by prefix, more special prefixes first."""
    out: dict[str, list[str]] = {}
    for c in columns:
        family = family_of(c)
        if family:
            out.setdefault(family, []).append(c)
    return out


def check_family(columns: Sequence[str], family: str, key: str = "INDEX") -> None:
    """A column outside the family's prefix is an error."""
    prefix = FAMILY_PREFIXES[family]
    bad = [c for c in columns if c != key and not c.startswith(prefix)]
    if bad:
        raise InvalidInput(f"columns outside {prefix}: {bad}")


def complete_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected columns in order, absent ones as NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in expected])


def _has(name: str, *words: str) -> bool:
    low = name.lower()
    return any(w in low for w in words)


def segment_rules(columns: Sequence[str], prefix: str, family: str, direction: bool, missing: bool = False) -> list[Rule]:
    """Rules of a segment family (domain, signal, motif, disorder).

    Flags are 0/1. Distances of rows without a segment take a value larger than
    the observed ones, then a logarithm. Inside-only columns have fixed values
    outside. The two pipelines differ:

    * candidate: every distance is cut at zero; disorder scores take the median;
      nuclear-signal values count inside a segment only, and a missing inside
      position is 0 there.
    * direction: a signed distance takes the median of the rows with a segment
      (disorder: 0; nuclear import: the large value), is 0 without one and keeps
      its sign in the logarithm. Fractions are in [0, 1], lengths, counts and boundaries not below 0,
      inside positions in [0, 1] or -1.
    """
    has_name = {"idr": "HasRegion_Flag", "motif1433": "HasMotif_Flag"}.get(family, "HasSegment_Flag")
    has = prefix + has_name if prefix + has_name in columns else None
    inside = prefix + "Inside_Flag" if prefix + "Inside_Flag" in columns else None
    suffix = "__missing" if direction and family in ("nes", "domain", "motif1433") else "_missing"
    least = 0.0 if direction else None

    def rule(c: str) -> Rule:
        tail = c[len(prefix):]
        common = {"missing_flag": missing and not c.endswith("_Flag"), "missing_suffix": suffix, "wide_flags": direction}
        if tail.endswith("_Flag"):
            return Rule(c, flag=True, fill="zero", **common)
        if tail == "Inside_RelativePosition":
            if direction:
                return Rule(c, fill="constant", constant=-1.0, gate=inside, gate_value=-1.0, low=0.0, high=1.0, negative=-1.0, **common)
            return Rule(c, fill="constant", constant=0.0 if family == "nls" else -1.0, gate=inside, gate_value=-1.0, **common)
        if tail.startswith("Inside_"):
            return Rule(c, fill="zero", gate=inside, low=least, **common)
        if family == "idr" and _has(tail, "site_disorder", "window"):
            high = 1.0 if direction and _has(tail, "fraction") else None
            return Rule(c, low=least, high=high, **common)
        if family == "idr" and _has(tail, "disorder", "score"):
            if direction:
                return Rule(c, fit_gate=has, gate=has, low=0.0, **common)
            return Rule(c, **common)
        if direction and _has(tail, "nearest_start", "nearest_end"):
            return Rule(c, fit_gate=has, gate=has, low=0.0, **common)
        if direction and "SignedDistance" in tail and family != "nls":
            fill = {"fill": "zero"} if family == "idr" else {"fill": "median", "fit_gate": has}
            return Rule(c, gate=has, log="signed", **fill, **common)
        if tail.startswith("Nearest_") and not _has(tail, "score", "class"):
            signed = direction and "SignedDistance" in tail
            return Rule(c, fill="large", fit_gate=has, gate=has, gate_value=None, log="signed" if signed else "log1p",
                        low=None if signed else 0.0, **common)
        if family == "nls" and not direction:
            return Rule(c, fill="zero", gate=inside, **common)
        if _has(tail, "score"):
            fill = "median" if family == "motif1433" or (direction and family != "domain") else "zero"
            high = 1.0 if direction and family == "motif1433" else None
            return Rule(c, fill=fill, fit_gate=has, gate=has, low=least, high=high, **common)
        gated = family == "motif1433" or (direction and family in ("nls", "domain", "idr"))
        high = 1.0 if direction and _has(tail, "fraction") else None
        return Rule(c, fill="zero", gate=has if gated else None, low=least, high=high, **common)

    return [rule(c) for c in columns]


def structure_range(column: str) -> tuple[float | None, float | None]:
    for words, limits in STRUCTURE_RANGES:
        if _has(column, *words):
            return limits
    return (None, None)


def structure_rules(columns: Sequence[str], clamp_fill: bool = False, missing: bool = False) -> list[Rule]:
    """Physical bounds by column name; flags fill with 0, confidences and angles with the mean, others with the median."""
    rules = []
    for c in columns:
        low, high = structure_range(c)
        fill = "zero" if _has(c, "flag") else "mean" if _has(c, "plddt", "sin", "cos") else "median"
        default = 0.0
        if clamp_fill:
            for words, value in STRUCTURE_DEFAULTS:
                if all(w in c.lower() for w in words):
                    default = value
                    break
        rules.append(Rule(c, fill=fill, default=default, clip_first=True, low=low, high=high, missing_flag=missing))
    return rules


def family_rules(
    family: str, columns: Sequence[str], variant: str = "candidate", fill: str = "median", log: bool = True, missing: bool = False,
    ratio_high: float | None = 20.0, log_ratios: bool = False,
) -> list[Rule]:
    """Rules of a family's columns. ``variant`` is ``candidate`` or ``direction``: the two pipelines differ
    in bounds, logarithms and flags. ``ratio_high`` and ``log_ratios`` shape sequence ratios of the
    direction variant."""
    direction = variant == "direction"
    columns = list(columns)
    if family in ("nls", "nes", "domain", "idr", "motif1433"):
        prefix = FAMILY_PREFIXES[family]
        if family == "domain":
            rules = []
            for group in sorted({c[len(prefix):].split("_")[0] for c in columns}):
                own = [c for c in columns if c.startswith(prefix + group + "_")]
                rules += segment_rules(own, prefix + group + "_", family, direction, missing)
            return rules
        return segment_rules(columns, prefix, family, direction, missing)
    if family == "structure":
        return structure_rules(columns, clamp_fill=direction, missing=missing)
    rules = []
    for c in columns:
        if family == "sequence":
            if _has(c, "ratio_"):
                if direction:
                    rules.append(Rule(c, fill="zero", low=0.0, high=ratio_high, log="log1p" if log_ratios else None, missing_flag=missing))
                else:
                    rules.append(Rule(c, fill="zero", missing_flag=missing))
            elif _has(c, "hydropathy") and direction:
                rules.append(Rule(c, clip_first=True, low=-4.5, high=4.5, missing_flag=missing))
            elif _has(c, "fraction") and direction:
                rules.append(Rule(c, clip_first=True, low=0.0, high=1.0, missing_flag=missing))
            elif _has(c, "count") and direction:
                rules.append(Rule(c, clip_first=True, low=0.0, missing_flag=missing))
            else:
                rules.append(Rule(c, missing_flag=missing))
        elif family == "charge":
            bounded = _has(c, "fraction", "ratio")
            rules.append(Rule(c, fill=fill, clip_first=direction, low=0.0 if bounded else None,
                              high=1.0 if bounded else None, missing_flag=missing))
        elif family == "zscale":
            if direction:
                rules.append(Rule(c, fill=fill, clip_first=True, low=0.0 if _has(c, "std") else None, missing_flag=missing))
            else:
                rules.append(Rule(c, fill="zero"))
        elif family == "hotspot":
            if _has(c, "dist") and log:
                how = "signed" if direction and _has(c, "signed") else "log1p"
                rules.append(Rule(c, log=how, log_first=True, missing_flag=missing))
            elif direction and _has(c, "fraction"):
                rules.append(Rule(c, clip_first=True, low=0.0, high=1.0, missing_flag=missing))
            elif direction and _has(c, "count"):
                rules.append(Rule(c, clip_first=True, low=0.0, missing_flag=missing))
            else:
                rules.append(Rule(c, missing_flag=missing))
        elif family == "kinase":
            bounded = direction and _has(c, "prob")
            rules.append(Rule(c, fill=fill if direction else "zero", has_flag=True, low=0.0 if direction and _has(c, "count", "prob") else None,
                              high=1.0 if bounded else None, missing_flag=missing))
        elif family in ("evolution", "alphamissense"):
            if _has(c, "flag", "__has", "isavailable"):
                rules.append(Rule(c, flag=True, fill="zero", wide_flags=direction))
            else:
                bounded = direction and _has(c, "score", "proportion", "fraction", "prob")
                rules.append(Rule(c, fill=fill, clip_first=bounded, low=0.0 if bounded else None,
                                  high=1.0 if bounded else None, has_flag=direction, missing_flag=missing))
        else:
            rules.append(Rule(c, fill=fill, missing_flag=missing))
    if direction and family in ("charge", "evolution", "kinase", "sequence", "zscale"):
        rules = [replace(r, missing_suffix="__missing") for r in rules]
    return rules


def with_aliases(rules: Sequence[Rule], aliases: Mapping[str, Sequence[str]]) -> list[Rule]:
    """Other names under which a column may be delivered."""
    return [replace(r, aliases=tuple(aliases.get(r.column, ()))) for r in rules]


def class_levels(df: DataFrame, column: str, gate: str | None = None, top_k: int | None = None, other: str = "OTHER") -> list[str]:
    """Levels of a class column by falling count; with ``top_k`` the rest is ``other``.

    The levels name output columns, so this short list is the one thing read to the driver.
    """
    value = F.coalesce(S.clean_text(column), F.lit(other))
    if gate:
        value = F.when(F.coalesce(S.text_flag(gate), F.lit(0.0)) == 1.0, value).otherwise(F.lit(other))
    counts = df.groupBy(value.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level")
    if top_k:
        counts = counts.where(F.col("level") != other).limit(top_k)
    levels = [r["level"] for r in counts.collect()]
    return levels + [other] if top_k else levels


def one_hot_class(
    df: DataFrame, column: str, levels: Sequence[str], prefix: str, gate: str | None = None, other: str = "OTHER"
) -> DataFrame:
    """0/1 columns of the fitted levels with unique safe names; unseen levels count as ``other``."""
    value = F.coalesce(S.clean_text(column), F.lit(other))
    if gate:
        value = F.when(F.coalesce(S.text_flag(gate), F.lit(0.0)) == 1.0, value).otherwise(F.lit(other))
    value = F.when(value.isin(*levels), value).otherwise(F.lit(other))
    used: set[str] = set()
    out = df.withColumn("_level", value)
    for level in levels:
        name = "".join(ch if ch.isalnum() else "_" for ch in level).strip("_") or "NA"
        unique, n = name, 2
        while unique in used:
            unique, n = f"{name}_{n}", n + 1
        used.add(unique)
        out = out.withColumn(prefix + unique, (F.col("_level") == level).cast("int"))
    return out.drop("_level", column)


def normalize_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shares bounded to [0, 1] and divided by their sum where that is positive."""
    bounded = [S.clip(c, 0.0, 1.0) for c in columns]
    total = sum(bounded[1:], bounded[0])
    return df.withColumns({c: F.when(total > 0, b / total).otherwise(b) for c, b in zip(columns, bounded)})


def resolve_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """When several flags of a group are on, only the first highest stays on."""
    bounded = [S.clip(c, 0.0, 1.0) for c in columns]
    total = sum(bounded[1:], bounded[0])
    values = F.array(*bounded)
    first = F.array_position(values, F.array_max(values))
    return df.withColumns(
        {
            c: F.when(total > 1.0, (first == i + 1).cast("double")).otherwise(b)
            for i, (c, b) in enumerate(zip(columns, bounded))
        }
    )


def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether any of the columns was observed, and the share that was not."""
    missing = [F.col(c).isNull().cast("double") for c in columns]
    share = sum(missing[1:], missing[0]) / len(columns)
    return df.withColumn("missing_fraction", share).withColumn("has_any_observed", (share < 1).cast("double"))


# ------------------------------------------------------- assembly and choice


def fit_scaling(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations."""
    return train.agg(
        *[F.avg(c).alias("mean__" + c) for c in columns], *[F.stddev_pop(c).alias("std__" + c) for c in columns]
    )


def standardize(df: DataFrame, columns: Sequence[str], scaling: DataFrame) -> DataFrame:
    """Columns with mean 0 and population deviation 1; constant columns become 0."""
    joined = df.crossJoin(F.broadcast(scaling))
    scaled = {
        c: (F.col(c) - F.col("mean__" + c)) / F.when(F.col("std__" + c) > 0, F.col("std__" + c)).otherwise(F.lit(1.0))
        for c in columns
    }
    return joined.withColumns(scaled).drop(*["mean__" + c for c in columns], *["std__" + c for c in columns])


def assemble(
    train: DataFrame, test: DataFrame, key: str, variant: str = "candidate", max_missing: float | None = None, scale: bool = False
) -> tuple[DataFrame, DataFrame, list[str]]:
    """All families of a table, fitted on train and applied to both; same columns on both sides.

    Columns of train above the missing limit are dropped; columns that test
    lacks are filled as missing.
    """
    columns = [c for c in train.columns if c != key and family_of(c)]
    if max_missing is not None:
        row = train.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
        columns = [c for c in columns if row[c] is None or row[c] <= max_missing]
    rules = [r for family, own in route(columns).items() for r in family_rules(family, own, variant)]
    a, b = fit_transform(train, complete_columns(test, [key, *columns]), rules, [key])
    names = [c for c in a.columns if c != key]
    if scale:
        scaling = fit_scaling(a, names)
        a, b = standardize(a, names, scaling), standardize(b, names, scaling)
    return a, b, names


def assert_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing or infinite values in the matrix are an error raised by the job."""
    def checked(c: str) -> Column:
        return F.when(S.number(c).isNull(), F.raise_error(F.lit(f"missing or infinite value in {c}")).cast("double")).otherwise(F.col(c).cast("double"))

    return df.withColumns({c: checked(c) for c in columns})


def _long(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    typed = df.select(label, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot([label], list(columns), "feature", "value")


def top_features_by_auroc(df: DataFrame, label: str, columns: Sequence[str], k: int = 40) -> DataFrame:
    """The k features whose value alone ranks the classes best, in either direction."""
    scored = ranking_metrics(_long(df, label, columns), ["feature"], "value", label)
    strength = F.greatest(F.col("auroc"), 1 - F.col("auroc"))
    ranked = scored.where(F.col("auroc").isNotNull()).withColumn("strength", F.round(strength, 12))
    return top_per_group(ranked.select("feature", "strength"), [], [F.desc("strength"), F.asc("feature")], k)


def features_by_rank_test(df: DataFrame, label: str, columns: Sequence[str], below: float = 0.05, min_n: int = 3) -> DataFrame:
    """Features whose rank test between the classes has p below the limit."""
    long = _long(df.withColumn(label, F.col(label).cast("string")), label, columns)
    tested = rank_sum_test(long, ["feature"], label, "value", "1", "0", min_n=min_n)
    return tested.where(F.col("p_value") < below).select("feature", "u", "p_value")


def choose_features(df: DataFrame, label: str, columns: Sequence[str], below: float | None, k: int | None) -> list[str]:
    """Feature names that pass the p filter and then the AUROC filter; a list as long as the schema."""
    names = list(columns)
    if below is not None:
        names = [r["feature"] for r in features_by_rank_test(df, label, names, below).collect()]
    if k is not None and names:
        names = [r["feature"] for r in top_features_by_auroc(df, label, names, k).collect()]
    return [c for c in columns if c in set(names)]


def feature_records(long: DataFrame, feature: str, group: str, value: str, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per feature: whether it is binary, and for each named pair of arms the two-sided p-value.

    Binary features get Fisher's exact test, others the rank-sum test; a pair
    with an empty arm has no p-value. Every row meets only the pairs its arm is in.
    """
    sides = [
        F.when(F.col(group) == one, F.struct(F.lit(name).alias("pair"), F.lit("a").alias("side"))).when(
            F.col(group) == other, F.struct(F.lit(name).alias("pair"), F.lit("b").alias("side"))
        )
        for name, (one, other) in pairs.items()
    ]
    kinds = long.groupBy(feature).agg(F.bool_and(F.col(value).isin(0.0, 1.0)).alias("is_binary"))
    rows = long.select(feature, value, F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("_at")).select(feature, value, "_at.*")
    keys = [feature, "pair"]
    ranks = rank_sum_test(rows, keys, "side", value, "a", "b").select(*keys, F.col("p_value").alias("_rank"))
    exact = fisher_test(two_by_two(rows, keys, F.col(value) == 1, F.col("side") == "a")).select(*keys, "a", "b", "c", "d", F.col("p_value").alias("_exact"))
    both = kinds.join(exact.join(ranks, keys, "full"), feature)
    full = (F.col("a") + F.col("c") > 0) & (F.col("b") + F.col("d") > 0)
    p = F.when(F.col("is_binary"), F.when(full, F.col("_exact"))).otherwise(F.col("_rank"))
    return both.groupBy(feature, "is_binary").agg(*[F.max(F.when(F.col("pair") == name, p)).alias(f"{name}_p") for name in pairs])


def panel_choice(rank_tests: DataFrame, exact_tests: DataFrame, statistics: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Features for a panel: known differs from background and new is close to known; else all reasons, joined.

    ``rank_tests`` and ``exact_tests`` have (feature, p_value); the exact test counts
    for binary features, the rank test for others. ``statistics`` is a table of arm
    statistics. A feature without a test is not significant.
    """
    tests = rank_tests.select("feature", F.col("p_value").alias("_rank")).join(
        exact_tests.select("feature", F.col("p_value").alias("_exact")), "feature", "full"
    )
    joined = statistics.join(tests, "feature", "left")
    joined = joined.withColumn("p_value", F.when(F.col("is_binary"), F.col("_exact")).otherwise(F.col("_rank"))).drop("_rank", "_exact")
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    close = close_relative("stat_known", "stat_new", "stat_background")
    # The reasons.
    reasons = F.concat_ws(
        ";",
        F.when(~significant, "known_functional_vs_neg_not_significant"),
        F.when(~close, "known_new_not_close"),
    )
    return (
        joined.withColumn("is_significant", significant)
        .withColumn("is_close", close)
        .withColumn("skip_reason", F.nullif(reasons, F.lit("")))
        .withColumn("selected", significant & close)
    )
