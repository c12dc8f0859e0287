"""Scalar column functions: safe casts, site keys, text rules, labels.

Everything here is a composition of built-in Spark functions and stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
STAR_CUTS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
STAR_CUTS_4 = ((0.0001, "****"), (0.001, "***"), (0.01, "**"), (0.05, "*"))
PHOSPHO_RESIDUES = ("S", "T", "Y")
DIRECTION_LABELS = {
    "promote_import": "Nuclear Import",
    "inhibit_export": "Nuclear Import",
    "promote_export": "Nuclear Export",
    "inhibit_import": "Nuclear Export",
    "Nuclear Import": "Nuclear Import",
    "Nuclear Export": "Nuclear Export",
}
IMPORT_TERMS = (
    "promote_import",
    "promote_nuclear_import",
    "inhibit_export",
    "inhibit_nuclear_export",
    "nuclear_import",
)
EXPORT_TERMS = (
    "promote_export",
    "promote_nuclear_export",
    "inhibit_import",
    "inhibit_nuclear_import",
    "nuclear_export",
)
TRUE_WORDS = ("true", "1")
FALSE_WORDS = ("false", "0")
TRUE_WORDS_WIDE = ("true", "1", "yes", "y")
FALSE_WORDS_WIDE = ("false", "0", "no", "n")
# -----------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Text or number to double; bad text, NaN and infinities become NULL."""
    value = col(c).try_cast("double")
    return F.when(
        F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None).cast("double")
    ).otherwise(value)


def whole_number(c: str | Column) -> Column:
    """Text or number to bigint, through double so that ``'12.0'`` is 12."""
    return number(c).try_cast("bigint")


def clean_text(c: str | Column) -> Column:
    return F.trim(col(c).cast("string"))


def name_key(c: str | Column) -> Column:
    """Upper-cased, trimmed join key for names."""
    return F.upper(clean_text(c))


def site_key(acc: str | Column, pos: str | Column) -> Column:
    """``ACC_POS`` built from parts that are trimmed first."""
    return F.concat_ws("_", clean_text(acc), clean_text(pos))


def residue_from_key(key: str | Column) -> Column:
    """Residue letter of a key that ends in ``_S123``; NULL when it carries none."""
    return F.upper(F.nullif(F.regexp_extract(col(key), r"_([A-Za-z])\d+$", 1), F.lit("")))


def position_from_key(key: str | Column) -> Column:
    return F.regexp_extract(col(key), r"_[A-Za-z]?(\d+)$", 1).try_cast("bigint")


def canonical_site_key(
    acc: str | Column,
    pos: str | Column,
    residue: str | Column,
    mod: str | Column | None = None,
    key: str | Column | None = None,
) -> Column:
    """``ACC_S12``; the residue comes from its column, else the modification, else the key."""
    candidates = [F.nullif(F.upper(clean_text(residue)), F.lit(""))]
    if mod is not None:
        candidates.append(
            F.nullif(F.upper(F.regexp_extract(clean_text(mod), r"^([A-Za-z])\d+", 1)), F.lit(""))
        )
    if key is not None:
        candidates.append(residue_from_key(key))
    letter = F.coalesce(*candidates, F.lit(""))
    return F.concat(clean_text(acc), F.lit("_"), letter, whole_number(pos).cast("string"))


def identity_key(*parts: str | Column) -> Column:
    """Parts joined by ``_``; the empty string when any part is missing or blank."""
    texts = [F.coalesce(clean_text(p), F.lit("")) for p in parts]
    missing = texts[0] == ""
    for t in texts[1:]:
        missing = missing | (t == "")
    return F.when(missing, F.lit("")).otherwise(F.concat_ws("_", *texts))


def modification_residue(mod: str | Column) -> Column:
    """Residue of a modification text such as ``S123-p`` (any case)."""
    return F.upper(F.nullif(F.regexp_extract(clean_text(mod), r"(?i)^([STY])(\d+)-p$", 1), F.lit("")))


def modification_position(mod: str | Column) -> Column:
    return F.regexp_extract(clean_text(mod), r"(?i)^([STY])(\d+)-p$", 2).try_cast("bigint")


def without_isoform(acc: str | Column) -> Column:
    return F.substring_index(clean_text(acc), "-", 1)


def display_label(name: str | Column, residue: str | Column, pos: str | Column) -> Column:
    return F.concat(clean_text(name), F.lit("_"), F.upper(clean_text(residue)), clean_text(pos))


def without_version(c: str | Column) -> Column:
    """Identifier before its first ``.``."""
    return F.substring_index(clean_text(c), ".", 1)


def map_label(c: str | Column, labels: Mapping[str, str]) -> Column:
    """Lookup in a small fixed map; NULL for labels that are not in it."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.create_map(*pairs)[clean_text(c)]


def direction_from_text(c: str | Column, prefix: str = "Known ") -> Column:
    """Direction by substring rules; rules about import are tried before rules about export."""
    text = F.replace(F.replace(F.lower(clean_text(c)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))

    def has_any(terms: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))

    def plain(word: str) -> Column:
        return (text == word) | F.endswith(text, F.lit("_" + word))

    return (
        F.when(has_any(IMPORT_TERMS), prefix + "Import")
        .when(has_any(EXPORT_TERMS), prefix + "Export")
        .when(plain("import"), prefix + "Import")
        .when(plain("export"), prefix + "Export")
    )


def text_flag(c: str | Column, wide: bool = False) -> Column:
    """Text or number to 1.0/0.0; unknown text is judged by its number being positive."""
    text = F.lower(clean_text(c))
    yes, no = (TRUE_WORDS_WIDE, FALSE_WORDS_WIDE) if wide else (TRUE_WORDS, FALSE_WORDS)
    return (
        F.when(text.isin(*yes), F.lit(1.0))
        .when(text.isin(*no), F.lit(0.0))
        .when(number(text).isNotNull(), (number(text) > 0).cast("double"))
    )


def stars(p: str | Column, cuts=STAR_CUTS, missing: str = "ns") -> Column:
    """Star label of a p-value."""
    p = col(p)
    label = F.when(p.isNull(), F.lit(missing))
    for cut, text in cuts:
        label = label.when(p < cut, F.lit(text))
    return label.otherwise(F.lit("ns"))


def star_rank(p: str | Column, cuts=STAR_CUTS) -> Column:
    """0 for the strongest label, growing towards ``ns`` and missing."""
    p = col(p)
    rank = F.when(p.isNull(), F.lit(len(cuts)))
    for i, (cut, _) in enumerate(cuts):
        rank = rank.when(p < cut, F.lit(i))
    return rank.otherwise(F.lit(len(cuts)))


def expected_sign(direction: str | Column, regulation: str | Column) -> Column:
    """+1 when the target should rise with the site value, -1 when it should fall.

    Import brings a regulator to its targets, so activated targets rise and
    repressed ones fall; export is the mirror image. NULL for other words.
    """
    way, effect = F.lower(col(direction)), F.lower(col(regulation))
    along = F.when(way == "import", 1).when(way == "export", -1)
    return along * F.when(effect == "activate", 1).when(effect == "repress", -1)


def expected_alternative(direction: str | Column, regulation: str | Column) -> Column:
    sign = expected_sign(direction, regulation)
    return F.when(sign > 0, "greater").when(sign < 0, "less").otherwise("two-sided")


def expected_text(direction: str | Column, regulation: str | Column) -> Column:
    sign = expected_sign(direction, regulation)
    return F.when(sign > 0, "High > Low").when(sign < 0, "High < Low").otherwise("High vs Low")


def directional_effect(delta: str | Column, direction: str | Column, regulation: str | Column) -> Column:
    """Change in the expected direction; its size when no direction is expected."""
    sign = expected_sign(direction, regulation)
    return F.when(sign.isNotNull(), col(delta) * sign).otherwise(F.abs(col(delta)))


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; NULL stays NULL."""
    value = col(c)
    out = value
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def signed_log(c: str | Column) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def sigmoid(c: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))


def logit(c: str | Column, eps: float = 1e-6) -> Column:
    p = clip(c, eps, 1.0 - eps)
    return F.log(p / (1.0 - p))


def safe_name(c: str | Column) -> Column:
    """Name fit for a file or column: ``.0`` cut, other runs of symbols become ``_``."""
    text = F.regexp_replace(clean_text(c), r"\.0$", "")
    text = F.regexp_replace(text, r"[^A-Za-z0-9]+", "_")
    text = F.regexp_replace(text, r"^_+|_+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("NA"))


def threshold_tag(c: str | Column) -> Column:
    """``0.75`` -> ``gt0p75``."""
    return F.concat(F.lit("gt"), F.replace(col(c).cast("string"), F.lit("."), F.lit("p")))


def p_text(p: str | Column) -> Column:
    """p-value for display: four decimals, or one-digit scientific below 1e-4."""
    p = col(p)
    exponent = F.floor(F.log10(p))
    digits = F.round(p / F.pow(F.lit(10.0), exponent), 1)
    spill = digits >= 10
    exponent = F.when(spill, exponent + 1).otherwise(exponent)
    digits = F.when(spill, F.lit(1.0)).otherwise(digits)
    science = F.concat(F.format_string("%.1f", digits), F.lit("e-"), F.lpad((-exponent).cast("string"), 2, "0"))
    return (
        F.when(p.isNull(), F.lit("NA"))
        .when(p <= 0, F.lit("0.0e+00"))
        .when(p < 1e-4, science)
        .otherwise(F.format_string("%.4f", p))
    )


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Quotient as double; NULL for a zero or missing divisor."""
    bottom = col(bottom).cast("double")
    return F.when(bottom != 0, col(top).cast("double") / bottom)
