"""Column functions: masks, recodes, codes, classes. All are built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that stand for a missing answer, beside -1 to -5.
MISSING_CODES = [88, 98, 888888, 988888, 999999]
#: Cuts between the levels -3, -2, -1, 1, 2, 3 of a trait score.
LEVEL_CUTS = [-0.66, -0.33, 0.0, 0.33, 0.66]


def mask_missing(value: Column, mode: str = "negative") -> Column:
    """value, or null where it is a missing code. mode: negative, minus1_5, or miss_set (minus1_5 and MISSING_CODES)."""
    whole = value.isin([-1, -2, -3, -4, -5])
    gone = {"negative": value < 0, "minus1_5": whole, "miss_set": whole | value.isin(MISSING_CODES)}[mode]
    return F.when(~gone, value)


def finite(value: Column) -> Column:
    """value as a double, or null where it is NaN or infinite."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_weight(weight: Column) -> Column:
    """A weight that is finite and above 0, else null."""
    x = finite(weight)
    return F.when(x > 0, x)


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def canonical_code(value: Column) -> Column:
    """Whole numbers without a point, others in short form; a number that isn't finite is an error."""
    whole = F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return F.when(value.isNull(), F.lit(None).cast("string")).when(finite(value).isNull(), F.raise_error(F.lit("code is not finite")).cast("string")).otherwise(whole)


def split_field(field: Column, mark: str = ";") -> Column:
    """The trimmed, non-empty parts of a delimited field; null gives no parts."""
    parts = F.filter(F.transform(F.split(field, mark), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def align_labels(codes: Column, labels: Column) -> Column:
    """One label for each code: extra labels go, missing ones and "nan" are the code itself."""

    def label(code: Column, i: Column) -> Column:
        found = F.try_element_at(labels, (i + 1).cast("int"))
        return F.when(found.isNull() | (F.lower(found) == "nan"), code).otherwise(found)

    return F.transform(codes, label)


def recode(value: Column, kind: Column) -> Column:
    """Polarity by kind: invert4 is 5 - v, invert10 is 11 - v, binary is 1 for v = 1 and else 0; otherwise v."""
    return F.when(kind == "invert4", 5 - value).when(kind == "invert10", 11 - value).when(kind == "binary", F.when(value.isNull(), None).otherwise((value == 1).cast("double"))).otherwise(value)


def recode_mean(mean: Column, kind: Column, rule: str = "equal") -> Column:
    """Polarity applied to a mean. Binary items: rule equal is 1 where the mean is 1, threshold where it is under 1.5."""
    hit = (mean == 1) if rule == "equal" else (mean < 1.5)
    return F.when(kind == "binary", hit.cast("double")).otherwise(recode(mean, kind))


def scale_class(response_type: Column, options: Column, ordered: Column) -> Column:
    """Class of an item's scale from its type, number of options and order."""
    return (
        F.when(options > 12, "other_numeric")
        .when(response_type == "multi5", "multiple_response_max5")
        .when(options == 2, "binary_yn")
        .when(ordered, F.concat(F.lit("ordered_"), options.cast("string"), F.lit("pt")))
        .otherwise(F.concat(F.lit("single_choice_"), options.cast("string")))
    )


def scale_family(scale: Column) -> Column:
    return F.when(scale == "binary_yn", "binary").when(scale == "multiple_response_max5", "multi_select").when(scale == "other_numeric", "other").otherwise("ordered")


#: Other names of units.
ALIASES = {"US": "USA", "MEXICO": "MEX", "UK": "GBR"}


def unit_name(policy: Column) -> Column:
    """The unit of a policy called <unit>_adapter, in capitals and without aliases; other names in capitals."""
    bare = F.regexp_extract(policy, r"^([A-Za-z0-9]+)_adapter$", 1)
    name = F.upper(F.when(bare != "", bare).otherwise(policy))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))[name], name)


def relationship(policy: Column, unit: Column) -> Column:
    return F.when(policy == "base", "base").when(unit_name(policy) == unit, "matched").otherwise("cross")


def magnitude(z: Column) -> Column:
    """near_zero, or moderate or strong with its direction."""
    side = F.when(z >= 0, "positive").otherwise("negative")
    return F.when(F.abs(z) < 0.10, F.lit("near_zero")).when(F.abs(z) < 0.40, F.concat(F.lit("moderate_"), side)).otherwise(F.concat(F.lit("strong_"), side))


def near_zero(z: Column) -> Column:
    return F.abs(z) < 0.10


def trait_level(score: Column) -> Column:
    a, b, c, d, e = LEVEL_CUTS
    return F.when(score < a, -3).when(score < b, -2).when(score < c, -1).when(score < d, 1).when(score < e, 2).when(score.isNotNull(), 3)


def rounded_level(score: Column) -> Column:
    """Three times the score, rounded half to even."""
    return F.bround(score * 3).cast("int")


def contamination_class(ratio: Column) -> Column:
    return F.when(ratio.isNull(), F.lit(None).cast("string")).when(ratio < 0.3, "low").when(ratio < 0.7, "medium").otherwise("high")


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def wilson(share: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share's Wilson interval."""
    middle = (share + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def content_key(*parts: Column, size: int = 12) -> Column:
    """The first digits of the parts' SHA-1, parts joined by line ends."""
    return F.substring(F.sha1(F.concat_ws("\n", *parts).cast("binary")), 1, size)


def even_allocation(total: Column, index: Column, buckets: Column) -> Column:
    """What the bucket with this index (from 0) gets of a total that is dealt evenly, the rest to the first."""
    return F.floor(total / buckets) + (index < total % buckets).cast("int")


def repaired_json(raw: Column) -> Column:
    """The outermost object of a raw answer: code fences and text around it go, and so do commas before a closing bracket."""
    bare = F.regexp_replace(raw, r"```(?:json)?", "")
    return F.regexp_replace(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), r",(\s*[}\]])", "$1")


def option_lines(codes: Column, labels: Column) -> Column:
    """`code: label` lines of an item."""
    return F.array_join(F.zip_with(codes, labels, lambda c, x: F.concat(c, F.lit(": "), x)), "\n")


def starts_with_context(prompt: Column) -> Column:
    """A trimmed prompt that begins with `Context:`; another case of the word is mended."""
    bare = F.trim(prompt)
    return F.when(bare.startswith("Context:"), bare).when(F.lower(bare).startswith("context:"), F.concat(F.lit("Context:"), F.substring(bare, F.lit(9), F.length(bare)))).otherwise(F.concat(F.lit("Context: "), bare))


def hash_int(*parts: Column) -> Column:
    """A whole number from 0 to 2**32 - 1 from the parts' MD5: a random draw that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def guarded_corr(x: str, y: str, least: int = 3) -> Column:
    """Aggregate: Pearson correlation over rows where both are there; null with fewer than `least` rows or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double")
    n = F.count(F.when(both, F.lit(1)))
    va, vb = F.coalesce(F.var_pop(a), F.lit(0.0)), F.coalesce(F.var_pop(b), F.lit(0.0))
    spread = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when((n >= least) & spread, F.try_divide(F.covar_pop(a, b), F.sqrt(va * vb)))


Expression = Callable[[Column], Column]
