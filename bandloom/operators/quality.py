"""Row quality: filters, bucket labels and rule classifiers. Unknown stays unknown; every refusal has a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Name of the first check that is true; null if none is."""
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in checks])


def all_reasons(*checks: tuple[Column, str]) -> Column:
    """Names of all checks that are true, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())


def candidates(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """FLT1: rows whose values lie in all ranges, ends included; a null value passes."""
    for c, (lo, hi) in ranges.items():
        rows = rows.filter(F.col(c).isNull() | F.col(c).between(lo, hi))
    return rows


def classify(hard: list[tuple[Column, str]], soft: list[tuple[Column, str]]) -> tuple[Column, Column]:
    """FLT4: status and reasons: the first hard check makes a row invalid, any soft one ambiguous."""
    bad, odd = first_reason(*hard), all_reasons(*soft)
    status = F.when(bad.isNotNull(), "invalid").when(F.size(odd) > 0, "ambiguous").otherwise("verified_valid")
    return status, F.when(bad.isNotNull(), F.array(bad)).otherwise(odd)


def worst_status(statuses: list[Column]) -> Column:
    """FLT7: the worst of invalid, read_error, ambiguous, valid."""
    rank = lambda c: F.when(c == "invalid", 3).when(c == "read_error", 2).when(c == "ambiguous", 1).otherwise(0)
    return F.element_at(F.array(F.lit("valid"), F.lit("ambiguous"), F.lit("read_error"), F.lit("invalid")), (F.greatest(*[rank(s) for s in statuses], F.lit(0)) + 1))


def skip_reason(energies: Column, group: Column, gap: Column, envelope: Column, crossing: Column) -> Column:
    """FLT6: why a record can't be used; null if it can."""
    return first_reason((energies.isNull(), "no energies"), (group.isNull(), "no space group"), (gap.isNull(), "no gap"), (~envelope, "no envelope"), (~crossing & (gap < -0.05), "negative gap"))


def route_error(message: Column) -> Column:
    """FLT12: whether a fetch error means that there is no data, or that it may be tried again."""
    low = F.lower(message)
    none = low.contains("line-mode") | low.contains("uniform") | low.contains("no band") | low.contains("band data unavailable")
    return F.when(message.isNull(), "ok").when(none, "no_data").otherwise("failed")


def group_band(number: Column) -> Column:
    """FLT13: bucket of a space-group number."""
    return F.when(number.between(1, 74), "1-74").when(number.between(75, 167), "75-167").when(number.between(168, 230), "168-230").otherwise("unknown")


def sites_band(sites: Column) -> Column:
    """FLT13: bucket of a number of sites."""
    return F.when(sites.isin(1, 2, 3), sites.cast("string")).when(sites >= 4, "4+").otherwise("unknown")


def line_topology(crosses: Column, top: Column, bottom: Column) -> Column:
    """FLT14: 0 where a band crosses the level, 1 where both extrema share their place, 2 where they don't; -1 unknown."""
    return F.when(crosses, 0).when(top.isNull() | bottom.isNull(), -1).when(top == bottom, 1).otherwise(2)


def disagreement(line: Column, provider: Column) -> Column:
    """FLT14: 1 where both types are known and differ, 0 where they agree, -1 where the provider's is unknown."""
    return F.when(provider.isNull() | (provider < 0), -1).otherwise((line != provider).cast("int"))


def material_class(gap: Column) -> Column:
    """FLT17: class by gap; null for an unknown one."""
    return F.when(gap <= 0.05, "metal").when(gap <= 0.5, "narrow").when(gap <= 3.0, "semiconductor").when(gap > 3.0, "insulator")


def legacy_type(gap: Column, top: Column, bottom: Column) -> Column:
    """FLT16: 0 below a gap of 0.01 (strictly), else 1 for equal places of the extrema, 2 for others."""
    return F.when(gap < 0.01, 0).when(top == bottom, 1).otherwise(2)


def ledger(rows: DataFrame, *by: Column) -> DataFrame:
    """AG41, AG45: rows by status and whatever else they are counted by."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def vector_contract(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """FLT31: first broken rule of each row of a vector table, as ``problem``."""
    problem = first_reason((F.exists(vector, lambda x: x.isNull() | F.isnan(x)), "not finite"), (F.size(vector) != dim, "wrong length"))
    return rows.withColumn("problem", problem)


def recommendations(rules: list[tuple[str, Column, Column]], default: str, otherwise: Column | float = 0.5) -> Column:
    """FLT18: array of (rule, confidence clamped to 0..1) of all rules that hold; the default rule if none does."""
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), w)).alias("confidence"))) for n, c, w in rules]), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.struct(F.lit(default).alias("rule"), (otherwise if isinstance(otherwise, Column) else F.lit(otherwise)).alias("confidence"))))


def alignment(v1: Column, c1: Column, v2: Column, c2: Column) -> Column:
    """FLT19: type of a band alignment: I nested, II staggered, III broken."""
    nested = ((v1 >= v2) & (c1 <= c2)) | ((v2 >= v1) & (c2 <= c1))
    return F.when((c1 < v2) | (c2 < v1), "III").when(nested, "I").otherwise("II")


def peak_override(kind: Column, distance: Column, size: int, metal: Column) -> Column:
    """FLT20: direct where the peaks are within max(3, 3.5% of the grid), unless a metal is at least even odds."""
    return F.when((metal < 0.5) & (distance <= max(3, round(0.035 * size))), "direct").otherwise(kind)


def traffic_light(score: Column, green: float = 0.6, amber: float = 0.35) -> Column:
    """FLT21: level of a score."""
    return F.when(score >= green, "green").when(score >= amber, "amber").when(score.isNotNull(), "red")


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """FLT21: weighted mean of parts clamped to 0..1."""
    total = sum(w for _, w in parts)
    return sum((F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) * w for c, w in parts), F.lit(0.0)) / total


def odd_characters(rows: DataFrame, key: str, text: str) -> DataFrame:
    """FLT22: counts of control, replacement and private-use characters of each text, by code point."""
    found = rows.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"([\x00-\x08\x0b\x0c\x0e-\x1f�\p{Co}])"), F.lit(1))).alias("c"))
    return found.groupBy(key, F.format_string("U+%04X", F.ascii("c")).alias("code")).agg(F.count("*").alias("n"))


def token_flags(token: Column, score: Column) -> Column:
    """FLT22: reasons to look at a read token again; the token itself is never changed."""
    return all_reasons((token.rlike("[O0]"), "O or 0"), (token.rlike("[Il|]"), "I or l or |"), (token.rlike("^[0-9]+$"), "digits only"), (score < 0.5, "low score"))


def resolve_species(explicit: Column, species: Column, sites: Column) -> tuple[Column, Column]:
    """FLT28: species of every atom and how they are known: explicit, a single one repeated, in order (unverified), or ambiguous."""
    label = F.when(explicit.isNotNull() & (F.size(explicit) == sites), "explicit").when(F.size(species) == 1, "single").when(F.size(species) == sites, "unverified order").otherwise("ambiguous")
    value = F.when(label == "explicit", explicit).when(label == "single", F.array_repeat(F.get(species, F.lit(0)), sites)).when(label == "unverified order", species)
    return value, label


def axis_fit(ticks: DataFrame, by: str) -> DataFrame:
    """FLT25: least-squares line through axis anchors; refused with fewer than two, a non-monotone axis, or a large residual."""
    o = Window.partitionBy(by).orderBy("pixel")
    rows = ticks.withColumn("step", F.signum(F.col("value") - F.lag("value").over(o)))
    fit = rows.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope("value", "pixel").alias("slope"), F.regr_intercept("value", "pixel").alias("intercept"), F.min("step").alias("a"), F.max("step").alias("b"))
    worst = ticks.join(fit, by).groupBy(by).agg(F.max(F.abs(F.col("value") - F.col("slope") * F.col("pixel") - F.col("intercept"))).alias("residual"))
    got = fit.join(worst, by, "left")
    status = F.when(F.col("n") < 2, "too few").when((F.col("a") != F.col("b")) | (F.col("a") == 0), "not monotone").when(F.col("residual") > F.greatest(F.lit(1e-6), F.abs("slope") / 2), "residual").otherwise("ok")
    return got.select(by, "n", "slope", "intercept", "residual", status.alias("status"))


def field_audit(rows: DataFrame, rules: dict[str, list[tuple[Column, str, str]]]) -> DataFrame:
    """FLT7: per field a status (first rule that holds, else valid), and the worst of them as the record's."""
    marks = {k: F.coalesce(*[F.when(c, F.lit(s)) for c, s, _ in r], F.lit("valid")) for k, r in rules.items()}
    return rows.select("*", *[v.alias(f"{k}_status") for k, v in marks.items()], worst_status(list(marks.values())).alias("record_status"))
