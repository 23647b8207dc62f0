"""Keys and content hashes as column functions: formulas, prototypes, timestamps, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The chemical symbols in order of atomic number.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


def formula_parts(formula: Column | str) -> Column:
    """KEY1: array of (element, count) in the order written; a missing count is 1."""
    symbols = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)(\\d*)"), F.lit(1))
    counts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)(\\d*)"), F.lit(2))
    return F.zip_with(symbols, counts, lambda s, n: F.struct(s.alias("element"), F.when(n == "", 1).otherwise(n.cast("int")).alias("count")))


def element_set(formula: Column | str) -> Column:
    """KEY3: the distinct elements, sorted, joined by '-'."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(formula_parts(formula), lambda p: p["element"]))), "-")


def reduced_formula(formula: Column | str) -> Column:
    """KEY2: counts by element, divided by their common divisor, sorted, as ``A:1,B:2``; 'unknown' if nothing parses."""
    parts = formula_parts(formula)
    names = F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["element"])))
    sums = F.transform(names, lambda e: F.aggregate(parts, F.lit(0), lambda s, p: s + F.when(p["element"] == e, p["count"]).otherwise(0)))
    gcd = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.array_min(sums))), lambda d: F.forall(sums, lambda n: n % d == 0)))
    text = F.array_join(F.zip_with(names, sums, lambda e, n: F.concat(e, F.lit(":"), (n / gcd).cast("int").cast("string"))), ",")
    return F.when(F.size(parts) > 0, text).otherwise("unknown")


def prototype_key(prototype: Column | str, pearson: Column | str, group: Column | str, sites: Column | str) -> Column:
    """KEY4: the named prototype, else Pearson symbol, space group and number of sites."""
    own = F.nullif(F.trim(prototype), F.lit(""))
    proxy = F.concat_ws("|", F.coalesce(F.nullif(F.trim(pearson), F.lit("")), F.lit("unknown")), F.concat(F.lit("sg"), F.coalesce(F.col(group).cast("string"), F.lit("?"))), F.concat(F.lit("n"), F.coalesce(F.col(sites).cast("string"), F.lit("?"))))
    return F.coalesce(own, proxy)


def catalog_of(url: Column | str) -> Column:
    """KEY5: the path part that ends in _WEB or _RAW; null without one."""
    return F.get(F.filter(F.split(url, "[/:]"), lambda p: p.endswith("_WEB") | p.endswith("_RAW")), F.lit(0))


def source_protocol(source: Column, catalog: Column, functionals: Column) -> Column:
    """KEY6: source, catalog and sorted functionals joined by '|'; missing parts read unknown."""
    name = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    return F.concat_ws("|", name(source), name(catalog), name(F.array_join(F.array_sort(functionals), "+")))


def valid_elements(species: Column) -> Column:
    """KEY7: the list if every symbol is an element, else an empty list."""
    known = F.array(*[F.lit(e) for e in ELEMENTS])
    return F.when(F.forall(species, lambda s: F.array_contains(known, s)), species).otherwise(F.array().cast("array<string>"))


def provider_time(text: Column | str) -> Column:
    """KEY8: ``YYYYMMDD_HH:MM:SS_GMT-4`` (or with minutes, ``+5:30``) as UTC; null if malformed."""
    shape = r"^(\d{8}_\d{2}:\d{2}:\d{2})_GMT([+-])(\d{1,2})(?::(\d{2}))?$"
    part = lambda i: F.regexp_extract(text, shape, i)
    seconds = (F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)) * 60 + F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))) * 60
    local = F.try_to_timestamp(F.nullif(part(1), F.lit("")), F.lit("yyyyMMdd_HH:mm:ss"))
    return F.timestamp_seconds(F.unix_seconds(local) - F.when(part(2) == "-", -seconds).otherwise(seconds))


def provider_id(auid: Column | str) -> Column:
    """KEY9: material id of a provider id ``aflow:`` and 16 hex digits; null for any other form."""
    return F.when(F.col(auid).rlike("^aflow:[0-9a-f]{16}$"), F.concat(F.lit("aflow-"), F.substring(auid, 7, 16)))


def semantic_hash(columns: list[str], exclude: tuple[str, ...] = ()) -> Column:
    """KEY10: SHA-256 of the row as JSON with sorted keys; null fields and provenance fields don't count."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in columns if c not in exclude))), 256)


def rounded_hash(values: Column, digits: int) -> Column:
    """KEY12: SHA-256 of an array of numbers rounded to ``digits``."""
    return F.sha2(F.to_json(F.struct(F.transform(values, lambda x: F.round(x, digits)).alias("v"))), 256)


def block_digest(rows: DataFrame, by: str, block: Column, order: str, text: str) -> DataFrame:
    """KEY15: one digest a group: rows in order are digested in blocks, and the blocks' digests in theirs, so no row list is unbounded."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), ";")
    parts = rows.groupBy(by, block.alias("__block")).agg(F.sha2(listed, 256).alias("__d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__block", "__d"))), lambda x: x["__d"]), ";")
    return parts.groupBy(by).agg(F.sha2(whole, 256).alias("digest"))


def candidate_id(prefix: str, identity: Column, digits: int = 24) -> Column:
    """KEY13: prefix and the first hex digits of the identity's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(identity, 256), 1, digits))


def csv_safe(value: Column | str) -> Column:
    """SNK3: text that a spreadsheet could read as a formula gets an apostrophe before it."""
    value = F.col(value) if isinstance(value, str) else value
    risky = value.rlike(r"^[\s\p{Cc}\p{Cf}]*[=+\-@]") | value.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def is_missing(value: Column) -> Column:
    """FLT8: null, blank, or a word for unknown."""
    return value.isNull() | F.lower(F.trim(value)).isin("", "none", "null", "nan", "n/a", "unknown")


def lenient_float(value: Column, default: float | None = None) -> Column:
    """FLT3: a number, else the default; not-a-number counts as missing."""
    got = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(got), got), F.lit(default).cast("double"))


def lenient_bool(value: Column, default: bool | None = None) -> Column:
    """FLT3: true, 1, yes or false, 0, no in any case; else the default."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False).otherwise(F.lit(default).cast("boolean"))
