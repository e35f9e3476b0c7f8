"""Scalar expressions on pairs, phases, names, costs and identifiers: Columns in, Columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies of regimes, sizes and strategies.
PHASE_STOP_ATR = {"HV_Trend": 2.5, "LV_Trend": 2.0, "HV_Ranging": 1.5, "LV_Ranging": 1.0}
PHASE_SIZE = {"HV_Trend": 0.5, "LV_Trend": 1.0, "HV_Ranging": 0.5, "LV_Ranging": 0.75}
REGIME_TO_PHASE = {"HVTF": "HV_Trend", "LVTF": "LV_Trend", "HVMR": "HV_Ranging", "LVMR": "LV_Ranging", "HVR": "HV_Ranging", "LVR": "LV_Ranging"}
TRUE_WORDS = ("true", "1", "yes")


def lookup(values: dict, key: Column, default=None) -> Column:
    """The value for a key, from a small fixed map."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def normalised_pair(name: Column) -> Column:
    """`EURUSD`, `eur/usd` and `eur_usd` as `eur-usd`; anything else is NULL."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[/_]", "-"), "-+", "-")
    spread = F.when(dashed.rlike("^[a-z]{6}$"), F.concat_ws("-", F.substring(dashed, 1, 3), F.substring(dashed, 4, 3))).otherwise(dashed)
    return F.when(spread.rlike("^[a-z]{3}-[a-z]{3}$"), spread)


def pair_from_file(file: Column) -> Column:
    """The pair in a file name such as `EURUSD60.csv`."""
    return normalised_pair(F.regexp_replace(F.regexp_extract(file, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1), "[0-9]+$", ""))


def compact_pair(pair: Column) -> Column:
    """`eur-usd` as `EURUSD`."""
    return F.upper(F.replace(pair, F.lit("-"), F.lit("")))


def usd_role(pair: Column) -> Column:
    """Whether USD is the quote, the base, or neither, of a compact pair."""
    up = F.upper(pair)
    return F.when(up.endswith("USD"), "quote").when(up.startswith("USD"), "base").when(up.contains("USD"), "cross").otherwise("none")


def pip_value(pair: Column) -> Column:
    """Size of a pip: 0.01 for yen quotes, else 0.0001."""
    return F.when(F.upper(pair).endswith("JPY"), 0.01).otherwise(0.0001)


def trade_cost(price: Column, pip: Column, spread: float, slippage: float, commission: float, capital: float) -> Column:
    """Cost of one side of a trade as a fraction of its value."""
    return (0.5 * spread + slippage) * pip / price + F.lit(0.5 * commission / capital)


def position_size(capital: float, atr: Column, risk: float, stop_multiple: Column) -> Column:
    """Units that lose `risk` of the capital at a stop so many ATRs away; 0 where the stop has no distance."""
    distance = atr * stop_multiple
    return F.coalesce(F.when(distance > 0, capital * risk / distance), F.lit(0.0))


def overlap_state(pct: Column) -> Column:
    """missing up to 5 percent, active from 95, partial between."""
    return F.when(pct.isNull() | (pct <= 5), "missing").when(pct >= 95, "active").otherwise("partial")


def week_label(day: Column) -> Column:
    """ISO year and week, as 2024-W05."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def safe_float(text: Column) -> Column:
    """A number or NULL; never NaN."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x), x)


def safe_int(text: Column) -> Column:
    """A whole number or NULL, a fraction cut off."""
    return safe_float(text).cast("long")


def safe_bool(text: Column) -> Column:
    """true, 1 and yes are true, an empty text NULL, the rest false."""
    word = F.lower(F.trim(text))
    return F.when(word == "", None).otherwise(word.isin(*TRUE_WORDS))


def hashed_id(prefix: str, canonical: Column, digits: int) -> Column:
    """A deterministic identifier: the first digits of the SHA-256 of a canonical text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical, 256), 1, digits))


def strategy_category(name: Column) -> Column:
    """trend, reversion, aware or other, by the name's beginning."""
    return F.when(name.startswith("TF"), "trend").when(name.startswith("MR"), "reversion").when(name.startswith("PhaseAware"), "aware").otherwise("other")


def identity(surface: Column, version: Column, state: Column, regime: Column) -> dict[str, Column]:
    """Surface, version and state, filled from the legacy regime where they are blank."""
    known = F.nullif(F.trim(surface), F.lit(""))
    return {
        "surface_id": F.coalesce(known, F.when(regime.isNotNull(), F.lit("trend_vol"))),
        "surface_version": F.coalesce(F.nullif(F.trim(version), F.lit("")), F.lit("1")),
        "state_id": F.coalesce(F.nullif(F.trim(state), F.lit("")), lookup(REGIME_TO_PHASE, regime), regime),
    }


def winsorised(x: Column, low: Column, high: Column) -> Column:
    """The value, kept within bounds."""
    return F.least(F.greatest(x, low), high)


def impute(df: DataFrame, columns: list[str], aware: bool = True) -> DataFrame:
    """Zero for NULL, and (if aware) a flag for each column that says where it was."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("byte") for c in columns} if aware else {}
    return df.withColumns(flags).fillna(0.0, subset=columns)


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column for each value of a fixed vocabulary."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def feature_projection(df: DataFrame, groups: dict[str, list[str]], wanted: list[str], required: set[str]) -> DataFrame:
    """The wanted groups' columns by name; optional ones that the table lacks are NULL, required ones an error."""
    names = sorted({c for g in wanted for c in groups[g]})
    lacking = [c for c in names if c not in df.columns]
    if bad := sorted(required.intersection(lacking)):
        raise ValueError(f"required columns are missing: {', '.join(bad)}")
    return df.select("pair", "ts", *[F.lit(None).cast("double").alias(c) if c in lacking else F.col(c) for c in names])


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free sum of row hashes."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("hash"))


def changed_rows(df: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """Rows in which any of the columns is another than on the row before; the first row of a key counts."""
    from pyspark.sql.window import Window

    by = Window.partitionBy(*keys).orderBy(order)
    changed = F.row_number().over(by) == 1
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(by))
    return df.withColumn("changed", changed).filter("changed").drop("changed")
