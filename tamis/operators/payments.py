"""Payment addresses and tokens against lists, with nulls for lists that were not there.

Lists are tables(list, address, reason). Which lists were loaded is part of the answer: an address that is on
none of some of the lists is not clear, but unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts

# The sanction lists whose union is screened.
SANCTION_LISTS = ["ETH", "ARB", "BSC", "ETC", "USDC", "USDT"]


def is_address(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"^0x[0-9a-fA-F]{40}\z")), F.lit(False))


def is_name(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"(?i)^([a-z0-9-]+\.)+eth\z")), F.lit(False))


def sanctioned(lists: DataFrame) -> DataFrame:
    """(address): all lists together, lower case, each once; what isn't an address is left out."""
    return lists.select(F.lower(F.trim("address")).alias("address")).where(is_address(F.col("address"))).distinct()


def scams(lists: DataFrame) -> DataFrame:
    """(address, reason, list): of an address on several lists the first list's row, by its order column."""
    own = lists.withColumn("address", F.lower(F.trim("address"))).where(is_address(F.col("address")))
    return own.groupBy("address").agg(F.min(F.struct("order", "list", "reason")).alias("x")).select("address", "x.reason", "x.list")


def member(df: DataFrame, rows: DataFrame | None, name: str) -> DataFrame:
    """df with a tri-state column: true, false, or null where there is no list."""
    if rows is None:
        return df.withColumn(name, F.lit(None).cast("boolean"))
    hit = rows.select(F.col("address").alias("_address"), F.lit(True).alias("_hit"))
    return df.join(hit, F.lower("address") == F.col("_address"), "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_address", "_hit")


def screen_address(df: DataFrame, sanction_rows: DataFrame | None, complete: bool, scam_rows: DataFrame | None, onchain: DataFrame | None) -> DataFrame:
    """df(address) with sanctioned, scam, flags, checks_skipped and verdict.

    complete: whether all sanction lists were loaded. onchain(address, is_contract, tx_count, has_balance).
    """
    df = member(member(df, sanction_rows, "sanctioned"), scam_rows, "scam")
    if onchain is None:
        df = df.withColumns({"is_contract": F.lit(None).cast("boolean"), "tx_count": F.lit(None).cast("long"), "has_balance": F.lit(None).cast("boolean")})
    else:
        df = df.join(onchain.withColumnRenamed("address", "_address"), F.lower("address") == F.col("_address"), "left").drop("_address")
    partial = F.lit(not complete) & F.col("sanctioned").eqNullSafe(False)
    fresh = F.coalesce((F.col("tx_count") == 0) & ~F.col("is_contract") & ~F.col("has_balance"), F.lit(False))
    ids, _ = verdicts.flags(
        ("sanctioned", F.coalesce("sanctioned", F.lit(False)), 0), ("scam", F.coalesce("scam", F.lit(False)), 0), ("brand-new-address", fresh, 0), ("contract", F.coalesce("is_contract", F.lit(False)), 0),
        ("sanctions-not-checked", F.col("sanctioned").isNull(), 0), ("sanctions-partial", partial, 0), ("scam-not-checked", F.col("scam").isNull(), 0), ("onchain-not-checked", F.col("tx_count").isNull(), 0),
    )
    block = F.coalesce("sanctioned", F.lit(False)) | F.coalesce("scam", F.lit(False))
    care = fresh | F.col("sanctioned").isNull() | F.col("scam").isNull() | partial
    v = F.when(~is_address(F.col("address")), "error").when(block, "block").when(care, "caution").otherwise("safe")
    return df.withColumn("flags", ids).withColumn("verdict", v).withColumn("checks_skipped", verdicts.skipped(sanctions=F.col("sanctioned"), scam=F.col("scam"), onchain=F.col("tx_count")))


def check_sanctioned(df: DataFrame, lists: DataFrame, loaded: list[str]) -> DataFrame:
    """df(address) with sanctioned, lists_missing and verdict; loaded: names of the lists that could be read."""
    rows = sanctioned(lists.where(F.col("list").isin(loaded))) if loaded else None
    df = member(df, rows, "sanctioned")
    missing = [x for x in SANCTION_LISTS if x not in loaded]
    v = F.when(F.col("sanctioned"), "block").when(~F.col("sanctioned") & F.lit(not missing), "clear").otherwise("unknown")
    answer = F.when(F.col("sanctioned") | F.lit(not missing), F.col("sanctioned"))
    return df.withColumn("verdict", v).withColumn("sanctioned", answer).withColumn("lists_missing", F.lit(",".join(missing)))


def screen_token(df: DataFrame, scam_rows: DataFrame | None, honeypot: DataFrame | None) -> DataFrame:
    """df(address, is_contract) with scam, honeypot facts and verdict; honeypot(address, is_honeypot, sell_tax, high_risk)."""
    df = member(df, scam_rows, "scam")
    if honeypot is None:
        df = df.withColumns({"is_honeypot": F.lit(None).cast("boolean"), "sell_tax": F.lit(None).cast("double"), "high_risk": F.lit(None).cast("boolean")})
    else:
        df = df.join(honeypot.withColumnRenamed("address", "_address"), F.lower("address") == F.col("_address"), "left").drop("_address")
    t = lambda c: F.coalesce(c, F.lit(False))
    block = t(F.col("scam")) | t(F.col("is_honeypot")) | t(F.col("sell_tax") >= 50)
    care = t(F.col("sell_tax") >= 10) | t(F.col("high_risk")) | F.col("is_honeypot").isNull() | F.col("scam").isNull() | ~t(F.col("is_contract"))
    return df.withColumn("verdict", F.when(block, "block").when(care, "caution").otherwise("safe")).withColumn("checks_skipped", verdicts.skipped(scam=F.col("scam"), simulation=F.col("is_honeypot")))


def resolve_name(df: DataFrame, names: DataFrame | None, sanction_rows: DataFrame | None, scam_rows: DataFrame | None) -> DataFrame:
    """df(name) with status (resolved, none, failed), address and verdict; names(name, address): a null address means none."""
    if names is None:
        df = df.withColumn("address", F.lit(None).cast("string")).withColumn("status", F.lit("failed"))
    else:
        df = df.join(names.select("name", "address", F.lit(True).alias("_hit")), "name", "left")
        df = df.withColumn("status", F.when(F.col("_hit").isNull(), "failed").when(F.col("address").isNull(), "none").otherwise("resolved")).drop("_hit")
    df = member(member(df, sanction_rows, "sanctioned"), scam_rows, "scam")
    bad = F.coalesce("sanctioned", F.lit(False)) | F.coalesce("scam", F.lit(False))
    unsure = F.col("sanctioned").isNull() | F.col("scam").isNull()
    return df.withColumn("verdict", F.when(F.col("status") != "resolved", "unknown").when(bad, "block").when(unsure, "caution").otherwise("safe"))


def ether(wei_hex: Column) -> Column:
    """ETH of a hexadecimal amount of wei of up to 16 digits; longer ones are null here and kept as text."""
    return F.when(F.length(wei_hex) <= 17, F.conv(F.substring(wei_hex, 3, 16), 16, 10).cast("decimal(38,0)").cast("double") / 1e18)
