"""Queries over addresses made from customer keys and lists made from subsets of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import plain, run
from ..operators import payments as pay

_A = "'0x' || substr(sha2(CAST(c_custkey AS STRING), 256), 1, 40)"
ADDRESSES = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 41 = 0 THEN 'not an address' WHEN c_custkey % 2 = 0 THEN upper(substr({_A}, 3)) ELSE {_A} END AS a0, {_A} AS plain_address FROM {{customer}}"
ADDRESSES = f"SELECT id, CASE WHEN id % 41 = 0 THEN a0 WHEN id % 2 = 0 THEN '0x' || a0 ELSE a0 END AS address FROM ({ADDRESSES})"
LISTS = f"SELECT CASE c_custkey % 6 WHEN 0 THEN 'ETH' WHEN 1 THEN 'ARB' WHEN 2 THEN 'BSC' WHEN 3 THEN 'ETC' WHEN 4 THEN 'USDC' ELSE 'USDT' END AS list, {_A} AS address FROM {{customer}} WHERE c_custkey % 25 = 0 UNION ALL SELECT 'ETH', ' ' || {_A} FROM {{customer}} WHERE c_custkey % 75 = 0 UNION ALL SELECT 'BSC', 'x' FROM {{customer}} WHERE c_custkey = 1"
SCAMS = f"SELECT 0 AS \"order\", 'dark' AS list, {_A} AS address, 'phish' AS reason FROM {{customer}} WHERE c_custkey % 30 = 0 UNION ALL SELECT 1, 'black', {_A}, 'fake' FROM {{customer}} WHERE c_custkey % 20 = 0"
ONCHAIN = f"SELECT {_A} AS address, c_custkey % 5 = 0 AS is_contract, CAST(c_custkey % 3 AS BIGINT) AS tx_count, c_custkey % 4 = 0 AS has_balance FROM {{customer}} WHERE c_custkey % 7 <> 0"
HONEYPOT = f"SELECT {_A} AS address, c_custkey % 9 = 0 AS is_honeypot, CAST(c_custkey % 60 AS DOUBLE) AS sell_tax, c_custkey % 8 = 0 AS high_risk FROM {{customer}} WHERE c_custkey % 11 <> 0"
NAMES = f"SELECT 'n' || CAST(c_custkey AS STRING) || '.eth' AS name, CASE WHEN c_custkey % 3 <> 0 THEN {_A} END AS address FROM {{customer}} WHERE c_custkey % 4 <> 0"


def _quote(sql: str) -> str:
    return sql.replace('"order"', "`order`")


def _r(spark, sf, sql):
    return run(spark, sf, _quote(sql))


def ofac_union(spark, sf):
    return pay.sanctioned(_r(spark, sf, LISTS))


def scam_union_priority(spark, sf):
    return pay.scams(_r(spark, sf, SCAMS))


def _screened(spark, sf, complete=True, lists=True, scams=True, chain=True):
    s, c, o = _r(spark, sf, LISTS), _r(spark, sf, SCAMS), _r(spark, sf, ONCHAIN)
    out = pay.screen_address(_r(spark, sf, ADDRESSES), pay.sanctioned(s) if lists else None, complete, pay.scams(c) if scams else None, o if chain else None)
    return out.select("id", "verdict", F.array_join("flags", ",").alias("flags"), F.array_join("checks_skipped", ",").alias("skipped"))


def screen_address(spark, sf):
    return _screened(spark, sf)


def screen_address_outage(spark, sf):
    """All lists gone: nothing is safe."""
    return _screened(spark, sf, lists=False, scams=False, chain=False)


def screen_address_partial(spark, sf):
    return _screened(spark, sf, complete=False)


def check_sanctioned_partial(spark, sf):
    out = pay.check_sanctioned(_r(spark, sf, ADDRESSES), _r(spark, sf, LISTS), ["ETH", "ARB", "BSC"])
    return out.select("id", "sanctioned", "verdict", "lists_missing")


def check_sanctioned(spark, sf):
    return pay.check_sanctioned(_r(spark, sf, ADDRESSES), _r(spark, sf, LISTS), pay.SANCTION_LISTS).select("id", "sanctioned", "verdict")


def screen_token(spark, sf):
    d = _r(spark, sf, ADDRESSES).withColumn("is_contract", F.col("id") % 6 != 0)
    return pay.screen_token(d, pay.scams(_r(spark, sf, SCAMS)), _r(spark, sf, HONEYPOT)).select("id", "verdict", F.array_join("checks_skipped", ",").alias("skipped"))


def resolve_name(spark, sf):
    d = _r(spark, sf, "SELECT c_custkey AS id, 'n' || CAST(c_custkey AS STRING) || '.eth' AS name FROM {customer}")
    return pay.resolve_name(d, _r(spark, sf, NAMES), pay.sanctioned(_r(spark, sf, LISTS)), None).select("id", "status", "verdict")


def beyond_eth(spark, sf):
    """Addresses of the union that the first list lacks: an anti-join."""
    lists = _r(spark, sf, LISTS)
    return pay.sanctioned(lists).join(pay.sanctioned(lists.where("list = 'ETH'")), "address", "left_anti")


def lists_shared(spark, sf):
    """Addresses on both kinds of list, and on sanction lists only: intersection and difference."""
    a, b = pay.sanctioned(_r(spark, sf, LISTS)), pay.scams(_r(spark, sf, SCAMS)).select("address")
    return a.intersect(b).withColumn("where", F.lit("both")).union(a.subtract(b).withColumn("where", F.lit("sanctions")))


_s = lambda sql: plain(sql).replace("AS STRING", "AS VARCHAR").replace("sha2(", "sha256(").replace(", 256)", ")")
_ofac = f"SELECT DISTINCT lower(trim(address)) AS address FROM ({_s(LISTS)}) WHERE regexp_matches(lower(trim(address)), '^0x[0-9a-f]{{40}}$')"
_scam = f"SELECT address, arg_min(reason, \"order\") AS reason, arg_min(list, \"order\") AS list FROM ({_s(SCAMS)}) GROUP BY address"
_ok = "regexp_matches(address, '^0x[0-9a-fA-F]{40}$')"


def _screen(sanction: str, scam: str, partial: str, chain: str) -> str:
    fresh = "coalesce(tx_count = 0 AND NOT is_contract AND NOT has_balance, FALSE)"
    flag = lambda c, n: f"CASE WHEN {c} THEN '{n}' END"
    return f"""SELECT id, CASE WHEN NOT {_ok} THEN 'error' WHEN coalesce(s, FALSE) OR coalesce(c, FALSE) THEN 'block' WHEN {fresh} OR s IS NULL OR c IS NULL OR ({partial} AND NOT s) THEN 'caution' ELSE 'safe' END AS verdict,
 concat_ws(',', {flag('s', 'sanctioned')}, {flag('c', 'scam')}, {flag(fresh, 'brand-new-address')}, {flag('is_contract', 'contract')}, {flag('s IS NULL', 'sanctions-not-checked')}, {flag(f'{partial} AND NOT s', 'sanctions-partial')}, {flag('c IS NULL', 'scam-not-checked')}, {flag('tx_count IS NULL', 'onchain-not-checked')}) AS flags,
 concat_ws(',', {flag('s IS NULL', 'sanctions')}, {flag('c IS NULL', 'scam')}, {flag('tx_count IS NULL', 'onchain')}) AS skipped
FROM (SELECT a.id, a.address, {sanction} AS s, {scam} AS c, o.is_contract, o.tx_count, o.has_balance FROM ({_s(ADDRESSES)}) a LEFT JOIN (SELECT * FROM ({_s(ONCHAIN)}) WHERE {chain}) o ON lower(a.address) = o.address)"""


_in = lambda sub: f"lower(a.address) IN (SELECT address FROM ({sub}))"
QUERIES = {f.__name__: f for f in (ofac_union, scam_union_priority, screen_address, screen_address_outage, screen_address_partial, check_sanctioned, check_sanctioned_partial, screen_token, resolve_name, beyond_eth, lists_shared)}
SQL = {
    "ofac_union": _ofac,
    "scam_union_priority": _scam,
    "screen_address": _screen(_in(_ofac), _in(_scam), "FALSE", "TRUE"),
    "screen_address_outage": _screen("NULL::BOOLEAN", "NULL::BOOLEAN", "FALSE", "FALSE"),
    "screen_address_partial": _screen(_in(_ofac), _in(_scam), "TRUE", "TRUE"),
    "check_sanctioned": f"SELECT id, {_in(_ofac)} AS sanctioned, CASE WHEN {_in(_ofac)} THEN 'block' ELSE 'clear' END AS verdict FROM ({_s(ADDRESSES)}) a",
    "check_sanctioned_partial": f"SELECT id, CASE WHEN hit THEN TRUE END AS sanctioned, CASE WHEN hit THEN 'block' ELSE 'unknown' END AS verdict, 'ETC,USDC,USDT' AS lists_missing FROM (SELECT id, lower(address) IN (SELECT lower(trim(address)) FROM ({_s(LISTS)}) WHERE list IN ('ETH', 'ARB', 'BSC')) AS hit FROM ({_s(ADDRESSES)}))",
    "screen_token": f"""SELECT a.id, CASE WHEN {_in(_scam)} OR coalesce(is_honeypot, FALSE) OR coalesce(sell_tax >= 50, FALSE) THEN 'block' WHEN coalesce(sell_tax >= 10, FALSE) OR coalesce(high_risk, FALSE) OR is_honeypot IS NULL OR a.id % 6 = 0 THEN 'caution' ELSE 'safe' END AS verdict,
 CASE WHEN is_honeypot IS NULL THEN 'simulation' ELSE '' END AS skipped FROM ({_s(ADDRESSES)}) a LEFT JOIN ({_s(HONEYPOT)}) h ON lower(a.address) = h.address""",
    "resolve_name": f"SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'resolved' END AS status, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 'unknown' WHEN c_custkey % 25 = 0 THEN 'block' ELSE 'caution' END AS verdict FROM customer",
    "beyond_eth": f"SELECT address FROM ({_ofac}) WHERE address NOT IN (SELECT lower(trim(address)) FROM ({_s(LISTS)}) WHERE list = 'ETH')",
    "lists_shared": f"SELECT address, CASE WHEN address IN (SELECT address FROM ({_scam})) THEN 'both' ELSE 'sanctions' END AS \"where\" FROM ({_ofac})",
}
