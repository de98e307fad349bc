"""Queries over the sample tables, one or more per operator, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import DAY, round_half_up
from tallyforge.operators import backtest, entity, features, integrity, labels, monitoring, scoring, wallets
from tallyforge import sources
from tallyforge.plans.scratch import scratch_path
from tallyforge.sources import fixtures as v
from tallyforge.sources.fixtures import AS_OF, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
CUTOFF = 1705276800  # 2024-01-15 UTC
WINDOW_END = 1706486400
MARKET_NOW = 883612800  # 1998-01-01 UTC


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# Ingest


@query("a1_read_tables", f"""WITH {with_views('transfers')} SELECT fmt, address, chain, hash, ts, from_addr, to_addr FROM transfers, (SELECT unnest(['parquet', 'json', 'csv']) AS fmt)""")
def _(s, d) -> DataFrame:
    """All transfers written in each format, by chain where the format keeps it, and read back under the declared schema."""
    path, out = scratch_path(s, "interchange"), None
    t = v.transfers(s, d).withColumn("value_wei", F.lit(None).cast("decimal(38,0)"))
    for fmt in ("parquet", "json", "csv"):
        sources.write_table(t, f"{path}/{fmt}", fmt)
        got = sources.read_table(s, f"{path}/{fmt}", "transfers", fmt).select(F.lit(fmt).alias("fmt"), "address", "chain", "hash", "ts", "from_addr", "to_addr")
        out = got if out is None else out.unionByName(got)
    return out


@query("a2_normalize_transfers", f"WITH {with_views('transfers')} SELECT hash, ts + (CASE WHEN ts % 2 = 0 THEN 0 ELSE 0 END) AS ts, lower(from_addr) AS from_addr, CASE WHEN ts % 7 = 0 THEN '' WHEN ts % 11 = 0 THEN NULL ELSE lower(to_addr) END AS to_addr FROM transfers")
def _(s, d) -> DataFrame:
    raw = v.transfers(s, d)
    iso = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    to = F.when(F.col("ts") % 7 == 0, "").when(F.col("ts") % 11 == 0, None).otherwise(F.upper("to_addr"))
    raw = raw.withColumn("to_addr", to).withColumn("from_addr", F.upper("from_addr")).withColumn("ts", F.when(F.col("ts") % 2 == 0, F.col("ts").cast("string")).otherwise(iso))
    return features.normalize_transfers(raw).select("hash", "ts", "from_addr", "to_addr")


@query("a3_merge_transfers", f"""WITH {with_views('transfers')}, both_sides AS (
  SELECT *, 0 AS side FROM transfers WHERE from_addr = address UNION ALL SELECT *, 1 AS side FROM transfers WHERE to_addr = address),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, chain, hash ORDER BY side, ts) AS rn FROM both_sides) WHERE rn = 1)
SELECT address, chain, hash, ts FROM (SELECT *, row_number() OVER (PARTITION BY address, chain ORDER BY ts DESC, hash) AS k FROM once) WHERE k <= 25""")
def _(s, d) -> DataFrame:
    t = v.transfers(s, d)
    return features.merge_transfers(t.where("from_addr = address"), t.where("to_addr = address"), limit=25).select("address", "chain", "hash", "ts")


def _results(s, d):
    base = v._events(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("m"))
    src = F.explode(F.array(*(F.struct(F.lit(n).alias("source"), F.lit(i).alias("i")) for i, n in enumerate(("explorer", "indexer", "archive")))))
    each = base.select("user_id", "n", "m", src.alias("x"))
    return each.select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), v._chain(F.col("user_id")).alias("chain"), F.col("x.source").alias("source"), ((F.col("m") + F.col("x.i") * 7) % 3 != 0).alias("ok"), (F.col("n") + F.col("x.i") * (F.col("m") % 20)).alias("value"))


def _priority(s):
    rows = [(c, n, (i + k) % 3) for k, c in enumerate(v.CHAINS) for i, n in enumerate(("explorer", "indexer", "archive"))]
    return s.createDataFrame(rows, "chain string, source string, rank int")


_RESULTS = f"""base AS (SELECT user_id, count(*) AS n, max(event_id) AS m FROM events GROUP BY user_id), src(source, i) AS (VALUES ('explorer', 0), ('indexer', 1), ('archive', 2)),
results AS (SELECT 'w' || user_id AS address, {v._c('user_id')} AS chain, user_id % 4 AS c, source, i, (m + i * 7) % 3 <> 0 AS ok, n + i * (m % 20) AS value FROM base, src),
ranked AS (SELECT *, (i + c) % 3 AS rank FROM results)"""


@query("a4_pick_by_priority", f"""WITH {_RESULTS}, won AS (SELECT address, chain, min(rank) FILTER (ok) AS won FROM ranked GROUP BY ALL)
SELECT w.address, w.chain, max(r.source) FILTER (r.rank = w.won) AS source, max(r.value) FILTER (r.rank = w.won) AS value, string_agg(r.source, ',' ORDER BY r.rank) FILTER (w.won IS NULL OR r.rank <= w.won) AS attempts
FROM won w JOIN ranked r USING (address, chain) GROUP BY ALL""")
def _(s, d) -> DataFrame:
    return features.pick_by_priority(_results(s, d), _priority(s)).withColumn("attempts", F.array_join("attempts", ","))


@query("a5_reconcile_sources", f"""WITH {_RESULTS} SELECT a.address, a.chain, a.value AS a, b.value AS b, round(abs(a.value - b.value) / greatest(a.value, b.value, 1), 6) AS gap
FROM results a JOIN results b USING (address, chain) WHERE a.source = 'explorer' AND b.source = 'archive' AND abs(a.value - b.value) / greatest(a.value, b.value, 1) > 0.1""")
def _(s, d) -> DataFrame:
    x = _results(s, d)
    return features.reconcile_sources(x.where("source = 'explorer'"), x.where("source = 'archive'")).withColumn("gap", r("gap"))


@query("a6_completeness", """WITH e AS (SELECT event_id, event_id % 2 = 0 AS f1, event_id % 3 = 0 AS f2, event_id % 5 = 0 AS f3, event_id % 7 = 0 AS f4, event_id % 11 = 0 AS f5 FROM events)
SELECT event_id, floor((1 - (CASE WHEN f1 THEN 0.4e0 ELSE 0e0 END + CASE WHEN f2 THEN 0.2e0 ELSE 0e0 END + CASE WHEN f3 THEN 0.2e0 ELSE 0e0 END + CASE WHEN f4 THEN 0.1e0 ELSE 0e0 END + CASE WHEN f5 THEN 0.1e0 ELSE 0e0 END)) * 100 + 0.5) / 100 AS completeness,
 concat_ws(',', CASE WHEN f1 THEN 'etherscan' END, CASE WHEN f2 THEN 'alchemy' END, CASE WHEN f3 THEN 'aave' END, CASE WHEN f4 THEN 'compound' END, CASE WHEN f5 THEN 'uniswap' END) AS degraded_sources FROM e""")
def _(s, d) -> DataFrame:
    names = ("etherscan", 2), ("alchemy", 3), ("aave", 5), ("compound", 7), ("uniswap", 11)
    errs = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col("event_id") % n == 0, F.struct(F.lit(k).alias("k"), F.lit("down").alias("v"))) for k, n in names))))
    return features.completeness(v.table(s, d, "events").select("event_id", errs.alias("errors"))).select("event_id", "completeness", F.array_join("degraded_sources", ",").alias("degraded_sources"))


@query("a7_new_addresses", "WITH c AS (SELECT DISTINCT o_custkey FROM orders) SELECT 'u' || o_custkey AS address FROM c WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def _(s, d) -> DataFrame:
    return features.new_addresses(v.loans(s, d).select(F.col("borrower").alias("address")), v.wallets(s, d).where("c_custkey % 3 = 0"))


@query("a8_valid_addresses", r"""WITH a AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0x' || upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 32)) || '00aaBB11' WHEN 1 THEN CASE o_orderkey % 7 WHEN 0 THEN 'sub.' WHEN 1 THEN repeat('x', 60) ELSE '' END || 'Name' || o_orderkey || '.ETH' WHEN 2 THEN translate(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 32), '0', '1') || 'XyZ9' ELSE 'x0' || o_orderkey END AS address FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'evm' WHEN o_orderkey % 4 = 1 AND o_orderkey % 7 > 1 THEN 'ens' WHEN o_orderkey % 4 = 2 THEN 'solana' ELSE 'invalid' END AS address_kind, CASE WHEN o_orderkey % 4 = 2 THEN address WHEN o_orderkey % 4 = 3 OR o_orderkey % 4 = 1 AND o_orderkey % 7 < 2 THEN NULL ELSE lower(address) END AS normalised FROM a""")
def _(s, d) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    h = F.substring(F.md5(k.cast("binary")), 1, 32)
    odd = F.when(F.col("o_orderkey") % 7 == 0, "sub.").when(F.col("o_orderkey") % 7 == 1, "x" * 60).otherwise("")  # two labels, or too long
    form = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("0x"), F.upper(h), F.lit("00aaBB11"))).when(F.col("o_orderkey") % 4 == 1, F.concat(odd, F.lit("Name"), k, F.lit(".ETH"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.translate(h, "0", "1"), F.lit("XyZ9"))).otherwise(F.concat(F.lit("x0"), k))
    return features.valid_addresses(v.table(s, d, "orders").select("o_orderkey", form.alias("address"))).select("o_orderkey", "address_kind", "normalised")


def _deployments(s):
    return s.createDataFrame([("aave_v3", "ethereum", "aave"), ("aave_v3", "arbitrum", "aave"), ("aave_v3", "polygon", "aave"), ("compound_v2", "ethereum", "compound"), ("compound_v3", "base", "compound")], "protocol string, chain string, family string")


@query("a9_normalize_lending", f"""WITH {with_views('lending')}, dep(protocol, chain, family) AS (VALUES ('aave_v3','ethereum','aave'),('aave_v3','arbitrum','aave'),('aave_v3','polygon','aave'),('compound_v2','ethereum','compound'),('compound_v3','base','compound'))
SELECT l.address, l.chain, d.family, d.protocol, l.kind, l.ts FROM (SELECT *, CASE WHEN family = 'aave' THEN 'aave_v3' WHEN chain = 'base' THEN 'compound_v3' ELSE 'compound_v2' END AS protocol FROM lending) l JOIN dep d ON l.protocol = d.protocol AND l.chain = d.chain""")
def _(s, d) -> DataFrame:
    e = v.lending_events(s, d)
    aave = F.col("family") == "aave"
    raw = e.select(
        F.when(aave, "aave_v3").when(F.col("chain") == "base", "compound_v3").otherwise("compound_v2").alias("protocol"), "chain", "kind", "ts", F.when(aave, F.upper("address")).alias("user"),
        F.when(~aave & (F.col("kind") != "liquidation"), F.upper("address")).alias("account"), F.when(~aave & (F.col("kind") == "liquidation"), F.upper("address")).alias("liquidatee"),
    )
    return features.normalize_lending(raw, _deployments(s))


@query("a10_upsert_scores", f"""WITH {with_views('history')}, x AS (SELECT lower(address) AS address, score, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS side FROM history)
SELECT address, arg_max(score, ts * 100000000 + side * 10000000 + score) AS score, max(ts) AS scored_at, count(*) AS snapshots, CAST(sum(score) AS BIGINT) AS snapshot_points FROM x GROUP BY address""")
def _(s, d) -> DataFrame:
    """Two deliveries into the stores, the second one twice: the latest score of each wallet, and the snapshot rows."""
    h = v.score_history(s, d).withColumnRenamed("ts", "scored_at")
    stores = features.score_stores(s, scratch_path(s, "scores"), partitions=8)
    for number, side in ((1, 0), (2, 1), (2, 1)):
        features.sync_scores(stores, h.where(F.col("event_id") % 2 == side), batch=("sync", number))
    kept = stores[1].read().groupBy("address").agg(F.count("*").alias("snapshots"), F.sum("score").alias("snapshot_points"))
    return stores[0].read().select("address", "score", "scored_at").join(kept, "address")


@query("a10_upsert_scores_joined", f"""WITH {with_views('history')}, x AS (SELECT lower(address) AS address, score, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS side FROM history)
SELECT address, arg_max(score, ts * 100000000 + side * 10000000 + score) AS score, max(ts) AS scored_at FROM x GROUP BY address""")
def _(s, d) -> DataFrame:
    h = v.score_history(s, d).withColumnRenamed("ts", "scored_at")
    old, new = h.where("event_id % 2 = 0"), h.where("event_id % 2 = 1")
    return features.upsert_scores(old.select("address", "score", "scored_at"), new)


# Features

_ACTIVITY = f"""SELECT address, chain, count(*) AS tx_count, count(*) FILTER (ts >= {AS_OF} - 30 * 86400) AS tx_count_30d, count(*) FILTER (ts >= {AS_OF} - 90 * 86400) AS tx_count_90d, count(*) FILTER (ts >= {AS_OF} - 180 * 86400) AS tx_count_180d,
 count(DISTINCT ts // 86400) AS active_days_count, count(DISTINCT CASE WHEN ts >= {AS_OF} - 365 * 86400 THEN strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m') END) AS active_months_12, min(ts) AS first_ts FROM transfers GROUP BY address, chain"""


@query("b1_activity_features", f"WITH {with_views('transfers')} {_ACTIVITY}")
def _(s, d) -> DataFrame:
    return features.activity_features(v.transfers(s, d), as_of=AS_OF)


@query("b2_first_activity", f"WITH {with_views('transfers')} SELECT address, chain, min(ts) AS first_ts, CAST(floor(({AS_OF} - min(ts)) / 86400) AS BIGINT) AS wallet_age_days FROM transfers GROUP BY address, chain")
def _(s, d) -> DataFrame:
    return features.first_activity(v.transfers(s, d), as_of=AS_OF)


_COUNTS = ", ".join(f"count(*) FILTER (family = '{f}' AND kind = '{k}') AS {f}_{n}" for f in ("aave", "compound") for k, n in (("borrow", "borrows"), ("repay", "repays"), ("liquidation", "liquidations")))


@query("b3_lending_counts", f"WITH {with_views('lending')} SELECT address, chain, {_COUNTS} FROM lending WHERE family = 'aave' AND chain <> 'base' OR family = 'compound' AND chain IN ('ethereum', 'base') GROUP BY address, chain")
def _(s, d) -> DataFrame:
    return features.lending_counts(v.lending_events(s, d), _deployments(s))


@query("b4_borrower_stats", f"WITH {with_views('lending')} SELECT * FROM (SELECT address, count(*) FILTER (kind = 'borrow') AS borrows, count(*) FILTER (kind = 'repay') AS repays, count(*) FILTER (kind = 'liquidation') AS liquidations FROM lending GROUP BY address) WHERE borrows > 0")
def _(s, d) -> DataFrame:
    return features.borrower_stats(v.lending_events(s, d))


_TOKENS = [("c0", "stable", 6, 1.0), ("c1", "stable", 18, 1.0), ("c2", "lido", 18, 2000.0), ("c3", "aave_v3", 6, 1.0), ("c4", "aave_v2", 6, 1.0), ("c5", "compound", 8, 0.02)]


@query("b5_portfolio_features", f"""WITH {with_views('balances')}, tok(contract, role, decimals, price) AS (VALUES {', '.join(str(t) for t in _TOKENS)}),
m AS (SELECT b.*, role, coalesce(raw / power(10, decimals) * price, 0) AS usd FROM balances b LEFT JOIN tok USING (contract) WHERE raw > 0),
g AS (SELECT address, chain, count(DISTINCT contract) AS token_diversity, sum(CASE WHEN role = 'stable' THEN usd ELSE 0 END) AS s, sum(usd) AS t, coalesce(bool_or(role = 'lido'), false) AS has_staked_eth,
 coalesce(bool_or(role = 'aave_v3' OR role = 'aave_v2' AND chain = 'ethereum'), false) AS has_aave, coalesce(bool_or(role = 'compound' AND chain = 'ethereum'), false) AS has_compound FROM m GROUP BY address, chain)
SELECT address, chain, token_diversity, round(s, 3) AS stablecoin_usd, round(t, 3) AS total_portfolio_usd, has_staked_eth, has_aave, has_compound, round(CASE WHEN t > 0 THEN s / t * 100 ELSE 0 END, 6) AS stablecoin_pct FROM g""")
def _(s, d) -> DataFrame:
    tokens = s.createDataFrame(_TOKENS, "contract string, role string, decimals int, price double")
    return features.portfolio_features(v.balances(s, d), tokens).withColumns({"stablecoin_usd": r("stablecoin_usd", 3), "total_portfolio_usd": r("total_portfolio_usd", 3), "stablecoin_pct": r("stablecoin_pct")})


@query("b6_identity_flags", "SELECT 's' || s_suppkey AS address, 'ethereum' AS chain, s_suppkey % 3 <> 0 AS has_eth, s_suppkey % 4 = 1 AS is_gnosis_safe, s_suppkey % 5 = 2 AS has_ens FROM supplier")
def _(s, d) -> DataFrame:
    k = F.col("s_suppkey")
    acc = v.table(s, d, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("address"), F.lit("ethereum").alias("chain"), F.when(k % 3 == 0, "0x0").otherwise("0xde0b6b3a7640000").alias("balance_hex"),
        F.when(k % 4 == 1, "0x6080").when(k % 4 == 2, F.concat(F.lit("0x"), F.repeat(F.lit("60"), 200))).when(k % 4 == 3, "0x").alias("code"), F.when(k % 5 == 2, F.concat(F.lit("0x"), F.repeat(F.lit("0"), 63), F.lit("7"))).when(k % 5 == 3, F.concat(F.lit("0x"), F.repeat(F.lit("0"), 64))).alias("resolver"),
    )
    return features.identity_flags(acc)


def _wide(s, d):
    """Wallets with every input of the ratio and vector operators."""
    act = features.activity_features(v.transfers(s, d), as_of=AS_OF)
    lend = features.lending_counts(v.lending_events(s, d))
    first = features.days_since_first_defi(v.lending_events(s, d), act, as_of=AS_OF)
    n = F.substring("address", 2, 9).cast("int")
    df = act.join(lend, ["address", "chain"], "left").join(first, ["address", "chain"], "left").fillna(0)
    return df.withColumns({"wallet_age_days": F.floor((AS_OF - F.col("first_ts")) / DAY), "has_aave": n % 5 == 0, "has_compound": n % 7 == 0, "has_uniswap_lp": n % 3 == 0, "has_staked_eth": n % 2 == 0})


_WIDE = f"""{with_views('transfers', 'lending')}, act AS ({_ACTIVITY}), lc AS (SELECT address, chain, {_COUNTS}, CAST(floor(({AS_OF} - min(ts)) / 86400) AS BIGINT) AS days_since_first_defi FROM lending GROUP BY address, chain),
wide AS (SELECT a.*, CAST(floor(({AS_OF} - first_ts) / 86400) AS BIGINT) AS wallet_age_days, coalesce(aave_borrows, 0) AS aave_borrows, coalesce(aave_repays, 0) AS aave_repays, coalesce(aave_liquidations, 0) AS aave_liquidations, coalesce(compound_borrows, 0) AS compound_borrows, coalesce(compound_repays, 0) AS compound_repays,
 coalesce(compound_liquidations, 0) AS compound_liquidations, coalesce(days_since_first_defi, 0) AS days_since_first_defi, CAST(substr(a.address, 2) AS INT) AS n FROM act a LEFT JOIN lc USING (address, chain))"""


@query("b7_protocols_used", f"""WITH {_WIDE}, p AS (SELECT address, chain, concat_ws(',', CASE WHEN n % 5 = 0 OR aave_borrows > 0 OR aave_repays > 0 THEN 'Aave' END, CASE WHEN n % 7 = 0 OR compound_borrows > 0 OR compound_repays > 0 THEN 'Compound' END, CASE WHEN n % 3 = 0 THEN 'Uniswap' END, CASE WHEN n % 2 = 0 THEN CASE WHEN chain = 'ethereum' THEN 'Lido' ELSE 'Lido (wstETH)' END END) AS protocols_used,
 (n % 5 = 0 OR aave_borrows > 0)::INT + (n % 7 = 0 OR compound_borrows > 0)::INT + (n % 3 = 0)::INT + (n % 2 = 0)::INT AS protocols_used_count FROM wide)
SELECT * FROM p""")
def _(s, d) -> DataFrame:
    return features.protocols_used(_wide(s, d)).select("address", "chain", F.array_join("protocols_used", ",").alias("protocols_used"), "protocols_used_count")


@query("b8_derived_ratios", f"""WITH {_WIDE}, b AS (SELECT *, aave_borrows + compound_borrows AS bo, aave_repays + compound_repays AS re, aave_liquidations + compound_liquidations AS li FROM wide)
SELECT address, chain, bo AS total_borrows, re AS total_repays, round(re / greatest(bo, 1), 6) AS repayment_ratio, li AS prior_liquidation_count, CAST(li > 0 AS INT) AS has_prior_liquidation, round(least(bo / greatest(wallet_age_days, 1), 50), 6) AS borrow_velocity,
 round(least(li / greatest(bo, 1), 10), 6) AS liquidation_rate, CAST(least(greatest(bo - re, 0), 1000) AS BIGINT) AS net_unpaid_borrows, round(least(days_since_first_defi / greatest(wallet_age_days, 1), 1.5), 6) AS defi_tenure_ratio FROM b""")
def _(s, d) -> DataFrame:
    x = features.derived_ratios(_wide(s, d))
    return x.select("address", "chain", "total_borrows", "total_repays", r("repayment_ratio").alias("repayment_ratio"), "prior_liquidation_count", "has_prior_liquidation", r("borrow_velocity").alias("borrow_velocity"), r("liquidation_rate").alias("liquidation_rate"), F.col("net_unpaid_borrows").cast("long").alias("net_unpaid_borrows"), r("defi_tenure_ratio").alias("defi_tenure_ratio"))


def _vectors(s, d):
    x = features.protocols_used(features.derived_ratios(_wide(s, d)))
    x = x.withColumnsRenamed({"aave_liquidations": "aave_liquidations_prior", "compound_liquidations": "compound_liquidations_prior"}).withColumn("wallet_age_months", F.col("wallet_age_days") / 30)
    zero = {c: F.lit(0.0) for c in features.FEATURES if c not in x.columns}
    return features.feature_vector(x.withColumns(zero))


@query("b9_feature_vector", f"""WITH {_WIDE} SELECT address, chain, 34 AS n_features, CAST(wallet_age_days AS DOUBLE) AS f0, round(wallet_age_days / 30, 6) AS f1, CAST(tx_count AS DOUBLE) AS f4, CAST(aave_borrows + compound_borrows AS DOUBLE) AS f15, CASE WHEN n % 2 = 0 THEN 1e0 ELSE 0e0 END AS f22 FROM wide""")
def _(s, d) -> DataFrame:
    f = F.col("features")
    return _vectors(s, d).select("address", "chain", F.size("features").alias("n_features"), f[0].alias("f0"), r(f[1]).alias("f1"), f[4].alias("f4"), f[15].alias("f15"), f[22].alias("f22"))


@query("b10_social_features", f"""WITH {with_views('transfers')} SELECT address, chain, count(DISTINCT nullif(to_addr, '')) AS unique_recipients, floor(avg(CASE WHEN ts % 3 = 0 THEN 1.0 ELSE 0.0 END) * 100 + 0.5) / 100 AS contract_ratio FROM transfers GROUP BY address, chain""")
def _(s, d) -> DataFrame:
    t = v.transfers(s, d).withColumn("input", F.when(F.col("ts") % 3 == 0, "0xa9059cbb").when(F.col("ts") % 3 == 1, "0x"))
    return features.social_features(t)


@query("b11_days_since_first_defi", f"""WITH {with_views('transfers', 'lending')}, f AS (SELECT address, chain, min(ts) AS first_ts FROM transfers GROUP BY ALL), e AS (SELECT address, chain, min(ts) AS t FROM lending GROUP BY ALL), b AS (SELECT DISTINCT address, chain FROM lending WHERE kind = 'borrow')
SELECT address, chain, 'exact' AS mode, CAST(floor(({AS_OF} - t) / 86400) AS BIGINT) AS days_since_first_defi FROM e UNION ALL SELECT f.address, f.chain, 'serving', CAST(floor(({AS_OF} - first_ts) / 86400) AS BIGINT) FROM f JOIN b USING (address, chain)""")
def _(s, d) -> DataFrame:
    e, f = v.lending_events(s, d), features.first_activity(v.transfers(s, d), as_of=AS_OF)
    return features.days_since_first_defi(e, f, as_of=AS_OF).withColumn("mode", F.lit("exact")).unionByName(features.days_since_first_defi(e, f, as_of=AS_OF, mode="serving").withColumn("mode", F.lit("serving")))


_AT = f"""c AS (SELECT DISTINCT address, chain, {CUTOFF} + (CAST(substr(address, 2) AS BIGINT) % 5) * 86400 AS cutoff FROM transfers),
t AS (SELECT c.address, c.chain, c.cutoff, count(*) AS tx_count, count(*) FILTER (ts >= cutoff - 30 * 86400) AS tx_count_30d, count(*) FILTER (ts >= cutoff - 90 * 86400) AS tx_count_90d, count(*) FILTER (ts >= cutoff - 180 * 86400) AS tx_count_180d, count(DISTINCT ts // 86400) AS active_days_count,
 count(DISTINCT CASE WHEN ts >= cutoff - 365 * 86400 THEN strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m') END) AS active_months_12, CAST(floor((cutoff - min(ts)) / 86400) AS BIGINT) AS wallet_age_days FROM c JOIN transfers x ON x.address = c.address AND x.chain = c.chain AND x.ts < cutoff GROUP BY c.address, c.chain, c.cutoff),
l AS (SELECT c.address, c.chain, c.cutoff, {_COUNTS}, CAST(floor((cutoff - min(ts)) / 86400) AS BIGINT) AS days_since_first_defi FROM c JOIN lending x ON x.address = c.address AND x.chain = c.chain AND x.ts < cutoff GROUP BY c.address, c.chain, c.cutoff),
bal AS (SELECT 'w' || l_suppkey AS address, {v._c('l_suppkey')} AS chain, 'c' || (l_partkey % 12) AS contract, CAST(trunc(l_extendedprice) AS DOUBLE) * 1000000 AS raw, {CUTOFF} + (l_orderkey % 1000 - 500) * 1000 + l_linenumber AS ts FROM lineitem),
lb AS (SELECT c.address, c.chain, c.cutoff, contract, max_by(raw, (ts, raw)) AS raw FROM c JOIN bal USING (address, chain) WHERE bal.ts < cutoff GROUP BY ALL), tok(contract, role, decimals, price) AS (VALUES {', '.join(str(t) for t in _TOKENS)}),
p AS (SELECT address, chain, cutoff, count(*) FILTER (raw > 0) AS token_diversity, sum(CASE WHEN role = 'stable' THEN raw / power(10, decimals) * price ELSE 0 END) AS usd FROM lb LEFT JOIN tok USING (contract) GROUP BY ALL),
b AS (SELECT c.address, c.chain, c.cutoff, coalesce(tx_count, 0) AS tx_count, coalesce(tx_count_30d, 0) AS tx_count_30d, coalesce(tx_count_90d, 0) AS tx_count_90d, coalesce(tx_count_180d, 0) AS tx_count_180d, coalesce(active_days_count, 0) AS active_days_count, coalesce(active_months_12, 0) AS active_months_12, coalesce(wallet_age_days, 0) AS wallet_age_days,
 coalesce(days_since_first_defi, 0) AS days_since_first_defi, coalesce(aave_borrows, 0) AS aave_borrows, coalesce(compound_repays, 0) AS compound_repays, coalesce(aave_borrows, 0) + coalesce(compound_borrows, 0) AS total_borrows, coalesce(aave_repays, 0) + coalesce(compound_repays, 0) AS total_repays, coalesce(aave_liquidations, 0) + coalesce(compound_liquidations, 0) AS prior_liquidation_count,
 coalesce(token_diversity, 0) AS token_diversity, round(coalesce(usd, 0), 3) AS stablecoin_usd FROM c LEFT JOIN t USING (address, chain, cutoff) LEFT JOIN l USING (address, chain, cutoff) LEFT JOIN p USING (address, chain, cutoff))"""


@query("b12_point_in_time_features", f"WITH {with_views('transfers', 'lending')}, {_AT} SELECT *, round(total_repays / greatest(total_borrows, 1), 6) AS repayment_ratio, round(least(total_borrows / greatest(wallet_age_days, 1), 50), 6) AS borrow_velocity, round(least(days_since_first_defi / greatest(wallet_age_days, 1), 1.5), 6) AS defi_tenure_ratio FROM b")
def _(s, d) -> DataFrame:
    t = v.transfers(s, d)
    cut = t.select("address", "chain").distinct().withColumn("cutoff", CUTOFF + (F.substring("address", 2, 9).cast("long") % 5) * DAY)
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    dated = v.table(s, d, "lineitem").select(  # of equal times the largest balance counts
        F.concat(F.lit("w"), F.col("l_suppkey").cast("string")).alias("address"), v._chain(F.col("l_suppkey")).alias("chain"), F.concat(F.lit("c"), (F.col("l_partkey") % 12).cast("string")).alias("contract"),
        F.concat(F.lit("0x"), F.lower(F.hex(F.col("l_extendedprice").cast("long") * 1000000))).alias("balance_hex"), (CUTOFF + (order % 1000 - 500) * 1000 + line).alias("ts"),
    )
    tokens = s.createDataFrame(_TOKENS, "contract string, role string, decimals int, price double")
    out = features.point_in_time_features(t, v.lending_events(s, d), cut, balances=dated, tokens=tokens)
    names = "tx_count tx_count_30d tx_count_90d tx_count_180d active_days_count active_months_12 wallet_age_days days_since_first_defi aave_borrows compound_repays total_borrows total_repays prior_liquidation_count".split()
    return out.select("address", "chain", "cutoff", *(F.col(c).cast("long").alias(c) for c in (*names, "token_diversity")), r("stablecoin_usd", 3).alias("stablecoin_usd"), *(r(c).alias(c) for c in ("repayment_ratio", "borrow_velocity", "defi_tenure_ratio")))


@query("b13_training_features", f"""WITH {_WIDE} SELECT address, chain, CAST(floor(wallet_age_days / 30) AS BIGINT) AS wallet_age_months, CASE WHEN aave_borrows + compound_borrows > 0 THEN round_even((aave_repays + compound_repays) / (aave_borrows + compound_borrows), 4) ELSE -1 END AS repay_rate,
 CAST((n % 5 = 0 OR aave_borrows > 0) AS INT) + CAST((n % 7 = 0 OR compound_borrows > 0) AS INT) + CAST(n % 3 = 0 AS INT) + CAST(n % 2 = 0 AS INT) AS protocols_used_count FROM wide""")
def _(s, d) -> DataFrame:
    return features.training_features(features.protocols_used(features.derived_ratios(_wide(s, d))))


def _solana(s, d):
    e = v._events(s, d).withColumn("address", F.concat(F.lit("S"), F.col("user_id").cast("string")))
    sig = e.select("address", (F.col("sec") - (F.col("event_id") % 13) * 30 * DAY).alias("block_time"))
    k = F.col("k").cast("int")
    tok = e.select("address", F.concat(F.lit("m"), (k % 9).cast("string")).alias("mint"), F.when(k % 9 == 0, "msol").when(k % 9 == 1, "jitosol").when((k % 9 == 2) & (F.col("event_id") % 4 == 0), "bsol").otherwise("other").alias("role"))
    src = F.when(k % 12 == 0, "JUPITER_DCA").when(k % 12 == 1, "HUBBLE").when(k % 12 == 2, "SOLEND").when((k % 12 == 3) & (F.col("event_id") % 5 == 0), "MARGINFI").otherwise("SYSTEM")
    tx = e.select("address", src.alias("source"), F.when(F.col("event_type") == "purchase", "BORROW").when(F.col("event_type") == "click", "REPAY").when(F.col("event_type") == "view", "LOAN_REPAYMENT").otherwise("TRANSFER").alias("type"))
    return features.solana_activity(sig, tok, tx, as_of=AS_OF)


_SOLANA = f"""ev AS (SELECT event_id, 'S' || user_id AS address, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
sol AS (SELECT address, count(*) AS tx_count, min(bt) AS first_ts, count(DISTINCT CASE WHEN bt > {AS_OF} - 365 * 86400 THEN strftime(to_timestamp(bt) AT TIME ZONE 'UTC', '%Y-%m') END) AS active_months_12, count(DISTINCT k % 9) AS token_count, bool_or(k % 9 = 0) AS has_msol, bool_or(k % 9 = 1) AS has_jitosol, bool_or(k % 9 = 2 AND event_id % 4 = 0) AS has_bsol,
 bool_or(k % 12 = 0) AS has_jupiter, bool_or(k % 12 = 1) AS has_kamino, bool_or(k % 12 = 2) AS has_solend, bool_or(k % 12 = 3 AND event_id % 5 = 0) AS has_marginfi, false AS has_marinade, count(*) FILTER (event_type = 'purchase') AS borrow_count, count(*) FILTER (event_type IN ('click', 'view')) AS repay_count
 FROM (SELECT *, sec - (event_id % 13) * 30 * 86400 AS bt FROM ev) GROUP BY address)"""


@query("b14_solana_activity", f"WITH {_SOLANA} SELECT * FROM sol")
def _(s, d) -> DataFrame:
    return _solana(s, d)


# Labels and the store


@query("c1_window_labels", f"""WITH {with_views('lending')} SELECT address, chain, CAST({CUTOFF} AS BIGINT) AS window_start_ts, CAST({WINDOW_END} AS BIGINT) AS window_end_ts, max(CASE WHEN kind = 'liquidation' AND ts BETWEEN {CUTOFF} AND {WINDOW_END} THEN 1 ELSE 0 END) AS label FROM lending GROUP BY address, chain HAVING bool_or(kind = 'borrow' AND ts < {CUTOFF})""")
def _(s, d) -> DataFrame:
    return labels.window_labels(v.lending_events(s, d), cutoff=CUTOFF, end=WINDOW_END)


_STATS = "stats AS (SELECT address || '-' || event_id % 40 AS address, count(*) FILTER (kind = 'borrow') AS borrows, count(*) FILTER (kind = 'repay') AS repays, count(*) FILTER (kind = 'liquidation') AS liquidations FROM lending GROUP BY 1)"


def _stats(s, d):
    """Every lending event, by accounts small enough that all labels occur."""
    account = F.concat(F.col("address"), F.lit("-"), (F.col("event_id") % 40).cast("string"))
    return features.borrower_stats(v.lending_events(s, d).withColumn("address", account))


@query("c2_repay_labels", f"WITH {with_views('lending')}, {_STATS} SELECT address, borrows, repays, liquidations, CASE WHEN liquidations > 0 THEN 0 WHEN repays >= 0.9 * borrows THEN 1 WHEN repays < 0.5 * borrows THEN 0 ELSE -1 END AS label FROM stats WHERE borrows > 0")
def _(s, d) -> DataFrame:
    return labels.repay_labels(_stats(s, d))


@query("c3_balanced_sample", f"""WITH {with_views('lending')}, {_STATS}, l AS (SELECT *, CASE WHEN liquidations > 0 THEN 1 WHEN repays > 0 THEN 0 END AS label FROM stats WHERE borrows > 0)
SELECT address, borrows, repays, liquidations, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(address), address) AS rn FROM l WHERE label IS NOT NULL) WHERE rn <= 20""")
def _(s, d) -> DataFrame:
    return labels.balanced_sample(_stats(s, d), n=20)


def _snapshots(s, d):
    h = v.score_history(s, d).withColumn("valid_at_ts", F.floor(F.col("ts") / DAY) * DAY)
    return h.select("address", "chain", "valid_at_ts", F.lit("v5").alias("feature_set_version"), F.col("score").cast("double").alias("completeness"), F.col("event_id").alias("seq"))


_SNAP = "snap AS (SELECT address, chain, ts // 86400 * 86400 AS valid_at_ts, 'v5' AS feature_set_version, arg_max(CAST(score AS DOUBLE), event_id) AS completeness FROM history GROUP BY ALL)"


@query("c4_put_snapshots", f"WITH {with_views('history')}, {_SNAP} SELECT * FROM snap")
def _(s, d) -> DataFrame:
    x = _snapshots(s, d)
    old = labels.put_snapshots(x.drop("seq").limit(0), x.where("seq < 2000"))
    return labels.put_snapshots(old, x.where("seq >= 2000"))


@query("c4_feature_store", f"""WITH {with_views('history')}, {_SNAP}, req AS (SELECT event_id AS request_id, address, chain, ts - 43200 AS as_of_ts FROM history WHERE event_id < 2000)
SELECT r.request_id, coalesce(s.valid_at_ts, -1) AS valid_at_ts, s.completeness, CAST(3 AS BIGINT) AS versions FROM req r ASOF LEFT JOIN snap s ON r.address = s.address AND r.chain = s.chain AND r.as_of_ts >= s.valid_at_ts""")
def _(s, d) -> DataFrame:
    """Three upserts into the stored features, and the requests of the first of them answered from the store."""
    x = _snapshots(s, d).withColumn("features", F.array(F.col("completeness")))
    store = labels.feature_store(s, scratch_path(s, "snapshots"), partitions=16)
    for i in range(3):
        labels.put(store, x.where((F.col("seq") >= 300 * i) & ((F.col("seq") < 300 * (i + 1)) | F.lit(i == 2))))
    req = v.score_history(s, d).where("event_id < 2000").select("address", "chain", F.col("event_id").alias("request_id"), (F.col("ts") - 43200).alias("as_of_ts"))
    got = labels.stored_as_of(store, req, version="v5").fillna(-1, ["valid_at_ts"])
    return got.select("request_id", "valid_at_ts", "completeness", F.lit(store.version().number).cast("long").alias("versions"))


@query("c5_as_of_join", f"""WITH {with_views('history')}, {_SNAP}, req AS (SELECT event_id AS request_id, address, chain, ts - 43200 AS as_of_ts FROM history)
SELECT r.address, r.chain, r.request_id, r.as_of_ts, coalesce(s.valid_at_ts, -1) AS valid_at_ts, s.completeness FROM req r ASOF LEFT JOIN snap s ON r.address = s.address AND r.chain = s.chain AND r.as_of_ts >= s.valid_at_ts""")
def _(s, d) -> DataFrame:
    x = _snapshots(s, d)
    snap = labels.put_snapshots(x.drop("seq").limit(0), x)
    req = v.score_history(s, d).select("address", "chain", F.col("event_id").alias("request_id"), (F.col("ts") - 43200).alias("as_of_ts"))
    return labels.as_of_join(req, snap, version="v5").fillna(-1, ["valid_at_ts"])


@query("c6_lookahead_gate", f"""WITH {with_views('history')} SELECT event_id, CASE WHEN ts + (event_id % 5 - 3) * 60 > ts THEN 'features after as-of' WHEN ts + (event_id % 7 - 2) * 60 < ts THEN 'outcome before as-of' END AS violation FROM history""")
def _(s, d) -> DataFrame:
    h = v.score_history(s, d)
    rows = h.select("event_id", F.col("ts").alias("as_of_ts"), (F.col("ts") + (F.col("event_id") % 5 - 3) * 60).alias("features_valid_at_ts"), (F.col("ts") + (F.col("event_id") % 7 - 2) * 60).alias("outcome_start_ts"))
    return labels.lookahead_gate(rows).select("event_id", "violation")


@query("c7_temporal_holdout", """WITH d AS (SELECT 'u' || o_custkey || '-' || o_orderkey % 9 AS address, CASE o_orderkey % 4 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'arbitrum' WHEN 2 THEN 'polygon' ELSE 'base' END AS chain, max(CAST(epoch(o_orderdate) AS BIGINT)) AS split_ts FROM orders GROUP BY ALL),
one AS (SELECT address FROM d GROUP BY address HAVING count(*) = 1), t AS (SELECT 'u' || o_custkey || '-' || o_orderkey % 9 AS address, CASE o_orderkey % 4 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'arbitrum' WHEN 2 THEN 'polygon' ELSE 'base' END AS chain, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS label FROM orders GROUP BY ALL)
SELECT d.address, d.chain, d.split_ts, t.label FROM d JOIN one USING (address) JOIN t USING (address, chain) WHERE split_ts >= 850000000 AND split_ts < 940000000""")
def _(s, d) -> DataFrame:
    account = F.concat(F.col("borrower"), F.lit("-"), (F.col("loan_id") % 9).cast("string"))
    o = v.loans(s, d).select(account.alias("address"), v._chain(F.col("loan_id")).alias("chain"), "loan_id", "started", (F.col("status") == "REPAID").cast("int").alias("y"))
    data = o.groupBy("address", "chain").agg(F.max("started").alias("split_ts"))
    return labels.temporal_holdout(data, o.groupBy("address", "chain").agg(F.max("y").alias("label")), start=850000000, cutoff=940000000)


@query("c8_splits", f"""WITH {with_views('predictions')} SELECT id, CASE WHEN id < 5000 THEN 'train' ELSE 'test' END AS by_time, CASE WHEN CAST('0x' || substr(md5('42|' || label || '|' || id), 1, 8) AS BIGINT) % 10000 < 2000 THEN 'test' ELSE 'train' END AS by_class FROM predictions""")
def _(s, d) -> DataFrame:
    p = labels.temporal_split(v.predictions(s, d), at=5000, ts="id").withColumnRenamed("split", "by_time")
    return labels.stratified_split(p).select("id", "by_time", F.col("split").alias("by_class"))


@query("c9_clip_quantile", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.99) AS c FROM orders) SELECT o_orderkey, round(least(o_totalprice, c), 4) AS o_totalprice FROM orders, q")
def _(s, d) -> DataFrame:
    return labels.clip_quantile(v.table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).withColumn("o_totalprice", r("o_totalprice", 4))


@query("c10_dataset_summary", f"WITH {with_views('lending')}, {_STATS}, l AS (SELECT CASE WHEN liquidations > 0 THEN 0 WHEN repays >= 0.9 * borrows THEN 1 WHEN repays < 0.5 * borrows THEN 0 ELSE -1 END AS label FROM stats WHERE borrows > 0) SELECT count(*) AS n_rows, count(*) FILTER (label = 1) AS good, count(*) FILTER (label = 0) AS bad, count(*) FILTER (label = -1) AS excluded FROM l")
def _(s, d) -> DataFrame:
    return labels.dataset_summary(labels.repay_labels(_stats(s, d)))


@query("c11_standard_scale_params", "WITH f AS (SELECT unnest(range(34)) AS feature, unnest(embedding[1:34]) AS x FROM embeddings) SELECT CAST(feature AS INT) AS feature, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(x AS DOUBLE)), 6) AS scale FROM f GROUP BY feature")
def _(s, d) -> DataFrame:
    return labels.standard_scale_params(v.feature_rows(s, d)).select("feature", r("mean").alias("mean"), r("scale").alias("scale"))


# Scoring

#: A small ensemble in the artifact's layout; the published one is not shipped.
DEMO_MODEL = scoring.Ensemble((
    scoring.Tree((1, 3, -1, -1, -1), (2, 4, -1, -1, -1), (0, 5, 0, 0, 0), (0.0, 0.1, 0, 0, 0), (True, False, True, True, True), (0.05, -0.2, 0.3, -0.5, 0.1)),
    scoring.Tree((1, -1, -1), (2, -1, -1), (10, 0, 0), (0.05, 0, 0), (False, True, True), (0.0, 0.25, -0.35)),
    scoring.Tree((1, -1, 3, -1, -1), (2, -1, 4, -1, -1), (20, 0, 30, 0, 0), (-0.02, 0, 0.0, 0, 0), (True, True, False, True, True), (-0.01, 0.4, -0.1, 0.2, -0.3)),
))
_X = "feat AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS x0, CAST(embedding[6] AS DOUBLE) AS x5, CAST(embedding[11] AS DOUBLE) AS x10, CAST(embedding[21] AS DOUBLE) AS x20, CAST(embedding[31] AS DOUBLE) AS x30 FROM embeddings)"
_TREES = """trees AS (SELECT vec_id, CASE WHEN x0 IS NULL OR x0 < 0 THEN CASE WHEN x5 < 0.1 THEN -0.5 ELSE 0.1 END ELSE 0.3 END AS m1, CASE WHEN x10 < 0.05 THEN 0.25 ELSE -0.35 END AS m2, CASE WHEN x20 < -0.02 THEN 0.4 ELSE CASE WHEN x30 < 0 THEN 0.2 ELSE -0.3 END END AS m3,
 CASE WHEN x0 IS NULL OR x0 < 0 THEN -0.25 ELSE 0.25 END AS c0, CASE WHEN x0 IS NULL OR x0 < 0 THEN CASE WHEN x5 < 0.1 THEN -0.3 ELSE 0.3 END ELSE 0 END AS c5, CASE WHEN x10 < 0.05 THEN 0.25 ELSE -0.35 END AS c10, CASE WHEN x20 < -0.02 THEN 0.41 ELSE -0.09 END AS c20, CASE WHEN x20 < -0.02 THEN 0 WHEN x30 < 0 THEN 0.3 ELSE -0.2 END AS c30 FROM feat)"""


def _gapped(s, d):
    """Feature rows, every tenth without its first number."""
    gap = F.when(F.col("vec_id") % 10 == 0, F.concat(F.array(F.lit(None).cast("double")), F.slice("features", 2, 33))).otherwise(F.col("features"))
    return v.feature_rows(s, d).withColumn("features", gap)


def _scored(s, d):
    return scoring.score_trees(_gapped(s, d), DEMO_MODEL)


@query("d1_score_trees", f"WITH {_X}, {_TREES} SELECT vec_id, round(CAST(m1 + m2 + m3 AS DOUBLE), 6) AS margin, round(CAST(c0 AS DOUBLE), 6) AS c0, round(CAST(c5 AS DOUBLE), 6) AS c5, round(CAST(c10 AS DOUBLE), 6) AS c10, round(CAST(c20 AS DOUBLE), 6) AS c20, round(CAST(c30 AS DOUBLE), 6) AS c30 FROM trees")
def _(s, d) -> DataFrame:
    c = F.col("contributions")
    return _scored(s, d).select("vec_id", r("margin").alias("margin"), *(r(c[i]).alias(f"c{i}") for i in (0, 5, 10, 20, 30)))


_MEAN, _SCALE, _COEF = [0.01 * i for i in range(34)], [0.0 if i == 7 else 0.5 + 0.01 * i for i in range(34)], [(-1) ** i * 0.05 * (i % 5) for i in range(34)]


@query("d2_score_linear", "WITH f AS (SELECT vec_id, unnest(range(34)) AS i, unnest(embedding[1:34]) AS x FROM embeddings) SELECT vec_id, round(-0.5 + sum((CAST(x AS DOUBLE) - 0.01 * i) / (CASE WHEN i = 7 THEN 1.0 ELSE 0.5 + 0.01 * i END) * (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * 0.05 * (i % 5)), 5) AS margin FROM f GROUP BY vec_id")
def _(s, d) -> DataFrame:
    return scoring.score_linear(v.feature_rows(s, d), mean=_MEAN, scale=_SCALE, coef=_COEF, intercept=-0.5).select("vec_id", r("margin", 5).alias("margin"))


_GRID = [0.005 * i for i in range(201)]


@query("d3_calibrate", f"WITH {with_views('predictions')} SELECT id, round(CASE WHEN p >= 1 THEN 1 ELSE (i * 0.005) * (i * 0.005) + (p - i * 0.005) / 0.005 * (((i + 1) * 0.005) * ((i + 1) * 0.005) - (i * 0.005) * (i * 0.005)) END, 4) AS calibrated FROM (SELECT id, p, least(floor(p / 0.005), 199) AS i FROM predictions)")
def _(s, d) -> DataFrame:
    return v.predictions(s, d).select("id", r(scoring.calibrate(F.col("p"), _GRID, [x * x for x in _GRID]), 4).alias("calibrated"))


_GRADE = "CASE WHEN score >= 774 THEN 'A' WHEN score >= 643 THEN 'B' WHEN score >= 578 THEN 'C' WHEN score >= 452 THEN 'D' ELSE 'F' END"
_POINTS = [(300, 0), *((x, 10 * (i + 1)) for i, x in enumerate(scoring.DECILES)), (850, 100)]
_PCT = "CAST(least(greatest(floor(CASE WHEN score <= 300 THEN 0 " + " ".join(f"WHEN score <= {x1} THEN {y0} + (score - {x0}) / {x1 - x0}.0 * {y1 - y0}" for (x0, y0), (x1, y1) in zip(_POINTS, _POINTS[1:])) + " ELSE 100 END + 0.5), 1), 100) AS BIGINT)"


@query("d4_pd_to_score", f"WITH {with_views('predictions')}, q AS (SELECT id, least(greatest(p, 1e-4), 1 - 1e-4) AS q FROM predictions) SELECT id, CAST(floor(least(greatest(196.57757217918277 - 104.16637676749855 * ln(q / (1 - q)), 300), 850) + 0.5) AS BIGINT) AS score FROM q")
def _(s, d) -> DataFrame:
    return v.predictions(s, d).select("id", scoring.pd_to_score(F.col("p")).alias("score"))


@query("d5_grade", f"WITH {with_views('wallets')} SELECT address, score, {_GRADE} AS grade, CASE WHEN score >= 774 THEN 'excellent' WHEN score >= 643 THEN 'good' WHEN score >= 578 THEN 'fair' ELSE 'poor' END AS tier FROM wallets")
def _(s, d) -> DataFrame:
    return v.wallets(s, d).select("address", "score", scoring.grade(F.col("score")).alias("grade"), scoring.tier(F.col("score")).alias("tier"))


@query("d6_score_percentile", f"WITH {with_views('wallets')} SELECT address, score, {_PCT} AS percentile FROM wallets")
def _(s, d) -> DataFrame:
    return v.wallets(s, d).select("address", "score", scoring.score_percentile(F.col("score")).alias("percentile"))


@query("d7_score_gates", f"""WITH {with_views('wallets')}, g AS (SELECT address, score AS m, {_GRADE} AS g, {_PCT} AS p, c_custkey % 5 = 0 AS new_wallet, c_custkey % 5 <> 0 AND c_custkey % 3 = 0 AS no_borrow_history FROM wallets)
SELECT address, new_wallet, no_borrow_history, CASE WHEN new_wallet THEN 300 WHEN no_borrow_history THEN 0 ELSE m END AS score, CASE WHEN new_wallet OR no_borrow_history THEN 'F' ELSE g END AS grade, CASE WHEN new_wallet THEN 1 WHEN no_borrow_history THEN 0 ELSE p END AS percentile FROM g""")
def _(s, d) -> DataFrame:
    k = F.col("c_custkey")
    w = v.wallets(s, d).withColumns({"tx_count": F.when(k % 5 == 0, 0).otherwise(9), "first_ts": F.when(k % 5 == 0, None).otherwise(1000), "total_borrows": F.when(k % 3 == 0, 0).otherwise(2), "grade": scoring.grade(F.col("score")), "percentile": scoring.score_percentile(F.col("score"))})
    return scoring.score_gates(w).select("address", "new_wallet", "no_borrow_history", "score", "grade", "percentile")


def _bar(expr: str, scale: float) -> str:
    return f"CAST(least(greatest(floor(100 / (1 + exp(({expr}) / {scale})) + 0.5), 0), 100) AS BIGINT)"


_S = {k: x[0] for k, x in scoring.FAMILIES.items()}


@query("d8_factor_bars", f"WITH {_X}, {_TREES} SELECT vec_id, {_bar('CAST(c10 + c30 AS DOUBLE)', _S['Lending History'])} AS lending, {_bar('CAST(c0 + c5 AS DOUBLE)', _S['Wallet History'])} AS history, {_bar('CAST(c20 AS DOUBLE)', _S['DeFi Activity'])} AS defi, 50 AS portfolio FROM trees")
def _(s, d) -> DataFrame:
    f = F.col("factors")
    return scoring.factor_bars(_scored(s, d)).select("vec_id", f[0]["bar"].alias("lending"), f[1]["bar"].alias("history"), f[2]["bar"].alias("defi"), f[3]["bar"].alias("portfolio"))


_LABELLED = [("c0", 0), ("c5", 5), ("c10", 10), ("c20", 20), ("c30", 30)]


@query("d9_top_contributions", f"""WITH {_X}, {_TREES}, l AS ({' UNION ALL '.join(f"SELECT vec_id, '{scoring.LABELS[i]}' AS label, -CAST({c} AS DOUBLE) AS impact, {i} AS pos FROM trees" for c, i in _LABELLED)}),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, impact > 0 ORDER BY abs(round(impact, 9)) DESC, pos) AS rn FROM l WHERE impact <> 0)
SELECT vec_id, string_agg(label, '|' ORDER BY CASE WHEN impact > 0 THEN 0 ELSE 1 END, rn) AS top FROM k WHERE rn <= 3 GROUP BY vec_id""")
def _(s, d) -> DataFrame:
    x = _scored(s, d).withColumn("contributions", F.transform("contributions", lambda c: F.round(c, 9)))
    return scoring.top_contributions(x).select("vec_id", F.array_join(F.transform("top_contributions", lambda t: t["label"]), "|").alias("top"))


@query("d10_weakest_factors", f"""WITH {_X}, {_TREES}, b AS (SELECT vec_id, {_bar('CAST(c10 + c30 AS DOUBLE)', _S['Lending History'])} AS b0, {_bar('CAST(c0 + c5 AS DOUBLE)', _S['Wallet History'])} AS b1, {_bar('CAST(c20 AS DOUBLE)', _S['DeFi Activity'])} AS b2, 50 AS b3 FROM trees),
l AS (SELECT vec_id, unnest([b0, b1, b2, b3]) AS bar, unnest([0, 1, 2, 3]) AS i, unnest(['Lending History', 'Wallet History', 'DeFi Activity', 'Portfolio & Identity']) AS name FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY bar, i) AS rn FROM l)
SELECT vec_id, string_agg(name, '|' ORDER BY rn) AS weakest FROM k WHERE rn <= 3 GROUP BY vec_id""")
def _(s, d) -> DataFrame:
    return scoring.weakest_factors(scoring.factor_bars(_scored(s, d))).select("vec_id", F.array_join("weakest", "|").alias("weakest"))


_I = "CAST({} AS INT)"


@query("d11_score_solana", f"""WITH {_SOLANA}, f AS (SELECT *, floor(least(greatest(({AS_OF} - first_ts) / 86400.0 / 730 * 50, 0), 50) + least(tx_count / 500.0 * 30, 30) + least(active_months_12 / 10.0 * 20, 20) + 0.5) AS h,
 least(floor(least(token_count * 1.7 / 10 * 40, 40) + least(token_count / 10.0 * 20, 20) + least(15 * has_msol::INT + 15 * has_jitosol::INT + 10 * has_bsol::INT, 40) + 0.5), 100) AS p,
 least(20 * has_jupiter::INT + 25 * has_kamino::INT + 20 * has_solend::INT + 20 * has_marginfi::INT + CASE WHEN borrow_count > 0 THEN floor(least(1.0, repay_count / borrow_count) * 20 + 0.5) ELSE 0 END, 100) AS a,
 least(15 * (has_jupiter::INT + has_kamino::INT + has_solend::INT + has_marginfi::INT + has_msol::INT + has_jitosol::INT), 100) AS v FROM sol),
g AS (SELECT *, floor(300 + (h * 0.30 + p * 0.25 + a * 0.25 + v * 0.20) / 100 * 550 + 0.5) AS rs FROM f)
SELECT address, CAST(CASE WHEN borrow_count = 0 THEN 0 ELSE rs END AS BIGINT) AS score, CASE WHEN borrow_count = 0 THEN 'F' WHEN rs >= 750 THEN 'A' WHEN rs >= 670 THEN 'B' WHEN rs >= 580 THEN 'C' WHEN rs >= 500 THEN 'D' ELSE 'F' END AS grade,
 CAST(CASE WHEN borrow_count = 0 THEN 0 WHEN rs >= 750 THEN 90 WHEN rs >= 670 THEN 75 WHEN rs >= 580 THEN 55 WHEN rs >= 500 THEN 35 ELSE 15 END AS BIGINT) AS percentile FROM g""")
def _(s, d) -> DataFrame:
    x = _solana(s, d).withColumn("sol_balance", F.col("token_count") * 1.7)
    return scoring.score_solana(x, as_of=AS_OF).select("address", "score", "grade", "percentile")


#: An ensemble over the wallets' own features: portfolio, ETH, protocols and age, liquidations, borrow velocity.
WALLET_MODEL = scoring.Ensemble((
    scoring.Tree((1, -1, -1), (2, -1, -1), (24, 0, 0), (1000.0, 0, 0), (True, True, True), (0.0, 0.4, -0.3)),
    scoring.Tree((1, -1, -1), (2, -1, -1), (27, 0, 0), (0.5, 0, 0), (True, True, True), (0.05, 0.3, -0.2)),
    scoring.Tree((1, 3, -1, -1, -1), (2, 4, -1, -1, -1), (20, 0, 0, 0, 0), (2.0, 20.0, 0, 0, 0), (True, True, True, True, True), (-0.1, 0.2, -0.4, 0.5, 0.1)),
    scoring.Tree((1, -1, -1), (2, -1, -1), (19, 0, 0), (0.5, 0, 0), (True, True, True), (0.0, -0.5, 0.6)),
    scoring.Tree((1, -1, -1), (2, -1, -1), (30, 0, 0), (0.2, 0, 0), (True, True, True), (0.02, -0.1, 0.25)),
))
_LINE = [0.01 + 0.8 * x for x in _GRID]


def wallet_sources(s, d, w: DataFrame) -> dict:
    """What the scorer takes of the wallets w besides their histories, each source from a table of its own."""
    n = F.substring("address", 2, 9).cast("int")
    failed = lambda cond, *names: F.when(cond, F.map_from_arrays(F.array(*(F.lit(x) for x in names)), F.array(*(F.lit("down") for _ in names))))
    errors = w.select("address", "chain", F.coalesce(failed(n % 17 == 0, "etherscan", "alchemy", "aave", "compound"), failed(n % 11 == 0, "etherscan")).alias("errors")).where("errors is not null")
    good = w.where(n % 34 == 0).select(
        "address", "chain", (600 + n % 50).cast("long").alias("score"), (610 + n % 50).cast("long").alias("model_score"), F.lit("C").alias("grade"), F.lit(40).cast("long").alias("percentile"), F.lit(0.25).alias("calibrated_pd"),
        F.lit(0.04).alias("penalty"), F.lit(False).alias("flagged"), F.lit(1.0).alias("completeness"), F.array().cast("array<string>").alias("degraded_sources"), F.array(F.lit("Aave")).alias("protocols_used"), F.lit("old").alias("model_version"),
    )
    k = F.col("s_suppkey")
    accounts = v.table(s, d, "supplier").select(F.concat(F.lit("w"), k.cast("string")).alias("address"), v._chain(k).alias("chain"), F.when(k % 3 == 0, "0x0").otherwise("0xde0b6b3a7640000").alias("balance_hex"), F.lit("0x").alias("code"), F.lit("0x0").alias("resolver"))
    held = v.balances(s, d).withColumn("address", F.concat(F.lit("w"), F.substring("address", 2, 9)))
    tokens = s.createDataFrame(_TOKENS, "contract string, role string, decimals int, price double")
    return {"calibration": (_GRID, _LINE), "errors": errors, "known_good": good, "model_version": "own", "balances": held, "tokens": tokens, "accounts": accounts, "liquidity": w.where(n % 3 == 0)}


def scored_wallets(s, d) -> DataFrame:
    """Every wallet of the sample tables end to end."""
    t = v.transfers(s, d)
    w = t.select("address", "chain").distinct()
    return wallets.score_wallets(w, t, v.lending_events(s, d), WALLET_MODEL, as_of=AS_OF, **wallet_sources(s, d, w))


_D12 = f"""{_WIDE}, tok(contract, role, decimals, price) AS (VALUES {', '.join(str(t) for t in _TOKENS)}),
bal AS (SELECT 'w' || substr(address, 2) AS address, chain, contract, raw FROM ({v.SQL['balances'].removeprefix('balances AS (').removesuffix(')')}) WHERE raw > 0),
port AS (SELECT address, chain, sum(coalesce(raw / power(10, decimals) * price, 0)) AS usd, coalesce(bool_or(role = 'lido'), false) AS staked, coalesce(bool_or(role = 'aave_v3' OR role = 'aave_v2' AND chain = 'ethereum'), false) AS aave, coalesce(bool_or(role = 'compound' AND chain = 'ethereum'), false) AS comp FROM bal LEFT JOIN tok USING (contract) GROUP BY address, chain),
acc AS (SELECT 'w' || s_suppkey AS address, {v._c('s_suppkey')} AS chain, s_suppkey % 3 <> 0 AS eth FROM supplier),
x AS (SELECT w.*, coalesce(usd, 0) AS usd, coalesce(staked, false) AS staked, coalesce(aave, false) AS aave, coalesce(comp, false) AS comp, coalesce(eth, false) AS eth, aave_borrows + compound_borrows AS bo, aave_liquidations + compound_liquidations AS li FROM wide w LEFT JOIN port USING (address, chain) LEFT JOIN acc USING (address, chain)),
y AS (SELECT *, (aave OR aave_borrows > 0)::INT + (comp OR compound_borrows > 0)::INT + (n % 3 = 0)::INT + staked::INT AS protocols FROM x),
m AS (SELECT *, CAST(CASE WHEN usd < 1000 THEN 0.4 ELSE -0.3 END + CASE WHEN eth THEN -0.2 ELSE 0.3 END + CASE WHEN protocols < 2 THEN CASE WHEN wallet_age_days < 20 THEN 0.5 ELSE 0.1 END ELSE -0.4 END + CASE WHEN li > 0 THEN 0.6 ELSE -0.5 END + CASE WHEN least(bo / greatest(wallet_age_days, 1), 50) < 0.2 THEN -0.1 ELSE 0.25 END AS DOUBLE) AS margin FROM y),
pd AS (SELECT *, 0.01 + 0.8 / (1 + exp(-margin)) AS pd FROM m), ms AS (SELECT *, CAST(floor(least(greatest(196.57757217918277 - 104.16637676749855 * ln(pd / (1 - pd)), 300), 850) + 0.5) AS BIGINT) AS score FROM pd),
gr AS (SELECT *, {_GRADE} AS g, {_PCT} AS pct FROM ms),
dir AS (SELECT address, chain, CASE WHEN from_addr = address THEN to_addr ELSE from_addr END AS other, CASE WHEN from_addr = address THEN 1 ELSE 0 END AS o FROM transfers WHERE from_addr = address AND to_addr <> '' OR to_addr = address AND from_addr <> ''),
wp AS (SELECT address, chain, other, sum(o) AS sent, count(*) AS n FROM dir GROUP BY ALL), ws AS (SELECT address, chain, CASE WHEN count(*) FILTER (sent > 0 AND sent < n) >= 1 AND coalesce(sum(n * 0.6e0) FILTER (sent > 0 AND sent < n), 0) >= 4 THEN least(1, coalesce(sum(n * 0.6e0) FILTER (sent > 0 AND sent < n), 0) / sum(n)) ELSE 0 END AS wash FROM wp GROUP BY address, chain),
fu AS (SELECT address, chain, from_addr AS funder FROM (SELECT *, row_number() OVER (PARTITION BY address, chain ORDER BY ts, hash) AS rn FROM transfers WHERE to_addr = address AND from_addr <> '') WHERE rn = 1), sy AS (SELECT address, chain, least(1.0, (count(*) OVER (PARTITION BY funder) - 1) / 10) AS sybil FROM fu),
bc AS (SELECT address, chain, ts, count(*) OVER (PARTITION BY address, chain ORDER BY ts RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS k FROM transfers),
bu AS (SELECT address, chain, CASE WHEN count(*) < 4 THEN 0 WHEN max(ts) - min(ts) <= 604800 THEN 1 ELSE least(greatest((max(k) - count(*) * 604800 / (max(ts) - min(ts))) / count(*), 0), 1) END AS burst FROM bc GROUP BY address, chain),
ir AS (SELECT address, chain, count(*) FILTER (hit) / count(*) AS fast FROM (SELECT b.address, b.chain, EXISTS (SELECT 1 FROM lending r WHERE r.kind = 'repay' AND r.address = b.address AND r.chain = b.chain AND r.ts >= b.ts AND (r.ts - b.ts <= 60 OR r.block - b.block <= 1)) AS hit FROM lending b WHERE b.kind = 'borrow') GROUP BY address, chain),
z AS (SELECT gr.*, bo = 0 AS bare, CASE WHEN bo = 0 THEN 0 ELSE 1 - (1 - coalesce(wash, 0)) * (1 - coalesce(sybil, 0) * 0.8) * (1 - coalesce(burst, 0) * 0.7) * (1 - coalesce(fast, 0) * 0.5) END AS penalty FROM gr LEFT JOIN ws USING (address, chain) LEFT JOIN sy USING (address, chain) LEFT JOIN bu USING (address, chain) LEFT JOIN ir USING (address, chain)),
e AS (SELECT *, CASE WHEN bare THEN 0 ELSE score END AS model_score, CASE WHEN bare THEN 0 ELSE greatest(300, score - floor(250 * penalty + 0.5)) END AS own, n % 34 = 0 AS kept FROM z)"""


@query("d12_score_wallets", f"""WITH {_D12} SELECT address, chain, CAST(CASE WHEN kept THEN 600 + n % 50 ELSE own END AS BIGINT) AS score, CAST(CASE WHEN kept THEN 610 + n % 50 ELSE model_score END AS BIGINT) AS model_score, CASE WHEN kept THEN 'C' WHEN bare THEN 'F' ELSE g END AS grade, CAST(CASE WHEN kept THEN 40 WHEN bare THEN 0 ELSE pct END AS BIGINT) AS percentile,
 CASE WHEN kept THEN 0.25e0 WHEN NOT bare THEN round(pd, 6) END AS calibrated_pd, CASE WHEN kept THEN 0.04e0 ELSE round(CAST(penalty AS DOUBLE), 6) END AS penalty, penalty >= 0.5 AND NOT kept AS flagged, CASE WHEN kept THEN 1.0 WHEN n % 17 = 0 THEN 0.1 WHEN n % 11 = 0 THEN 0.6 ELSE 1.0 END::DOUBLE AS completeness, CASE WHEN kept THEN '' WHEN n % 17 = 0 THEN 'etherscan,alchemy,aave,compound' WHEN n % 11 = 0 THEN 'etherscan' ELSE '' END AS degraded_sources, kept AS last_known_good,
 CAST(CASE WHEN kept THEN NULL WHEN bare THEN 0 ELSE 4 END AS INT) AS n_factors, CASE WHEN kept THEN 'old' WHEN bare THEN 'unknown' ELSE 'own' END AS model_version, CASE WHEN kept THEN 'Aave' ELSE concat_ws(',', CASE WHEN aave OR aave_borrows > 0 OR aave_repays > 0 THEN 'Aave' END, CASE WHEN comp OR compound_borrows > 0 OR compound_repays > 0 THEN 'Compound' END, CASE WHEN n % 3 = 0 THEN 'Uniswap' END, CASE WHEN staked THEN CASE WHEN chain = 'ethereum' THEN 'Lido' ELSE 'Lido (wstETH)' END END) END AS protocols_used FROM e""")
def _(s, d) -> DataFrame:
    """Every wallet end to end: features, model, calibration, gates, detectors, penalty; grade and percentile stay the model's."""
    out = scored_wallets(s, d)
    return out.select("address", "chain", "score", "model_score", "grade", "percentile", r("calibrated_pd").alias("calibrated_pd"), r("penalty").alias("penalty"), "flagged", "completeness", F.array_join("degraded_sources", ",").alias("degraded_sources"), "last_known_good", F.size("factors").alias("n_factors"), "model_version", F.array_join("protocols_used", ",").alias("protocols_used"))


# Backtest

_W = f"{with_views('predictions')}, w AS (SELECT *, CASE WHEN label = 1 THEN 0.0909 / t ELSE (1 - 0.0909) / (1 - t) END AS weight FROM predictions, (SELECT avg(label) AS t FROM predictions))"


def _weighted(s, d):
    return backtest.base_rate_weights(v.predictions(s, d), target=0.0909)


@query("e1_base_rate_weights", f"WITH {_W} SELECT id, round(weight, 6) AS weight FROM w")
def _(s, d) -> DataFrame:
    return _weighted(s, d).select("id", r("weight").alias("weight"))


def _rank_sql(src: str, keys: str, p: str) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""t AS (SELECT {k}{p} AS p, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE weight END) AS neg FROM {src} GROUP BY {k}{p}),
c AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER ({part} ORDER BY p DESC) AS up, sum(neg) OVER ({part} ORDER BY p DESC) AS un FROM t),
m AS (SELECT {k}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) ELSE 0.5 END AS roc_auc, CASE WHEN sum(pos) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * up / (up + un) ELSE 0 END) / sum(pos) ELSE 0 END AS pr_auc FROM c {'GROUP BY ' + keys if keys else ''})"""


@query("e2_e3_ranking", f"WITH {_W}, {_rank_sql('w', '', 'p')} SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM m")
def _(s, d) -> DataFrame:
    return backtest.ranking(_weighted(s, d)).select(r("roc_auc").alias("roc_auc"), r("pr_auc").alias("pr_auc"))


@query("e2_e3_ranking_ties", f"WITH {_W}, {_rank_sql('w', 'chain', 'floor(p * 100) / 100')} SELECT chain, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM m")
def _(s, d) -> DataFrame:
    x = _weighted(s, d).withColumn("p", F.floor(F.col("p") * 100) / 100)
    return backtest.ranking(x, ["chain"]).select("chain", r("roc_auc").alias("roc_auc"), r("pr_auc").alias("pr_auc"))


@query("e4_brier", f"WITH {_W} SELECT round(sum(weight * (p - label) * (p - label)) / sum(weight), 6) AS brier FROM w")
def _(s, d) -> DataFrame:
    return backtest.brier(_weighted(s, d)).select(r("brier").alias("brier"))


_LOW = "lw AS (SELECT * REPLACE (p * 0.8 AS p) FROM w)"  # no prediction above 0.8, so the last bins are empty
_REL = "rel AS (SELECT b.range AS bin, count(w.p) AS n, coalesce(sum(weight), 0) AS w, coalesce(sum(weight * p) / sum(weight), 0) AS mean_p, coalesce(sum(weight * label) / sum(weight), 0) AS observed FROM range(10) b LEFT JOIN lw w ON least(9, floor(w.p * 10)) = b.range GROUP BY b.range)"


@query("e5_reliability", f"WITH {_W}, {_LOW}, {_REL} SELECT bin, n, round(w, 4) AS w, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed FROM rel")
def _(s, d) -> DataFrame:
    return backtest.reliability(_weighted(s, d).withColumn("p", F.col("p") * 0.8)).select("bin", "n", r("w", 4).alias("w"), r("mean_p").alias("mean_p"), r("observed").alias("observed"))


@query("e6_ece", f"WITH {_W}, {_LOW}, {_REL} SELECT round(sum(w * abs(mean_p - observed)) / sum(w), 6) AS ece FROM rel")
def _(s, d) -> DataFrame:
    return backtest.ece(_weighted(s, d).withColumn("p", F.col("p") * 0.8)).select(r("ece").alias("ece"))


@query("e7_operating_point", f"""WITH {_W}, c AS (SELECT sum(weight) FILTER (score < 578 AND label = 1) AS tp, sum(weight) FILTER (score < 578 AND label = 0) AS fp, sum(weight) FILTER (label = 1) AS pos, sum(weight) FILTER (label = 0) AS neg FROM w)
SELECT round(tp / pos, 6) AS recall, round(fp / neg, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round((tp + fp) / (pos + neg), 6) AS flagged FROM c""")
def _(s, d) -> DataFrame:
    return backtest.operating_point(_weighted(s, d), cutoff=578).select(*(r(c).alias(c) for c in ("recall", "fpr", "precision", "flagged")))


_SLICES = f"s AS (SELECT *, unnest(['chain:' || chain, CASE WHEN age < 180 THEN 'age<180d' ELSE 'age>=180d' END, CASE WHEN borrows <= 3 THEN 'borrows<=3' ELSE 'borrows>3' END]) AS slice FROM w), {_rank_sql('s', 'slice', 'p')}"


@query("e8_slice_metrics", f"WITH {_W}, {_SLICES}, n AS (SELECT slice, count(*) AS n, sum(label) AS positives FROM s GROUP BY slice) SELECT slice, n, CAST(positives AS BIGINT) AS positives, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM m JOIN n USING (slice)")
def _(s, d) -> DataFrame:
    return backtest.slice_metrics(_weighted(s, d)).select("slice", "n", "positives", r("roc_auc").alias("roc_auc"), r("pr_auc").alias("pr_auc"))


_SLICED = _rank_sql("s", "slice", "p").replace("t AS (SELECT", "st AS (SELECT").replace("c AS (SELECT", "sc AS (SELECT").replace("FROM t)", "FROM st)").replace("m AS (SELECT", "sm AS (SELECT").replace("FROM c ", "FROM sc ")
_E9 = f"""{_W}, {_REL.replace("lw w ON", "w ON")}, {_rank_sql('w', '', 'p')}, s AS (SELECT *, unnest(['chain:' || chain, CASE WHEN age < 180 THEN 'age<180d' ELSE 'age>=180d' END, CASE WHEN borrows <= 3 THEN 'borrows<=3' ELSE 'borrows>3' END]) AS slice FROM w), {_SLICED},
op AS (SELECT sum(weight) FILTER (score < 578 AND label = 1) AS tp, sum(weight) FILTER (score < 578 AND label = 0) AS fp, sum(weight) FILTER (label = 1) AS pos, sum(weight) FILTER (label = 0) AS neg FROM w)"""


@query("e9_run_backtest", f"""WITH {_E9} SELECT 'n_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM w UNION ALL SELECT 'positives', CAST(sum(label) AS DOUBLE) FROM w UNION ALL SELECT 'roc_auc', round(roc_auc, 6) FROM m UNION ALL SELECT 'pr_auc', round(pr_auc, 6) FROM m
UNION ALL SELECT 'brier', round(sum(weight * (p - label) * (p - label)) / sum(weight), 6) FROM w UNION ALL SELECT 'ece', round(sum(w * abs(mean_p - observed)) / sum(w), 6) FROM rel
UNION ALL SELECT 'recall', round(tp / pos, 6) FROM op UNION ALL SELECT 'fpr', round(fp / neg, 6) FROM op UNION ALL SELECT 'precision', round(tp / (tp + fp), 6) FROM op UNION ALL SELECT 'flagged', round((tp + fp) / (pos + neg), 6) FROM op UNION ALL SELECT 'pr_auc ' || slice, round(pr_auc, 6) FROM sm""")
def _(s, d) -> DataFrame:
    """The whole report as (metric, value)."""
    rows = v.predictions(s, d).withColumns({"as_of_ts": F.lit(CUTOFF), "features_valid_at_ts": F.lit(CUTOFF), "outcome_start_ts": F.lit(CUTOFF)})
    scored = rows.drop("score")  # the report scores its rows itself
    got = backtest.run_backtest(scored, lambda x: x.withColumn("score", 850 - round_half_up(F.col("p") * 550)), model_version="sample")
    one = [("head", "n_rows"), ("head", "positives"), ("ranking", "roc_auc"), ("ranking", "pr_auc"), ("brier", "brier"), ("ece", "ece"), ("operating_point", "recall"), ("operating_point", "fpr"), ("operating_point", "precision"), ("operating_point", "flagged")]
    out = got["slices"].select(F.concat(F.lit("pr_auc "), F.col("slice")).alias("metric"), r("pr_auc").alias("value"))
    for table, metric in one:
        out = out.unionByName(got[table].select(F.lit(metric).alias("metric"), r(F.col(metric).cast("double")).alias("value")))
    return out


@query("e10_weakest_slice", f"WITH {_W}, {_SLICES} SELECT slice, round(pr_auc, 6) AS pr_auc FROM m ORDER BY m.pr_auc, slice LIMIT 1")
def _(s, d) -> DataFrame:
    return backtest.weakest_slice(backtest.slice_metrics(_weighted(s, d))).select("slice", r("pr_auc").alias("pr_auc"))


@query("d15_score_anchors", f"WITH {with_views('predictions')} SELECT round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.9), 6) AS p90, round(quantile_cont(score, 0.3), 6) AS d3, round(quantile_cont(score, 0.9), 6) AS d9 FROM predictions")
def _(s, d) -> DataFrame:
    return backtest.score_anchors(v.predictions(s, d)).select(r("p10").alias("p10"), r("p50").alias("p50"), r("p90").alias("p90"), r(F.col("deciles")[2]).alias("d3"), r(F.col("deciles")[8]).alias("d9"))


@query("d16_classification_report", f"""WITH {with_views('predictions')}, c AS (SELECT count(*) FILTER (p >= 0.5 AND label = 1) AS tp, count(*) FILTER (p >= 0.5 AND label = 0) AS fp, count(*) FILTER (p < 0.5 AND label = 1) AS fn, count(*) FILTER (p < 0.5 AND label = 0) AS tn FROM predictions)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def _(s, d) -> DataFrame:
    return backtest.classification_report(v.predictions(s, d)).select("tp", "fp", "fn", "tn", *(r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


# Integrity

_DIR = "dir AS (SELECT address, chain, CASE WHEN from_addr = address THEN to_addr ELSE from_addr END AS other, CASE WHEN from_addr = address THEN 1 ELSE 0 END AS o FROM transfers WHERE from_addr = address AND to_addr <> '' OR to_addr = address AND from_addr <> '')"


@query("f1_wash_trading", f"""WITH {with_views('transfers')}, {_DIR}, p AS (SELECT address, chain, other, sum(o) AS sent, count(*) AS n, CASE WHEN CAST(substr(other, 2) AS INT) % 3 = 0 THEN 1.0e0 ELSE 0.6e0 END AS wt FROM dir GROUP BY address, chain, other),
g AS (SELECT address, chain, sum(n) AS directed, count(*) FILTER (sent > 0 AND sent < n) AS partners, coalesce(sum(n * wt) FILTER (sent > 0 AND sent < n), 0) AS weighted FROM p GROUP BY address, chain)
SELECT address, chain, CAST(directed AS BIGINT) AS directed, partners, round(weighted, 6) AS weighted, round(CASE WHEN partners >= 1 AND weighted >= 4 THEN least(1, weighted / directed) ELSE 0 END, 6) AS severity FROM g""")
def _(s, d) -> DataFrame:
    t = v.transfers(s, d)
    other = F.when(F.col("from_addr") == F.col("address"), F.col("to_addr")).otherwise(F.col("from_addr"))
    related = t.select("address", "chain", other.alias("other")).where(F.substring("other", 2, 9).cast("int") % 3 == 0).distinct()
    return integrity.wash_trading(t, related).withColumns({"weighted": r("weighted"), "severity": r("severity")})


@query("f2_sybil_funding", f"""WITH {with_views('transfers')}, f AS (SELECT address, chain, from_addr AS funder FROM (SELECT *, row_number() OVER (PARTITION BY address, chain ORDER BY ts, hash) AS rn FROM transfers WHERE to_addr = address AND from_addr <> '') WHERE rn = 1)
SELECT address, chain, funder, count(*) OVER (PARTITION BY funder) - 1 AS cohort, round(least(1.0, (count(*) OVER (PARTITION BY funder) - 1) / 10), 6) AS severity FROM f""")
def _(s, d) -> DataFrame:
    return integrity.sybil_funding(v.transfers(s, d)).withColumn("severity", r("severity"))


@query("f3_burst_timing", f"""WITH {with_views('transfers')}, c AS (SELECT address, chain, ts, count(*) OVER (PARTITION BY address, chain ORDER BY ts RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS k FROM transfers),
g AS (SELECT address, chain, count(*) AS n, max(k) AS peak, max(ts) - min(ts) AS span FROM c GROUP BY address, chain)
SELECT address, chain, n, peak, span, round(CASE WHEN n < 4 THEN 0 WHEN span <= 604800 THEN 1 ELSE least(greatest((peak - n * 604800 / span) / n, 0), 1) END, 6) AS severity FROM g""")
def _(s, d) -> DataFrame:
    return integrity.burst_timing(v.transfers(s, d)).withColumn("severity", r("severity"))


@query("f4_instant_repay", f"""WITH {with_views('lending')} SELECT address, chain, count(*) AS borrows, count(*) FILTER (hit) AS instant, round(count(*) FILTER (hit) / count(*), 6) AS severity
FROM (SELECT b.address, b.chain, EXISTS (SELECT 1 FROM lending r WHERE r.kind = 'repay' AND r.address = b.address AND r.chain = b.chain AND r.ts >= b.ts AND (r.ts - b.ts <= 21600 OR r.block - b.block <= 2400)) AS hit FROM lending b WHERE b.kind = 'borrow') GROUP BY address, chain""")
def _(s, d) -> DataFrame:
    return integrity.instant_repay(v.lending_events(s, d), seconds=21600, blocks=2400).withColumn("severity", r("severity"))


_SIG = "sig AS (SELECT event_id, (event_id % 11) / 10e0 AS wash_trading, (event_id % 7) / 10e0 AS sybil_funding, (event_id % 5) / 10e0 AS burst_timing, (event_id % 13) / 10e0 AS instant_repay FROM events), pen AS (SELECT event_id, 1 - (1 - least(wash_trading, 1)) * (1 - sybil_funding * 0.8) * (1 - burst_timing * 0.7) * (1 - least(instant_repay, 1) * 0.5) AS penalty FROM sig)"


def _signals(s, d):
    e = F.col("event_id")
    return v.table(s, d, "events").select("event_id", "value", (e % 11 / 10).alias("wash_trading"), (e % 7 / 10).alias("sybil_funding"), (e % 5 / 10).alias("burst_timing"), (e % 13 / 10).alias("instant_repay"))


@query("f5_combine_signals", f"WITH {_SIG} SELECT event_id, round(penalty, 6) AS penalty, penalty >= 0.5 AS flagged FROM pen")
def _(s, d) -> DataFrame:
    return integrity.combine_signals(_signals(s, d)).select("event_id", r("penalty").alias("penalty"), "flagged")


@query("f6_apply_penalty", f"WITH {_SIG} SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 300 + event_id % 551 ELSE greatest(300, 300 + event_id % 551 - floor(250 * penalty + 0.5)) END AS BIGINT) AS penalised_score FROM pen")
def _(s, d) -> DataFrame:
    x = integrity.combine_signals(_signals(s, d)).withColumns({"score": 300 + F.col("event_id") % 551, "new_wallet": F.col("event_id") % 4 == 0, "no_borrow_history": F.lit(False)})
    return integrity.apply_penalty(x).select("event_id", "penalised_score")


# Entities

_NODES = "inb AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts, hash) AS rn FROM transfers WHERE to_addr = address AND from_addr <> ''), nodes AS (SELECT t.address, max(from_addr) FILTER (rn = 1) AS funder, max(from_addr) FILTER (rn = 2) AS gas_funder FROM (SELECT DISTINCT address FROM transfers) t LEFT JOIN inb ON inb.address = t.address GROUP BY t.address)"
_EDGES = f"{_DIR}, edges AS (SELECT address, other, sum(o) AS sent FROM dir GROUP BY ALL HAVING sum(o) > 0)"
_PAIRS = """p1 AS (SELECT a.address AS a, b.address AS b, 0.6e0 AS conf FROM nodes a JOIN nodes b ON a.funder = b.funder AND a.address < b.address),
p2 AS (SELECT DISTINCT least(address, gas_funder) AS a, greatest(address, gas_funder) AS b, 0.7e0 AS conf FROM nodes WHERE gas_funder IN (SELECT address FROM nodes) AND gas_funder <> address),
p3 AS (SELECT DISTINCT least(address, o) AS a, greatest(address, o) AS b, 0.75e0 AS conf FROM (SELECT 'w' || user_id AS address, 'w' || json_extract_string(props, '$.k') AS o FROM events WHERE event_type = 'signup') WHERE o <> address),
d0 AS (SELECT least(address, other) AS a, greatest(address, other) AS b, sum(CASE WHEN address < other THEN sent ELSE 0 END) AS x, sum(CASE WHEN address < other THEN 0 ELSE sent END) AS y FROM edges WHERE address <> other AND other IN (SELECT address FROM nodes) GROUP BY ALL),
p4 AS (SELECT * FROM (SELECT a, b, CASE WHEN x > 0 AND y > 0 THEN least(1, (x + y) / 10) WHEN x + y >= 3 THEN least(0.4, (x + y) / 20) ELSE 0 END AS conf FROM d0) WHERE conf > 0),
tm AS (SELECT address, ts, row_number() OVER (PARTITION BY address ORDER BY ts) AS rn, count(*) OVER (PARTITION BY address) AS n FROM transfers),
p5 AS (SELECT x.address AS a, y.address AS b, least(1.0, count(DISTINCT x.rn) / least(max(x.n), max(y.n))) AS conf FROM tm x JOIN tm y ON x.address < y.address AND x.n >= 3 AND y.n >= 3 AND y.ts BETWEEN x.ts - 300 AND x.ts + 300 GROUP BY ALL)"""
_LINKS = "al AS (SELECT a, b, CAST(conf AS DOUBLE) AS conf FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT a, b, CAST(conf AS DOUBLE) FROM p4 UNION ALL SELECT a, b, CAST(conf AS DOUBLE) FROM p5), links AS (SELECT a, b, 1 - list_reduce(list_prepend(1e0, list(1 - conf)), lambda x, y: x * y) AS confidence, count(*) AS n_signals FROM al GROUP BY a, b)"
_GRAPH = f"{with_views('transfers')}, {_NODES}, {_EDGES}, {_PAIRS}, {_LINKS}"


def _few(s, d):
    """Nodes, activity times, and the signals that name few pairs."""
    nodes, edges, times = entity.build_nodes(v.transfers(s, d))
    e = v._events(s, d).where("event_type = 'signup'")
    bridges = e.select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), F.concat(F.lit("w"), F.col("k")).alias("bridged_to"))
    return nodes, times, {"gas_funding": entity.gas_funding_pairs(nodes), "bridge": entity.bridge_pairs(bridges), "direct_transfer": entity.direct_transfer_pairs(edges, nodes)}


@query("g1_build_nodes", f"WITH {with_views('transfers')}, {_NODES} SELECT * FROM nodes")
def _(s, d) -> DataFrame:
    return _few(s, d)[0]


def _signal(s, d, name: str) -> DataFrame:
    nodes, times, signals = _few(s, d)
    return entity.shared_funder_pairs(nodes) if name == "shared_funder" else entity.temporal_cospend_pairs(times) if name == "temporal_cospend" else signals[name]


for _n, _name, _key in (("g2", "shared_funder_pairs", "p1"), ("g3", "gas_funding_pairs", "p2"), ("g4", "direct_transfer_pairs", "p4"), ("g5", "temporal_cospend_pairs", "p5")):
    query(f"{_n}_{_name}", f"WITH {with_views('transfers')}, {_NODES}, {_EDGES}, {_PAIRS} SELECT a, b, round(CAST(conf AS DOUBLE), 6) AS conf FROM {_key}")(
        lambda s, d, k=_name.removesuffix("_pairs"): _signal(s, d, k).withColumn("conf", r(F.col("conf").cast("double")))
    )


@query("g6_score_pairs", f"WITH {_GRAPH} SELECT a, b, round(confidence, 6) AS confidence, CAST(n_signals AS INT) AS n_signals FROM links")
def _(s, d) -> DataFrame:
    nodes, times, signals = _few(s, d)
    return entity.linked_pairs(nodes, times, **signals).select("a", "b", r("confidence").alias("confidence"), "n_signals")


@query("g2_funder_cliques", f"WITH {with_views('transfers')}, {_NODES} SELECT funder, count(*) AS members, count(*) * (count(*) - 1) // 2 AS pairs, 0.6e0 AS confidence FROM nodes WHERE funder IS NOT NULL GROUP BY funder HAVING count(*) > 1")
def _(s, d) -> DataFrame:
    nodes, _, _ = entity.build_nodes(v.transfers(s, d))
    return entity.funder_cliques(nodes).withColumn("pairs", F.col("pairs").cast("long"))


@query("g6_named_pairs", f"WITH {_GRAPH} SELECT a, b, round(confidence, 6) AS confidence, CAST(n_signals AS INT) AS n_signals, CASE WHEN round(confidence, 9) >= 0.85 THEN 'merge' WHEN round(confidence, 9) >= 0.5 THEN 'surface' ELSE 'none' END AS decision FROM links WHERE n_signals > 1 OR (a, b) NOT IN (SELECT (a, b) FROM p1)")
def _(s, d) -> DataFrame:
    """The pairs that other signals than the shared funder name, with all their signals: what is written out when cliques are not."""
    nodes, times, signals = _few(s, d)
    return entity.resolve(nodes, times=times, **signals)[0].select("a", "b", r("confidence").alias("confidence"), "n_signals", "decision")


@query("g7_merge_and_surface", f"WITH {_GRAPH} SELECT a, b, CASE WHEN round(confidence, 9) >= 0.85 THEN 'merge' WHEN round(confidence, 9) >= 0.5 THEN 'surface' ELSE 'none' END AS decision FROM links")
def _(s, d) -> DataFrame:
    nodes, times, signals = _few(s, d)
    return entity.merge_and_surface(entity.linked_pairs(nodes, times, **signals)).select("a", "b", "decision")


@query("g8_cluster", f"""WITH RECURSIVE {_GRAPH}, mg AS (SELECT a, b, confidence FROM links WHERE round(confidence, 9) >= 0.85), un AS (SELECT a AS u, b AS v FROM mg UNION SELECT b, a FROM mg), reach(u, v) AS (SELECT u, v FROM un UNION SELECT r.u, un.v FROM reach r JOIN un ON r.v = un.u),
comp AS (SELECT u AS address, least(u, min(v)) AS entity_id FROM reach GROUP BY u), sz AS (SELECT entity_id, count(*) AS size FROM comp GROUP BY entity_id), co AS (SELECT entity_id, min(confidence) AS cohesion FROM mg JOIN comp ON a = address GROUP BY entity_id)
SELECT comp.entity_id, address, size, round(cohesion, 6) AS cohesion FROM comp JOIN sz USING (entity_id) JOIN co USING (entity_id)""")
def _(s, d) -> DataFrame:
    nodes, times, signals = _few(s, d)  # hubs stay cliques: alone they merge nothing, and only what merges is written out
    return entity.cluster(entity.resolve(nodes, times=times, floor=entity.MERGE, **signals)[0]).withColumn("cohesion", r("cohesion"))


@query("g9_entity_scores", f"""WITH {with_views('history')}, mem AS (SELECT 'e' || (CAST(substr(address, 2) AS INT) % 37) AS entity_id, address, arg_max(score, ts * 1000000 + event_id) AS score, count(*) AS activity, max(ts) AS t FROM history GROUP BY address),
w AS (SELECT *, greatest(activity, 1) * power(0.5, greatest(0, {CUTOFF} - t) / (180 * 86400)) AS w FROM mem) SELECT entity_id, count(*) AS members, CAST(CASE WHEN count(*) = 1 THEN max(score) ELSE floor(sum(w * score) / sum(w) + 0.5) END AS BIGINT) AS score FROM w GROUP BY entity_id""")
def _(s, d) -> DataFrame:
    h = v.score_history(s, d).groupBy("address").agg(F.max(F.struct("ts", "event_id", "score"))["score"].alias("score"), F.count("*").alias("activity"), F.max("ts").alias("last_active_ts"))
    return entity.entity_scores(h.withColumn("entity_id", F.concat(F.lit("e"), (F.substring("address", 2, 9).cast("int") % 37).cast("string"))), now=CUTOFF)


@query("g10_merge_audit", f"""WITH {with_views('history')}, l AS (SELECT 'e' || (CAST(substr(address, 2) AS INT) % 37) AS entity_id, address, CASE event_id % 5 WHEN 0 THEN 'removed' WHEN 1 THEN 'reversed' ELSE 'merged' END AS action, ts AS t, event_id AS seq FROM history)
SELECT entity_id, address, max(t) AS since FROM l GROUP BY entity_id, address HAVING arg_max(action, t * 1000000 + seq) = 'merged'""")
def _(s, d) -> DataFrame:
    h = v.score_history(s, d)
    e = F.col("event_id") % 5
    return entity.merge_audit(h.select(F.concat(F.lit("e"), (F.substring("address", 2, 9).cast("int") % 37).cast("string")).alias("entity_id"), "address", F.when(e == 0, "removed").when(e == 1, "reversed").otherwise("merged").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq")))


# Monitoring

_EDGE_LIST = [300, *scoring.DECILES, 850]
_BUCKET = "CASE " + " ".join(f"WHEN score >= {a} AND score {'<=' if i == 9 else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGE_LIST, _EDGE_LIST[1:]))) + " END"


def _share_sql(name: str, src: str) -> str:
    return f"{name} AS (SELECT CAST(r.range AS INT) AS bucket, count(x.b) / (SELECT count(*) FROM {src}) AS share FROM range(10) r LEFT JOIN (SELECT {_BUCKET} AS b FROM {src}) x ON x.b = r.range GROUP BY r.range)"


@query("h1_bucket_shares", f"WITH {with_views('wallets')}, sc AS (SELECT score + 20 AS score FROM wallets), {_share_sql('sh', 'sc')} SELECT bucket, round(share, 6) AS share FROM sh")
def _(s, d) -> DataFrame:
    return monitoring.bucket_shares(v.wallets(s, d).withColumn("score", F.col("score") + 20), _EDGE_LIST).withColumn("share", r("share"))


@query("h2_psi", f"""WITH {with_views('wallets', 'history')}, {_share_sql('e', 'wallets')}, {_share_sql('o', 'history')}, p AS (SELECT sum((greatest(o.share, 1e-4) - greatest(e.share, 1e-4)) * ln(greatest(o.share, 1e-4) / greatest(e.share, 1e-4))) AS psi FROM e JOIN o USING (bucket))
SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'severe' END AS verdict FROM p""")
def _(s, d) -> DataFrame:
    return monitoring.psi(monitoring.bucket_shares(v.wallets(s, d), _EDGE_LIST), monitoring.bucket_shares(v.score_history(s, d), _EDGE_LIST)).withColumn("psi", r("psi"))


@query("h3_high_score_convergence", f"WITH {with_views('predictions')} SELECT count(*) AS n, round(count(*) FILTER (age <= 90 AND score >= 700) / count(*), 6) AS share FROM predictions")
def _(s, d) -> DataFrame:
    return monitoring.high_score_convergence(v.predictions(s, d)).withColumn("share", r("share"))


_MOVED = "moved AS (SELECT * FROM (SELECT *, lag(score) OVER (PARTITION BY address, chain ORDER BY ts, event_id) AS previous FROM history) WHERE previous IS NULL OR abs(score - previous) >= 10)"


@query("h4_score_changes", f"WITH {with_views('history')}, {_MOVED} SELECT m.address, chain, event_id, score, coalesce(previous, -1) AS previous, CASE WHEN i = 4 THEN 'both' ELSE 'sub' || i END AS subscription_id FROM moved m, (VALUES (1), (2), (4)) s(i) WHERE CAST(substr(m.address, 2) AS INT) % 5 = i")
def _(s, d) -> DataFrame:
    h = v.score_history(s, d)
    n = F.substring("address", 2, 9).cast("int") % 5
    own = h.select("address", "chain").distinct()
    subs = own.where(n.isin(1, 2, 3)).select("address", "chain", F.concat(F.lit("sub"), n.cast("string")).alias("subscription_id"), F.when(n == 3, 1).alias("revoked_at"))
    both = own.where(n == 4).select("address", F.explode(F.array(F.col("chain"), F.lit("elsewhere"))).alias("chain"), F.lit("both").alias("subscription_id"), F.lit(None).cast("int").alias("revoked_at"))  # two chains, one of them the wallet's
    return monitoring.score_changes(h.withColumn("address", F.initcap("address")), subs.unionByName(both)).withColumn("address", F.lower("address")).select("address", "chain", "event_id", "score", F.coalesce("previous", F.lit(-1)).alias("previous"), "subscription_id")


_NOW = 1706659200


@query("h5_cache_state", f"WITH {with_views('history')}, l AS (SELECT address, chain, max(ts) AS ts, arg_max(score, ts * 1000000 + event_id) AS score FROM history GROUP BY ALL) SELECT *, CASE WHEN {_NOW} - ts <= 300 THEN 'fresh' WHEN {_NOW} - ts <= 3600 THEN 'stale' ELSE 'miss' END AS state FROM l")
def _(s, d) -> DataFrame:
    return monitoring.cache_state(v.score_history(s, d), now=_NOW)


@query("h6_latest_scores", f"WITH {with_views('history')} SELECT address, chain, ts, score FROM history ORDER BY ts DESC, event_id DESC LIMIT 5")
def _(s, d) -> DataFrame:
    return monitoring.latest_scores(v.score_history(s, d)).select("address", "chain", "ts", "score")


@query("h6_score_history", f"WITH {with_views('history')} SELECT address, ts, score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts, event_id) AS rn FROM history) WHERE rn <= 30")
def _(s, d) -> DataFrame:
    return monitoring.score_history(v.score_history(s, d)).select("address", "ts", "score", "event_id")


@query("h7_request_summary", f"WITH {with_views('requests')} SELECT count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, max(latency_ms) AS max_ms, round(count(*) / greatest(max(ts) - min(ts), 1), 6) AS per_second, (SELECT string_agg(status || ':' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM requests GROUP BY status)) AS statuses, count(*) FILTER (cached) AS n_cached, count(*) FILTER (NOT cached) AS n_uncached, count(*) FILTER (cached IS NULL) AS n_unknown FROM requests")
def _(s, d) -> DataFrame:
    told = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return monitoring.request_summary(v.request_log(s, d)).withColumns({c: r(c) for c in ("p50_ms", "p95_ms", "p99_ms", "per_second")}).withColumn("statuses", told)
