"""Scoring whole wallet tables end to end: features, model, gates, penalty, and the envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import sigmoid
from tallyforge.operators import features, integrity, scoring

KEY = ["address", "chain"]
#: From so many failed sources on, the last score that was good is used in place of a new one.
FAILED_SOURCES = 4
#: What an envelope holds, besides the wallet and whether it is an earlier run's.
ENVELOPE = (
    "score model_score grade percentile calibrated_pd factors top_contributions weakest protocols_used penalty flagged signals completeness degraded_sources "
    "new_wallet no_borrow_history model_version as_of"
).split()


def wallet_features(wallets: DataFrame, found: integrity.Evidence, *, as_of: int, balances: DataFrame | None = None, tokens: DataFrame | None = None, accounts: DataFrame | None = None, liquidity: DataFrame | None = None) -> DataFrame:
    """One row per wallet with every input of the model, 0 or false where a source has nothing.

    found: evidence of the wallets' transfers and lending events.

    balances with tokens: portfolio; accounts: ETH, ENS and Safe flags; liquidity: (address,
    chain) of wallets with liquidity positions. All sources are aggregated by (address, chain)
    and joined on it.
    """
    parts = [features.activity_features(found.ticks, as_of=as_of, copies="n"), features.lending_counts(found.lending, copies="n")]
    if balances is not None:
        parts.append(features.portfolio_features(balances, tokens))
    if accounts is not None:
        parts.append(features.identity_flags(accounts))
    if liquidity is not None:
        parts.append(liquidity.select(*KEY).distinct().withColumn("has_uniswap_lp", F.lit(True)))
    df = wallets.select(*KEY).distinct()
    for part in parts:
        df = df.join(part, KEY, "left")
    flags = ["has_staked_eth", "has_aave", "has_compound", "has_eth", "is_gnosis_safe", "has_ens", "has_uniswap_lp", "has_governance_vote"]
    numbers = ["stablecoin_usd", "total_portfolio_usd", "stablecoin_pct", "token_diversity"]
    df = df.withColumns({c: F.lit(False) for c in flags if c not in df.columns} | {c: F.lit(0.0) for c in numbers if c not in df.columns})
    df = df.withColumn("wallet_age_days", F.coalesce(F.floor((as_of - F.col("first_ts")) / features.DAY), F.lit(0)))
    df = df.fillna(0, [c for c in df.columns if c not in (*KEY, "first_ts", *flags)]).fillna(False, flags)
    # as in serving: a wallet that borrowed counts from its first transaction
    df = df.withColumn("days_since_first_defi", F.when(F.col("aave_borrows") + F.col("compound_borrows") > 0, F.coalesce(F.floor((as_of - F.col("first_ts")) / features.DAY), F.lit(0))).otherwise(0))
    df = features.protocols_used(features.derived_ratios(df))
    return df.withColumnsRenamed({"aave_liquidations": "aave_liquidations_prior", "compound_liquidations": "compound_liquidations_prior"}).withColumn("wallet_age_months", F.col("wallet_age_days") / 30)


def score_wallets(
    wallets: DataFrame, transfers: DataFrame, lending: DataFrame, model: scoring.Ensemble, *, as_of: int, calibration: tuple[list[float], list[float]] | None = None, errors: DataFrame | None = None, known_good: DataFrame | None = None,
    related: DataFrame | None = None, cohort: DataFrame | None = None, live_parity: bool = False, model_version: str = "unknown", **sources: DataFrame,
) -> DataFrame:
    """The envelope of every wallet: score after the penalty, the model's own score, grade and percentile, and what led to them.

    calibration: the grid (x, y) from raw to calibrated probability. errors: (address, chain,
    errors map) of the sources that failed; they lower completeness and mark factors as limited.
    known_good: envelopes of an earlier run (columns of this result; those it lacks are null).
    Where FAILED_SOURCES or more failed and there is one, it stands whole in place of this run's.
    Wallets without history or without borrows are gated: they are never penalised, and have no
    factors, contributions, probability or model version, as no model has scored them.
    related: (address, chain, other), known relations for wash trading; cohort: (address, chain,
    cohort) of the entities' sizes for sybil funding. sources: balances, tokens, accounts,
    liquidity of wallet_features().
    """
    return score_evidence(
        wallets, integrity.Evidence.of(transfers, lending), model, as_of=as_of, calibration=calibration, errors=errors, known_good=known_good, related=related, cohort=cohort, live_parity=live_parity, model_version=model_version, **sources,
    )


def score_evidence(
    wallets: DataFrame, found: integrity.Evidence, model: scoring.Ensemble, *, as_of: int, calibration: tuple[list[float], list[float]] | None = None, errors: DataFrame | None = None, known_good: DataFrame | None = None,
    related: DataFrame | None = None, cohort: DataFrame | None = None, live_parity: bool = False, model_version: str = "unknown", **sources: DataFrame,
) -> DataFrame:
    """score_wallets() from evidence, of all wallets or of those that `wallets` names."""
    df = wallet_features(wallets, found, as_of=as_of, **sources)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    df = df.withColumn("errors", none) if errors is None else df.join(errors.select(*KEY, "errors"), KEY, "left").withColumn("errors", F.coalesce("errors", none))
    vector = features.feature_vector(df).select(*KEY, "tx_count", "first_ts", "total_borrows", "protocols_used", "errors", "features")
    df = scoring.score_trees(vector, model)
    p = sigmoid(F.col("margin"))
    df = df.withColumn("calibrated_pd", p if calibration is None else scoring.calibrate(p, *calibration)).withColumn("score", scoring.pd_to_score(F.col("calibrated_pd")))
    df = scoring.score_gates(df.withColumns({"grade": scoring.grade(F.col("score")), "percentile": scoring.score_percentile(F.col("score"))}))
    df = features.completeness(scoring.weakest_factors(scoring.top_contributions(scoring.factor_bars(df))))
    df = df.join(integrity.detect_evidence(found, related, cohort, live_parity=live_parity), KEY, "left")
    scorable = ~(F.col("new_wallet") | F.col("no_borrow_history"))
    df = df.withColumns({"penalty": F.when(scorable, F.coalesce("penalty", F.lit(0.0))).otherwise(0.0), "flagged": scorable & F.coalesce("flagged", F.lit(False))})
    signals = F.filter(F.array(*(F.struct(F.lit(name).alias("id"), F.coalesce(name, F.lit(0.0)).alias("severity")) for name in integrity.WEIGHTS)), lambda s: scorable & (s["severity"] > 0))
    df = integrity.apply_penalty(df).withColumns({"signals": signals, "model_score": F.col("score"), "score": F.col("penalised_score")})
    empty = {c: F.when(scorable, F.col(c)).otherwise(F.array().cast(df.schema[c].dataType.simpleString())) for c in ("factors", "top_contributions", "weakest")}
    own = df.withColumns({
        **empty, "calibrated_pd": F.when(scorable, F.col("calibrated_pd")), "model_version": F.when(scorable, F.lit(model_version)).otherwise("unknown"), "as_of": F.lit(as_of).cast("long"),
        "protocols_used": F.when(F.col("new_wallet"), F.array().cast("array<string>")).otherwise(F.col("protocols_used")),
    }).select(*KEY, *ENVELOPE, F.size("errors").alias("__failed"))
    if known_good is None:
        return own.drop("__failed").withColumn("last_known_good", F.lit(False))
    kinds = own.schema
    old = known_good.select(*KEY, F.lit(True).alias("__old"), *((F.col(c) if c in known_good.columns else F.lit(None)).cast(kinds[c].dataType.simpleString()).alias(f"__old_{c}") for c in ENVELOPE))
    met = own.join(old, KEY, "left")
    kept = (F.col("__failed") >= FAILED_SOURCES) & F.coalesce("__old", F.lit(False))
    return met.select(*KEY, *(F.when(kept, F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) for c in ENVELOPE), kept.alias("last_known_good"))
