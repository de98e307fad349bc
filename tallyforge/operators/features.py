"""Ingest and wallet features: cleaning, activity, lending, portfolio, ratios, vectors.

Every function takes and returns DataFrames keyed by (address, chain). `as_of` is always
an argument. Aggregations combine on the map side; a wallet with a huge history is never
gathered, except where an order within the wallet is the meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import DAY, clamp, count_if, round_half_up, utc_date, utc_month
from tallyforge.plans.prefix import running_sums
from tallyforge.sources.store import Store

KEY = ["address", "chain"]

# Features in model order.
FEATURES = (
    "wallet_age_days wallet_age_months days_since_first_defi active_days_count tx_count tx_count_30d tx_count_90d tx_count_180d active_months_12 "
    "aave_borrows aave_repays aave_liquidations_prior compound_borrows compound_repays compound_liquidations_prior total_borrows total_repays repayment_ratio "
    "prior_liquidation_count has_prior_liquidation protocols_used_count has_uniswap_lp has_staked_eth has_governance_vote total_portfolio_usd stablecoin_pct "
    "token_diversity has_eth has_ens is_gnosis_safe borrow_velocity liquidation_rate net_unpaid_borrows defi_tenure_ratio"
).split()

# Weight of each source group in completeness, in reporting order.
COMPLETENESS = {"etherscan": 0.4, "alchemy": 0.2, "aave": 0.2, "compound": 0.1, "uniswap": 0.1}
# Solana transaction sources by protocol.
SOLANA_SOURCES = {
    "jupiter": ["JUPITER", "JUPITER_DCA", "JUPITER_LIMIT_ORDER"], "kamino": ["KAMINO", "HUBBLE"], "solend": ["SOLEND"], "marginfi": ["MARGINFI"], "marinade": ["MARINADE", "MARINADE_FINANCE"],
}


def normalize_transfers(raw: DataFrame) -> DataFrame:
    """String or ISO times to whole seconds (null if neither), addresses in lower case; '' and null stay apart."""
    number, iso = F.expr("try_cast(ts AS bigint)"), F.expr("try_cast(ts AS timestamp)")
    return raw.withColumn("ts", F.coalesce(number, F.unix_seconds(iso))).withColumn("from_addr", F.lower("from_addr")).withColumn("to_addr", F.lower("to_addr")).withColumn("address", F.lower("address"))


def merge_transfers(sent: DataFrame, received: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Both directions as one history: known times only, one row per hash (sent first); the newest `limit` per wallet if one is given."""
    both = sent.withColumn("__side", F.lit(0)).unionByName(received.withColumn("__side", F.lit(1))).where("ts is not null")
    once = both.withColumn("__rn", F.row_number().over(Window.partitionBy(*KEY, "hash").orderBy("__side", "ts"))).where("__rn = 1").drop("__rn", "__side")
    if limit is None:
        return once
    return once.withColumn("__rn", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ts"), "hash"))).where(F.col("__rn") <= limit).drop("__rn")


def pick_by_priority(results: DataFrame, priority: DataFrame) -> DataFrame:
    """Per wallet the first source that answered, in its chain's order; attempts lists the sources asked until then.

    results: address, chain, source, ok, value. priority: chain, source, rank (a small dimension).
    """
    ranked = results.join(F.broadcast(priority), ["chain", "source"])
    first = ranked.groupBy(*KEY).agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("won"), F.min_by(F.when(F.col("ok"), F.struct("source", "value")), F.when(F.col("ok"), F.col("rank"))).alias("pick"), F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("tried"))
    asked = F.filter("tried", lambda t: F.col("won").isNull() | (t["rank"] <= F.col("won")))
    return first.select(*KEY, F.col("pick.source").alias("source"), F.col("pick.value").alias("value"), F.transform(asked, lambda t: t["source"]).alias("attempts"))


def reconcile_sources(primary: DataFrame, secondary: DataFrame, *, tol: float = 0.1) -> DataFrame:
    """Wallets whose two counts differ by more than tol of the larger."""
    met = primary.select(*KEY, F.col("value").alias("a")).join(secondary.select(*KEY, F.col("value").alias("b")), KEY)
    gap = F.abs(F.col("a") - F.col("b")) / F.greatest("a", "b", F.lit(1))
    return met.withColumn("gap", gap).where(F.col("gap") > tol)


def completeness(df: DataFrame, errors: str = "errors") -> DataFrame:
    """df with completeness (1 less the weights of failed groups, 2 decimals) and degraded_sources."""
    failed = {g: F.coalesce(F.col(errors)[g].isNotNull(), F.lit(False)) for g in COMPLETENESS}
    lost = sum((F.when(failed[g], F.lit(w)).otherwise(F.lit(0.0)) for g, w in COMPLETENESS.items()), F.lit(0.0))
    return df.withColumn("completeness", round_half_up(1 - lost, 2)).withColumn("degraded_sources", F.array_compact(F.array(*(F.when(f, F.lit(g)) for g, f in failed.items()))))


def new_addresses(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    return candidates.select("address").distinct().join(existing.select("address"), "address", "left_anti")


def classify_address(c: Column) -> Column:
    """evm, solana, ens (one label before .eth, 64 characters at most) or invalid."""
    return F.when(F.trim(c).rlike(r"^0x[0-9a-fA-F]{40}$"), "evm").when(F.trim(c).rlike(r"^[1-9A-HJ-NP-Za-km-z]{32,44}$"), "solana").when(F.trim(c).rlike(r"(?i)^(?=.{1,64}$)[a-z0-9-]+\.eth$"), "ens").otherwise("invalid")


def valid_addresses(df: DataFrame, col: str = "address") -> DataFrame:
    """df with address_kind and the normalised address: lower case unless Solana, where case counts."""
    kind = classify_address(F.col(col))
    return df.withColumn("address_kind", kind).withColumn("normalised", F.when(kind == "invalid", None).when(kind == "solana", F.trim(col)).otherwise(F.lower(F.trim(col))))


def normalize_lending(raw: DataFrame, deployments: DataFrame) -> DataFrame:
    """Two subgraph shapes to one event table. raw: protocol, chain, kind, ts, user, account, liquidatee; deployments is small."""
    who = F.coalesce(F.col("user"), F.when(F.col("kind") == "liquidation", F.col("liquidatee")), F.col("account"))
    return raw.join(F.broadcast(deployments), ["protocol", "chain"]).select(F.lower(who).alias("address"), "chain", "family", "protocol", "kind", "ts").where("address is not null")


def upsert_scores(wallets: DataFrame, results: DataFrame) -> DataFrame:
    """Latest score per lower-case wallet: wallets (address, score, scored_at) overlaid by results."""
    both = wallets.withColumn("__new", F.lit(0)).unionByName(results.select("address", "score", "scored_at").withColumn("__new", F.lit(1))).withColumn("address", F.lower("address"))
    return both.groupBy("address").agg(F.max(F.struct("scored_at", "__new", "score")).alias("x")).select("address", "x.score", "x.scored_at")


def score_stores(spark: SparkSession, path: str, *, partitions: int = 64) -> tuple[Store, Store]:
    """(wallets, snapshots): the latest score of each wallet, and every score that was ever synchronised."""
    wallets = Store(spark, f"{path}/wallets", "address string, score long, grade string, percentile long, ens string, scored_at long", ["address"], partitions=partitions)
    return wallets, Store(spark, f"{path}/snapshots", "address string, score long, created long", ["address"], partitions=partitions)


def sync_scores(stores: tuple[Store, Store], results: DataFrame, *, batch: tuple[str, int]) -> None:
    """Take a batch of results (address, score, scored_at; grade, percentile and ens if known): each wallet's latest, and a snapshot row for each result.

    The two stores are written one after the other. A job that is lost in between is run again
    with the same batch, which each store takes once.
    """
    wallets, snapshots = stores
    rows = results.withColumn("address", F.lower("address"))
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in (("grade", "string"), ("percentile", "long"), ("ens", "string")) if c not in rows.columns})
    rest = ["score", "grade", "percentile", "ens"]

    def latest(both: DataFrame) -> DataFrame:
        return both.groupBy("address").agg(F.max(F.struct("scored_at", "new", *rest)).alias("x")).select("address", *(f"x.{c}" for c in (*rest, "scored_at")))

    wallets.merge(rows.select("address", *rest, "scored_at"), latest, batch=batch)
    snapshots.append(rows.select("address", "score", F.col("scored_at").alias("created")), batch=batch)


def activity_features(transfers: DataFrame, *, as_of: int, copies: str | None = None) -> DataFrame:
    """Counts over all records (unknown times too), over 30, 90 and 180 days, and distinct active days and months.

    copies: a column with the number of records of one time that a row stands for.
    """
    since = lambda d: F.col("ts") >= as_of - d * DAY
    times = F.col(copies) if copies else F.lit(1).cast("long")
    counted = lambda d: F.sum(F.when(since(d), times).otherwise(0)).alias(f"tx_count_{d}d")
    return transfers.groupBy(*KEY).agg(
        F.sum(times).alias("tx_count"), counted(30), counted(90), counted(180),
        F.count_distinct(utc_date(F.col("ts"))).alias("active_days_count"), F.count_distinct(F.when(since(365), utc_month(F.col("ts")))).alias("active_months_12"),
        F.min("ts").alias("first_ts"),
    )


def first_activity(transfers: DataFrame, *, as_of: int) -> DataFrame:
    first = transfers.groupBy(*KEY).agg(F.min("ts").alias("first_ts"))
    return first.withColumn("wallet_age_days", F.coalesce(F.floor((as_of - F.col("first_ts")) / DAY), F.lit(0)))


def lending_counts(events: DataFrame, coverage: DataFrame | None = None, *, copies: str | None = None) -> DataFrame:
    """Borrows, repays and liquidations per family, over covered deployments (a small dimension); a missing family is 0.

    copies: a column with the number of equal events that a row stands for.
    """
    times = F.col(copies) if copies else F.lit(1)
    if coverage is not None:
        events = events.join(F.broadcast(coverage.select("family", "chain").distinct()), ["family", "chain"])
    of = lambda f, k: F.sum(F.when((F.col("family") == f) & (F.col("kind") == k), times).otherwise(0))
    return events.groupBy(*KEY).agg(*(of(f, k).alias(f"{f}_{n}") for f in ("aave", "compound") for k, n in (("borrow", "borrows"), ("repay", "repays"), ("liquidation", "liquidations"))))


def borrower_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("address").agg(count_if(F.col("kind") == "borrow").alias("borrows"), count_if(F.col("kind") == "repay").alias("repays"), count_if(F.col("kind") == "liquidation").alias("liquidations")).where("borrows > 0")


def hex_to_double(c: Column | str) -> Column:
    """Up to 256 bits of hexadecimal to double; '0x' is 0, null and unreadable give null.

    Nearly all balances have at most 15 digits once leading zeros are gone, and take one
    conversion; longer ones are put together from eight parts.
    """
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(c, r"^(?:0[xX])?0*([0-9a-fA-F]{0,64})$", 1)
    ok = c.rlike(r"^(?:0[xX])?[0-9a-fA-F]{0,64}$")

    def long_form(d: Column) -> Column:
        padded = F.lpad(d, 64, "0")
        parts = [F.conv(F.substring(padded, 8 * i + 1, 8), 16, 10).cast("double") * float(2 ** (32 * (7 - i))) for i in range(8)]
        return sum(parts[1:], parts[0])

    # the digits are cleaned once: a lambda's variable is computed once a row, however often it stands in the body
    decoded = F.transform(F.array(digits), lambda d: F.when(d == "", 0.0).when(F.length(d) <= 15, F.conv(d, 16, 10).cast("double")).otherwise(long_form(d)))
    return F.when(ok, decoded[0])


def portfolio_features(balances: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token diversity, stablecoin dollars and share, and role flags. tokens: contract, role, decimals, price (a small dimension).

    Equal balances of a wallet in a contract are counted first, so each is decoded once.
    """
    held = balances.groupBy(*KEY, "contract", "balance_hex").agg(F.count("*").alias("copies"))
    met = held.withColumn("raw", hex_to_double("balance_hex")).join(F.broadcast(tokens), "contract", "left")
    usd = F.col("raw") / F.pow(F.lit(10.0), F.col("decimals")) * F.coalesce("price", F.lit(0.0)) * F.col("copies")
    some, stable = F.col("raw") > 0, F.col("role") == "stable"
    flag = lambda cond: F.coalesce(F.max(some & cond), F.lit(False))
    by_contract = met.groupBy(*KEY, "contract").agg(
        flag(F.lit(True)).alias("held"), F.sum(F.when(some & stable, usd).otherwise(0.0)).alias("stable_usd"), F.sum(F.when(some, F.coalesce(usd, F.lit(0.0))).otherwise(0.0)).alias("usd"),
        flag(F.col("role") == "lido").alias("lido"), flag((F.col("role") == "aave_v3") | ((F.col("role") == "aave_v2") & (F.col("chain") == "ethereum"))).alias("aave"),
        flag((F.col("role") == "compound") & (F.col("chain") == "ethereum")).alias("compound"),
    )
    out = by_contract.where("held").groupBy(*KEY).agg(F.count("*").alias("token_diversity"), F.sum("stable_usd").alias("stablecoin_usd"), F.sum("usd").alias("total_portfolio_usd"), F.max("lido").alias("has_staked_eth"), F.max("aave").alias("has_aave"), F.max("compound").alias("has_compound"))
    return out.withColumn("stablecoin_pct", F.when(F.col("total_portfolio_usd") > 0, F.col("stablecoin_usd") / F.col("total_portfolio_usd") * 100).otherwise(0.0))


def identity_flags(accounts: DataFrame) -> DataFrame:
    """has_eth, is_gnosis_safe (code, and under 300 characters of it), has_ens (a resolver word that is not zero). accounts: balance_hex, code, resolver."""
    code = F.coalesce("code", F.lit("0x"))
    return accounts.select(*KEY, (F.coalesce(hex_to_double("balance_hex"), F.lit(0.0)) > 0).alias("has_eth"), ((code != "0x") & (code != "") & (F.length(code) < 300)).alias("is_gnosis_safe"), F.coalesce(F.regexp_replace("resolver", "^0x", "").rlike("[1-9a-fA-F]"), F.lit(False)).alias("has_ens"))


def protocols_used(df: DataFrame) -> DataFrame:
    """df with protocols_used in fixed order, and protocols_used_count, which is a feature of its own.

    The list names a lending protocol from a borrow or a repay on; the count from a borrow on.
    """
    used = lambda f, *kinds: sum((F.col(f"{f}_{k}") for k in kinds[1:]), F.col(f"{f}_{kinds[0]}")) > 0
    names = F.array_compact(F.array(
        F.when(F.col("has_aave") | used("aave", "borrows", "repays"), "Aave"), F.when(F.col("has_compound") | used("compound", "borrows", "repays"), "Compound"),
        F.when(F.col("has_uniswap_lp"), "Uniswap"), F.when(F.col("has_staked_eth"), F.when(F.col("chain") == "ethereum", "Lido").otherwise("Lido (wstETH)")),
    ))
    counted = [F.col("has_aave") | used("aave", "borrows"), F.col("has_compound") | used("compound", "borrows"), F.col("has_uniswap_lp"), F.col("has_staked_eth")]
    return df.withColumn("protocols_used", names).withColumn("protocols_used_count", sum((c.cast("int") for c in counted[1:]), counted[0].cast("int")))


def derived_ratios(df: DataFrame) -> DataFrame:
    """The ratio features, each with its cap. Needs the six lending counts, wallet_age_days and days_since_first_defi."""
    borrows, repays = F.col("aave_borrows") + F.col("compound_borrows"), F.col("aave_repays") + F.col("compound_repays")
    liq = F.col("aave_liquidations") + F.col("compound_liquidations")
    age = F.coalesce("wallet_age_days", F.lit(0))
    return df.withColumns({
        "total_borrows": borrows, "total_repays": repays, "repayment_ratio": repays / F.greatest(borrows, F.lit(1)), "prior_liquidation_count": liq, "has_prior_liquidation": (liq > 0).cast("int"),
        "borrow_velocity": F.least(borrows / F.greatest(age, F.lit(1)), F.lit(50.0)), "liquidation_rate": F.least(liq / F.greatest(borrows, F.lit(1)), F.lit(10.0)),
        "net_unpaid_borrows": clamp(borrows - repays, 0, 1000), "defi_tenure_ratio": F.least(F.coalesce("days_since_first_defi", F.lit(0)) / F.greatest(age, F.lit(1)), F.lit(1.5)),
    })


def feature_vector(df: DataFrame, order: list[str] = FEATURES) -> DataFrame:
    """df with `features` in model order: booleans as 0 and 1, null as 0. Raises on missing or reordered names."""
    missing = [f for f in order if f not in df.columns]
    if missing:
        raise ValueError(f"features missing: {missing}")
    if list(order) != list(FEATURES):
        raise ValueError("the feature names differ from the model's order")
    return df.withColumn("features", F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in order)))


def social_features(transfers: DataFrame) -> DataFrame:
    """Distinct recipients, and the share of sends that carry input data. Needs `input`."""
    called = F.col("input").isNotNull() & ~F.col("input").isin("", "0x")
    return transfers.groupBy(*KEY).agg(F.count_distinct(F.when(F.col("to_addr") != "", F.col("to_addr"))).alias("unique_recipients"), round_half_up(F.avg(called.cast("double")), 2).alias("contract_ratio"))


def days_since_first_defi(events: DataFrame, first_tx: DataFrame, *, as_of: int, mode: str = "exact") -> DataFrame:
    """exact: from the first lending event; serving: from the first transaction of any wallet that borrowed."""
    if mode == "exact":
        return events.groupBy(*KEY).agg(F.floor((as_of - F.min("ts")) / DAY).alias("days_since_first_defi"))
    if mode != "serving":
        raise ValueError(mode)
    borrowed = events.where("kind = 'borrow'").select(*KEY).distinct()
    return first_tx.join(borrowed, KEY).select(*KEY, F.floor((as_of - F.col("first_ts")) / DAY).alias("days_since_first_defi"))


def portfolio_changes(balances: DataFrame, tokens: DataFrame) -> DataFrame:
    """(address, chain, ts, and by how much each portfolio number changes then) of dated balances; the sums until a time are the portfolio at that time.

    A contract's balance stands until its next one; of equal times the largest counts. Dollars
    are taken at nine decimals, so that sums of changes are exact.
    """
    last = balances.where("ts is not null").groupBy(*KEY, "contract", "ts").agg(F.max(F.coalesce(hex_to_double("balance_hex"), F.lit(0.0))).alias("raw"))
    met = last.join(F.broadcast(tokens), "contract", "left")
    some, role = F.col("raw") > 0, F.coalesce("role", F.lit(""))
    usd = F.when(some, F.coalesce(F.col("raw") / F.pow(F.lit(10.0), F.col("decimals")) * F.col("price"), F.lit(0.0))).otherwise(0.0)
    state = {
        "held": some, "lido": some & (role == "lido"), "aave": some & ((role == "aave_v3") | ((role == "aave_v2") & (F.col("chain") == "ethereum"))), "compound": some & (role == "compound") & (F.col("chain") == "ethereum"),
    }
    now = met.select(*KEY, "contract", "ts", *(c.cast("long").alias(n) for n, c in state.items()), usd.cast("decimal(28,9)").alias("usd"), F.when(role == "stable", usd).otherwise(0.0).cast("decimal(28,9)").alias("stable"))
    before = Window.partitionBy(*KEY, "contract").orderBy("ts")
    names = [*state, "usd", "stable"]
    step = now.select(*KEY, "ts", *((F.col(n) - F.coalesce(F.lag(n).over(before), F.lit(0).cast(now.schema[n].dataType))).alias(n) for n in names))
    return step.groupBy(*KEY, "ts").agg(*(F.sum(n).alias(n) for n in names))


def _next_month(seconds: Column) -> Column:
    """The first second of the month after that of a time."""
    return F.datediff(F.add_months(F.trunc(utc_date(seconds), "month"), 1), F.lit("1970-01-01").cast("date")).cast("long") * DAY


def point_in_time_features(transfers: DataFrame, events: DataFrame, as_of: DataFrame, *, balances: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Activity, lending, ratios and (from dated balances) portfolio strictly before each (address, chain, cutoff) of as_of.

    balances: address, chain, contract, balance_hex, ts; the last balance of a contract before
    the cutoff counts. All histories become one table of what changes at a time: transfers,
    first transfers of a day and of a month, lending events, portfolio changes. The cutoffs, and
    the times before them from which windows run, enter it as marks, and running sums say what
    had come before each mark; a window is the difference of two. So histories are shuffled as
    often whether a wallet has one cutoff or thousands, and no wallet is held by one task.
    """
    cut = as_of.select(*KEY, "cutoff").where("cutoff is not null").distinct()
    known = transfers.where("ts is not null").select(*KEY, "ts")
    kinds = {f"{f}_{n}": (f, k) for f in ("aave", "compound") for k, n in (("borrow", "borrows"), ("repay", "repays"), ("liquidation", "liquidations"))}
    parts = {
        "t": known.withColumn("t", F.lit(1).cast("long")),
        "d": known.groupBy(*KEY, utc_date(F.col("ts")).alias("__day")).agg(F.min("ts").alias("ts")).withColumn("d", F.lit(1).cast("long")).drop("__day"),
        "m": known.groupBy(*KEY, utc_month(F.col("ts")).alias("__month")).agg(F.min("ts").alias("ts")).withColumn("m", F.lit(1).cast("long")).drop("__month"),
        "lend": events.where("ts is not null").select(*KEY, "ts", *(((F.col("family") == f) & (F.col("kind") == k)).cast("long").alias(n) for n, (f, k) in kinds.items())),
    }
    names = ["t", "d", "m", *kinds]
    if balances is not None:
        parts["held"] = portfolio_changes(balances, tokens)
        names += ["held", "lido", "aave", "compound", "usd", "stable"]
    both = None
    for part in parts.values():
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    changes = both.groupBy(*KEY, "ts").agg(*(F.sum(n).alias(n) for n in names)).withColumn("side", F.lit(1))
    year = F.col("cutoff") - 365 * DAY
    times = {"now": F.col("cutoff"), "30d": F.col("cutoff") - 30 * DAY, "90d": F.col("cutoff") - 90 * DAY, "180d": F.col("cutoff") - 180 * DAY, "year": year, "month": _next_month(year)}
    marks = cut.select(*KEY, "cutoff", F.explode(F.array(*(F.struct(F.lit(n).alias("mark"), c.cast("long").alias("ts")) for n, c in times.items()))).alias("x")).select(*KEY, "cutoff", "x.*", F.lit(0).alias("side"))
    table = changes.unionByName(marks, allowMissingColumns=True).fillna(0, names)
    summed = running_sums(table, KEY, ["ts", "side", "cutoff", "mark"], names).where("side = 0")  # a mark comes before what happens at its time
    at = lambda n, mark: F.max(F.when(F.col("mark") == mark, F.col(f"before_{n}")))
    rest = [n for n in names if n not in ("t", "d", "m", "usd", "stable", "held", "lido", "aave", "compound")]
    own = summed.groupBy(*KEY, "cutoff").agg(
        at("t", "now").alias("tx_count"), *((at("t", "now") - at("t", f"{d}d")).alias(f"tx_count_{d}d") for d in (30, 90, 180)), at("d", "now").alias("active_days_count"),
        # the months after that in which the year began, and that one if something came in the rest of it
        (at("m", "now") - at("m", "month") + (at("t", "month") > at("t", "year")).cast("long")).alias("active_months_12"),
        *(at(n, "now").alias(n) for n in rest), *([at(n, "now").alias(f"p_{n}") for n in names[-6:]] if balances is not None else []),
    )
    first = known.groupBy(*KEY).agg(F.min("ts").alias("__tx")).join(events.groupBy(*KEY).agg(F.min("ts").alias("__lend")), KEY, "full")
    age = lambda c: F.when(F.col(c) < F.col("cutoff"), F.floor((F.col("cutoff") - F.col(c)) / DAY)).otherwise(F.lit(0))
    out = own.join(first, KEY, "left").withColumns({"wallet_age_days": age("__tx"), "days_since_first_defi": age("__lend")}).drop("__tx", "__lend")
    if balances is not None:
        total, stable = F.col("p_usd").cast("double"), F.col("p_stable").cast("double")
        out = out.withColumns({
            "token_diversity": F.col("p_held"), "stablecoin_usd": stable, "total_portfolio_usd": total, "has_staked_eth": F.col("p_lido") > 0, "has_aave": F.col("p_aave") > 0, "has_compound": F.col("p_compound") > 0,
            "stablecoin_pct": F.when(total > 0, stable / total * 100).otherwise(0.0),
        }).drop(*(f"p_{n}" for n in names[-6:]))
    return derived_ratios(out)


def training_features(df: DataFrame) -> DataFrame:
    """The older collector's columns: whole months of age, repay rate (4 decimals, -1 without borrows), protocol count."""
    return df.select(*KEY, F.floor(F.col("wallet_age_days") / 30).alias("wallet_age_months"), F.when(F.col("total_borrows") > 0, F.bround(F.col("total_repays") / F.col("total_borrows"), 4)).otherwise(-1.0).alias("repay_rate"), F.col("protocols_used_count"))


def solana_activity(signatures: DataFrame, tokens: DataFrame, txs: DataFrame, *, as_of: int) -> DataFrame:
    """Per Solana wallet: counts, active months (strictly within a year), tokens, staking mints, protocols, borrows and repays."""
    recent = F.col("block_time") > as_of - 365 * DAY
    sig = signatures.groupBy("address").agg(F.count("*").alias("tx_count"), F.min("block_time").alias("first_ts"), F.count_distinct(F.when(recent, utc_month(F.col("block_time")))).alias("active_months_12"))
    tok = tokens.groupBy("address").agg(F.count_distinct("mint").alias("token_count"), *(F.max(F.col("role") == r).alias(f"has_{r}") for r in ("msol", "jitosol", "bsol")))
    use = txs.groupBy("address").agg(*(F.max(F.col("source").isin(names)).alias(f"has_{p}") for p, names in SOLANA_SOURCES.items()), count_if(F.col("type") == "BORROW").alias("borrow_count"), count_if(F.col("type").isin("REPAY", "LOAN_REPAYMENT")).alias("repay_count"))
    met = sig.join(tok, "address", "full").join(use, "address", "full")
    return met.fillna(0).fillna(False)
