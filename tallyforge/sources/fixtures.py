"""Domain views over the sample tables, each with the same view as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import epoch_seconds, round_half_up

AS_OF = 1706745600
CHAINS = ["ethereum", "arbitrum", "polygon", "base"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chain(n):
    return F.element_at(F.array(*(F.lit(c) for c in CHAINS)), (F.pmod(n, F.lit(4)) + 1).cast("int"))


def _events(spark, sf_dir):
    return events_of(table(spark, sf_dir, "events"))


def events_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return events.select("event_id", "user_id", "event_type", "value", k.alias("k"), epoch_seconds(F.col("ts")).alias("sec"))


def transfers(spark, sf_dir) -> DataFrame:
    """Per wallet: hash, ts, from_addr, to_addr, value_eth."""
    return transfers_of(_events(spark, sf_dir))


def transfers_of(events: DataFrame) -> DataFrame:
    me, other = F.concat(F.lit("w"), F.col("user_id").cast("string")), F.concat(F.lit("w"), F.col("k"))
    inbound = F.col("event_type") == "view"
    return events.select(
        me.alias("address"), _chain(F.col("user_id")).alias("chain"), F.concat(F.lit("0x"), F.col("event_id").cast("string")).alias("hash"), F.col("sec").alias("ts"),
        F.when(inbound, other).otherwise(me).alias("from_addr"), F.when(inbound, me).otherwise(other).alias("to_addr"), F.col("value").alias("value_eth"),
    )


def lending_events(spark, sf_dir) -> DataFrame:
    return lending_of(_events(spark, sf_dir))


def lending_of(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "borrow").when(F.col("event_type") == "click", "repay").when(F.col("event_type") == "error", "liquidation")
    return events.select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), _chain(F.col("user_id")).alias("chain"),
        F.when(F.col("event_id") % 3 == 0, "compound").otherwise("aave").alias("family"), kind.alias("kind"), F.col("sec").alias("ts"), F.floor(F.col("sec") / 12).alias("block"), F.col("event_id"),
    ).where("kind is not null")


def balances(spark, sf_dir) -> DataFrame:
    b = F.col("l_extendedprice").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("address"), _chain(F.col("l_suppkey")).alias("chain"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 12).cast("string")).alias("contract"), F.concat(F.lit("0x"), F.lower(F.hex(b * 1000000))).alias("balance_hex"),
    )


def wallets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("address"), _chain(F.col("c_nationkey")).alias("chain"),
        (300 + F.floor(F.abs("c_acctbal")) % 551).alias("score"), F.col("c_custkey"),
    )


def score_history(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), _chain(F.col("user_id")).alias("chain"), F.col("sec").alias("ts"),
        (300 + F.floor(F.col("value") * 10) % 551).cast("long").alias("score"), "event_id",
    )


def predictions(spark, sf_dir) -> DataFrame:
    """p, label, chain, age, borrows, and the score that p maps to."""
    p = (F.col("o_totalprice") % 1000) / 1000
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), p.alias("p"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"), _chain(F.col("o_custkey")).alias("chain"),
        (F.col("o_orderkey") % 400).alias("age"), (F.col("o_orderkey") % 7).alias("borrows"), (850 - round_half_up(p * 550)).alias("score"),
    )


def feature_rows(spark, sf_dir) -> DataFrame:
    """The first 34 numbers of each vector as features."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 34).alias("features"), (F.col("label") < 3).cast("int").alias("label"),
        _chain(F.col("label")).alias("chain"), (F.col("vec_id") % 400).alias("age"), (F.col("vec_id") % 7).alias("borrows"),
    )


def loans(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "REPAID").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("DEFAULTED")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("loan_id"), F.concat(F.lit("u"), (F.col("o_orderkey") % 100).cast("string")).alias("lender"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("borrower"),
        F.col("o_totalprice").alias("amount"), status.alias("status"), epoch_seconds(F.col("o_orderdate")).alias("started"),
    )


def listings(spark, sf_dir) -> DataFrame:
    day = epoch_seconds(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("listing_id"), F.concat(F.lit("u"), (F.col("o_orderkey") % 100).cast("string")).alias("lender"), F.col("o_totalprice").alias("amount"),
        (5 + F.col("o_orderkey") % 6).cast("double").alias("min_apr"), (12 + F.col("o_orderkey") % 9).cast("double").alias("max_apr"), (400 + F.col("o_orderkey") % 300).alias("min_score"),
        (30 + F.col("o_orderkey") % 150).alias("duration_days"), F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("status"), day.alias("created"), (day + 86400 * 700).alias("expires"),
        F.element_at(F.array(F.lit("USDC"), F.lit("ETH"), F.lit("DAI")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("currency"), F.when(F.col("o_orderkey") % 5 == 0, "SOLANA").otherwise("EVM").alias("listing_chain"),
        (450 + F.col("o_orderkey") % 370).alias("lender_score"), (F.col("o_orderkey") % 160).cast("double").alias("collateral_pct"),
    )


def applications(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("application_id"), F.col("l_orderkey").alias("listing_id"), F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("borrower"),
        (300 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 551).alias("borrower_score"), F.col("l_extendedprice").alias("amount"), epoch_seconds(F.col("l_shipdate")).alias("created"), F.when(F.col("l_returnflag") == "A", "ACCEPTED").when(F.col("l_returnflag") == "R", "REJECTED").otherwise("PENDING").alias("status"),
    )


def reviews(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"), F.col("l_orderkey").alias("loan_id"), F.concat(F.lit("u"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") % 100).otherwise(F.col("l_suppkey")).cast("string")).alias("reviewer"),
        F.concat(F.lit("u"), (F.col("l_suppkey") % 100).cast("string")).alias("reviewee"), (1 + F.col("l_linenumber") % 5).cast("int").alias("rating"), epoch_seconds(F.col("l_shipdate")).alias("created"),
    )


def notifications(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), F.col("sec").alias("created"), (F.col("event_id") % 2 == 0).alias("read"))


def usage_calls(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("api_key"), F.col("sec").alias("ts"))


def request_log(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, 500).otherwise(503)).when(F.col("event_type") == "signup", 429).otherwise(200)
    return _events(spark, sf_dir).select(F.col("sec").alias("ts"), F.col("value").alias("latency_ms"), status.alias("status"), F.when(status == 200, F.col("event_id") % 2 == 0).alias("cached"))


# The same views as SQL.
_CHAIN = "CASE ({n}) % 4 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'arbitrum' WHEN 2 THEN 'polygon' ELSE 'base' END"


def _c(n: str) -> str:
    return _CHAIN.format(n=n)


SQL = {
    "ev": "ev AS (SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k') AS k, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)",
    "transfers": f"""transfers AS (SELECT 'w' || user_id AS address, {_c('user_id')} AS chain, '0x' || event_id AS hash, sec AS ts,
  CASE WHEN event_type = 'view' THEN 'w' || k ELSE 'w' || user_id END AS from_addr, CASE WHEN event_type = 'view' THEN 'w' || user_id ELSE 'w' || k END AS to_addr, value AS value_eth FROM ev)""",
    "lending": f"""lending AS (SELECT * FROM (SELECT 'w' || user_id AS address, {_c('user_id')} AS chain, CASE WHEN event_id % 3 = 0 THEN 'compound' ELSE 'aave' END AS family,
  CASE event_type WHEN 'purchase' THEN 'borrow' WHEN 'click' THEN 'repay' WHEN 'error' THEN 'liquidation' END AS kind, sec AS ts, sec // 12 AS block, event_id FROM ev) WHERE kind IS NOT NULL)""",
    "balances": f"balances AS (SELECT 's' || l_suppkey AS address, {_c('l_suppkey')} AS chain, 'c' || (l_partkey % 12) AS contract, CAST(trunc(l_extendedprice) AS DOUBLE) * 1000000 AS raw FROM lineitem)",
    "wallets": f"wallets AS (SELECT 'u' || c_custkey AS address, {_c('c_nationkey')} AS chain, CAST(300 + floor(abs(c_acctbal)) % 551 AS BIGINT) AS score, c_custkey FROM customer)",
    "history": f"history AS (SELECT 'w' || user_id AS address, {_c('user_id')} AS chain, sec AS ts, CAST(300 + floor(value * 10) % 551 AS BIGINT) AS score, event_id FROM ev)",
    "predictions": f"""predictions AS (SELECT o_orderkey AS id, (o_totalprice % 1000) / 1000 AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, {_c('o_custkey')} AS chain,
  o_orderkey % 400 AS age, o_orderkey % 7 AS borrows, CAST(850 - floor((o_totalprice % 1000) / 1000 * 550 + 0.5) AS BIGINT) AS score FROM orders)""",
    "loans": """loans AS (SELECT o_orderkey AS loan_id, 'u' || (o_orderkey % 100) AS lender, 'u' || o_custkey AS borrower, o_totalprice AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'REPAID' WHEN 'O' THEN 'ACTIVE' ELSE 'DEFAULTED' END AS status, CAST(epoch(o_orderdate) AS BIGINT) AS started FROM orders)""",
    "listings": """listings AS (SELECT o_orderkey AS listing_id, 'u' || (o_orderkey % 100) AS lender, o_totalprice AS amount, CAST(5 + o_orderkey % 6 AS DOUBLE) AS min_apr, CAST(12 + o_orderkey % 9 AS DOUBLE) AS max_apr,
  CASE o_orderkey % 3 WHEN 0 THEN 'USDC' WHEN 1 THEN 'ETH' ELSE 'DAI' END AS currency, CASE WHEN o_orderkey % 5 = 0 THEN 'SOLANA' ELSE 'EVM' END AS listing_chain, 450 + o_orderkey % 370 AS lender_score, CAST(o_orderkey % 160 AS DOUBLE) AS collateral_pct,
  400 + o_orderkey % 300 AS min_score, 30 + o_orderkey % 150 AS duration_days, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS status, CAST(epoch(o_orderdate) AS BIGINT) AS created, CAST(epoch(o_orderdate) AS BIGINT) + 86400 * 700 AS expires FROM orders)""",
    "applications": """applications AS (SELECT l_orderkey * 10 + l_linenumber AS application_id, l_orderkey AS listing_id, 'u' || l_suppkey AS borrower, 300 + (l_orderkey * 7 + l_linenumber * 131) % 551 AS borrower_score, l_extendedprice AS amount, CAST(epoch(l_shipdate) AS BIGINT) AS created,
  CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'R' THEN 'REJECTED' ELSE 'PENDING' END AS status FROM lineitem)""",
    "reviews": """reviews AS (SELECT l_orderkey * 10 + l_linenumber AS review_id, l_orderkey AS loan_id, 'u' || CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey % 100 ELSE l_suppkey END AS reviewer, 'u' || (l_suppkey % 100) AS reviewee,
  1 + l_linenumber % 5 AS rating, CAST(epoch(l_shipdate) AS BIGINT) AS created FROM lineitem)""",
    "usage": "usage AS (SELECT event_id, 'k' || (user_id % 20) AS api_key, sec AS ts FROM ev)",
    "requests": "requests AS (SELECT sec AS ts, value AS latency_ms, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 500 ELSE 503 END WHEN 'signup' THEN 429 ELSE 200 END AS status, CASE WHEN event_type NOT IN ('error', 'signup') THEN event_id % 2 = 0 END AS cached FROM ev)",
    "notes": "notes AS (SELECT event_id, 'w' || user_id AS address, sec AS created, event_id % 2 = 0 AS read FROM ev)",
}
_NEEDS_EV = {"transfers", "lending", "history", "usage", "requests", "notes"}


def with_views(*names: str) -> str:
    """WITH clause text for the named views (no leading WITH, no trailing comma)."""
    need = ["ev"] if _NEEDS_EV & set(names) and "ev" not in names else []
    return ",\n".join(SQL[n] for n in [*need, *names])
