"""Queries of the marketplace, usage, content, streaming and training operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import streaming
from tallyforge.functions import DAY, epoch_seconds
from tallyforge.operators import artifact, content, market, training, usage
from tallyforge.operators.register import EntityRegister
from tallyforge.plans.scratch import materialise, scratch_path
from tallyforge.queries import _D12, _GRADE, _PCT, _TREES, _X, DEMO_MODEL, MARKET_NOW, WALLET_MODEL, wallet_sources, QUERIES, SQL, _gapped, _weighted, query, r, scored_wallets
from tallyforge.sources import fixtures as v
from tallyforge.sources.fixtures import with_views
from tallyforge.streaming.state import WalletState, rescore_stream

__all__ = ["QUERIES", "SQL"]

# Marketplace


@query("i1_search_listings", f"""WITH {with_views('listings', 'wallets')}, f AS (SELECT * FROM listings WHERE status = 'OPEN' AND expires > {MARKET_NOW} AND amount >= 50000 AND max_apr <= 18 AND min_apr >= 6)
SELECT f.listing_id, f.lender, amount, min_apr, w.score AS lender_score_now, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 20) AS BIGINT) AS pages FROM (SELECT * FROM f ORDER BY min_apr, listing_id LIMIT 20 OFFSET 20) f LEFT JOIN wallets w ON w.address = f.lender""")
def _(s, d) -> DataFrame:
    x = market.search_listings(v.listings(s, d), v.wallets(s, d), now=MARKET_NOW, min_amount=50000, max_apr=18, min_apr=6, sort="lowest_apr", page=2)
    return x.select("listing_id", "lender", "amount", "min_apr", "lender_score_now", "total", "pages")


@query("i1_search_listings_by_lender", f"""WITH {with_views('listings')}, f AS (SELECT * FROM listings WHERE status = 'OPEN' AND expires > {MARKET_NOW} AND currency = 'ETH' AND listing_chain = 'EVM' AND amount <= 300000 AND duration_days BETWEEN 40 AND 160 AND lender_score >= 500)
SELECT listing_id, currency, lender_score, duration_days, (SELECT count(*) FROM f) AS total FROM f ORDER BY lender_score DESC, listing_id LIMIT 20""")
def _(s, d) -> DataFrame:
    x = market.search_listings(v.listings(s, d), v.wallets(s, d), now=MARKET_NOW, currency="ETH", chain="EVM", max_amount=300000, min_duration=40, max_duration=160, min_lender_score=500, sort="highest_lender_score")
    return x.select("listing_id", "currency", "lender_score", "duration_days", "total")


@query("i2_marketplace_stats", f"WITH {with_views('listings', 'loans', 'wallets')} SELECT (SELECT count(*) FROM listings WHERE status = 'OPEN') AS open_listings, (SELECT count(*) FROM loans WHERE status = 'REPAID') AS repaid_loans, round((SELECT sum(amount) FROM loans WHERE status IN ('REPAID', 'ACTIVE')), 2) AS volume, CAST((SELECT floor(avg(score) + 0.5) FROM wallets) AS BIGINT) AS mean_score")
def _(s, d) -> DataFrame:
    return market.marketplace_stats(v.listings(s, d), v.loans(s, d), v.wallets(s, d)).withColumn("volume", r("volume", 2))


@query("i3_application_eligibility", f"""WITH {with_views('applications', 'listings', 'wallets')}, live AS (SELECT DISTINCT listing_id, borrower FROM applications WHERE status IN ('PENDING', 'ACCEPTED'))
SELECT a.application_id, CASE WHEN l.status IS NULL OR l.status <> 'OPEN' THEN 'listing not open' WHEN a.amount > l.amount THEN 'amount above listing' WHEN w.score IS NULL THEN 'wallet not scored' WHEN w.score < l.min_score THEN 'score too low' WHEN v.listing_id IS NOT NULL THEN 'already applied' ELSE 'ok' END AS reason
FROM applications a LEFT JOIN listings l USING (listing_id) LEFT JOIN wallets w ON w.address = a.borrower LEFT JOIN live v ON v.listing_id = a.listing_id AND v.borrower = a.borrower WHERE a.status = 'REJECTED'""")
def _(s, d) -> DataFrame:
    a = v.applications(s, d)
    return market.application_eligibility(a.where("status = 'REJECTED'"), v.listings(s, d), v.wallets(s, d), a.where("status in ('PENDING', 'ACCEPTED')")).select("application_id", "reason")


_APR = "CASE WHEN score <= min_score THEN max_apr WHEN score >= 850 THEN min_apr ELSE floor((max_apr - (score - min_score) / (850 - min_score) * (max_apr - min_apr)) * 100 + 0.5) / 100 END"


@query("i4_offered_apr", f"WITH {with_views('wallets')}, x AS (SELECT address, score, 400 + c_custkey % 300 AS min_score, CAST(5 + c_custkey % 6 AS DOUBLE) AS min_apr, CAST(12 + c_custkey % 9 AS DOUBLE) AS max_apr FROM wallets) SELECT address, {_APR} AS apr FROM x")
def _(s, d) -> DataFrame:
    k = F.col("c_custkey")
    return v.wallets(s, d).select("address", market.offered_apr(F.col("score"), 400 + k % 300, (5 + k % 6).cast("double"), (12 + k % 9).cast("double")).alias("apr"))


@query("i5_originate_loans", f"""WITH {with_views('applications', 'listings')}, won AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY created, application_id) AS rn FROM applications WHERE status = 'ACCEPTED'),
x AS (SELECT won.listing_id, won.application_id, won.borrower, won.amount, won.created, l.min_apr, l.max_apr, l.min_score, l.duration_days, l.currency, l.collateral_pct, won.borrower_score AS score FROM won JOIN listings l USING (listing_id) WHERE rn = 1)
SELECT listing_id, application_id, borrower, {_APR} AS apr, currency, round(amount * (collateral_pct / 100), 6) AS collateral, round(amount * 0.0075, 6) AS fee, round(amount - amount * 0.0075, 6) AS net_amount, created + duration_days * 86400 AS due FROM x""")
def _(s, d) -> DataFrame:
    x = market.originate_loans(v.applications(s, d), v.listings(s, d))
    return x.select("listing_id", "application_id", "borrower", "apr", "currency", r("collateral").alias("collateral"), r("fee").alias("fee"), r("net_amount").alias("net_amount"), "due")


_RATED = "rated AS (SELECT reviewee AS address, avg(rating) AS mean_rating, count(*) AS reviews FROM (SELECT *, row_number() OVER (PARTITION BY reviewee ORDER BY created DESC, review_id DESC) AS rn FROM reviews) WHERE rn <= 10 GROUP BY reviewee)"
_SIDES = "sides AS (SELECT lender AS address, 'lender' AS side, loan_id, amount, status, started FROM loans UNION ALL SELECT borrower, 'borrower', loan_id, amount, status, started FROM loans)"


@query("i6_wallet_dashboard", f"""WITH {with_views('wallets', 'loans', 'reviews', 'listings')}, {_SIDES}, {_RATED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY started DESC, loan_id DESC, side) AS rn FROM sides WHERE status <> 'ACTIVE') WHERE rn <= 20),
sm AS (SELECT address, sum(CASE WHEN side = 'lender' THEN amount ELSE 0 END) AS l, sum(CASE WHEN side = 'borrower' THEN amount ELSE 0 END) AS b, count(*) FILTER (status = 'REPAID') AS repaid FROM top GROUP BY address), ct AS (SELECT lender AS address, count(*) AS n FROM listings GROUP BY lender)
SELECT w.address, score, round(coalesce(l, 0), 2) AS total_lent, round(coalesce(b, 0), 2) AS total_borrowed, coalesce(repaid, 0) AS repaid, round(mean_rating, 6) AS mean_rating, coalesce(n, 0) AS listings FROM wallets w LEFT JOIN sm USING (address) LEFT JOIN rated USING (address) LEFT JOIN ct USING (address)""")
def _(s, d) -> DataFrame:
    x = market.wallet_dashboard(v.wallets(s, d), v.loans(s, d), v.reviews(s, d), v.listings(s, d))
    return x.withColumns({"total_lent": r("total_lent", 2), "total_borrowed": r("total_borrowed", 2), "mean_rating": r("mean_rating")})


@query("i7_wallet_profile", f"""WITH {with_views('wallets', 'loans', 'reviews', 'listings')}, {_SIDES}, {_RATED}, sm AS (SELECT address, count(*) FILTER (side = 'lender') AS l, count(*) FILTER (side = 'borrower') AS b FROM sides WHERE status = 'REPAID' GROUP BY address), ct AS (SELECT lender AS address, count(*) AS n FROM listings WHERE status = 'OPEN' GROUP BY lender)
SELECT w.address, score, coalesce(l, 0) AS repaid_as_lender, coalesce(b, 0) AS repaid_as_borrower, round(mean_rating, 6) AS mean_rating, coalesce(reviews, 0) AS review_count, coalesce(n, 0) AS open_listings FROM wallets w LEFT JOIN sm USING (address) LEFT JOIN rated USING (address) LEFT JOIN ct USING (address)""")
def _(s, d) -> DataFrame:
    return market.wallet_profile(v.wallets(s, d), v.loans(s, d), v.reviews(s, d), v.listings(s, d)).withColumn("mean_rating", r("mean_rating"))


@query("i8_listing_detail", f"""WITH {with_views('listings', 'applications')} SELECT l.listing_id, l.lender, count(a.application_id) AS n_applications, coalesce(string_agg(CAST(a.application_id AS VARCHAR), ',' ORDER BY a.created DESC, a.application_id), '') AS applications FROM listings l LEFT JOIN applications a USING (listing_id) GROUP BY ALL""")
def _(s, d) -> DataFrame:
    x = market.listing_detail(v.listings(s, d), v.applications(s, d))
    return x.select("listing_id", "lender", F.size("applications").cast("long").alias("n_applications"), F.array_join(F.transform("applications", lambda a: a["application_id"].cast("string")), ",").alias("applications"))


@query("i9_review_eligibility", f"""WITH {with_views('reviews', 'loans')}, j AS (SELECT review_id, loan_id, reviewer, created, CASE WHEN review_id % 7 = 0 THEN 6 ELSE rating END AS rating, status, lender, borrower FROM reviews LEFT JOIN loans USING (loan_id)), f AS (SELECT *, rating BETWEEN 1 AND 5 AND status = 'REPAID' AND reviewer IN (lender, borrower) AS stored FROM j)
SELECT review_id, CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'bad rating' WHEN status IS NULL OR status <> 'REPAID' THEN 'loan not repaid' WHEN NOT stored THEN 'not a party' WHEN EXISTS (SELECT 1 FROM f e WHERE e.stored AND e.loan_id = f.loan_id AND e.reviewer = f.reviewer AND (e.created < f.created OR e.created = f.created AND e.review_id < f.review_id)) THEN 'already reviewed' ELSE 'ok' END AS reason FROM f""")
def _(s, d) -> DataFrame:
    x = v.reviews(s, d).withColumn("rating", F.when(F.col("review_id") % 7 == 0, 6).otherwise(F.col("rating")))
    return market.review_eligibility(x, v.loans(s, d)).select("review_id", "reason")


@query("i10_lender_eligibility", f"WITH {with_views('listings', 'wallets')} SELECT listing_id, CASE WHEN amount - 900 <= 0 OR amount > 1e9 THEN 'amount' WHEN max_apr > 1000 THEN 'apr range' WHEN duration_days - 31 NOT BETWEEN 1 AND 3650 THEN 'duration' WHEN min_score NOT BETWEEN 300 AND 850 THEN 'borrower score' WHEN max_apr - 7 < min_apr THEN 'apr bounds' WHEN expires <= {MARKET_NOW} THEN 'expiry' WHEN score IS NULL THEN 'wallet not scored' WHEN score < 500 THEN 'score too low' ELSE 'ok' END AS reason FROM listings LEFT JOIN wallets ON wallets.address = listings.lender")
def _(s, d) -> DataFrame:
    x = v.listings(s, d).withColumns({"amount": F.col("amount") - 900, "duration_days": F.col("duration_days") - 31, "max_apr": F.col("max_apr") - 7})
    return market.lender_eligibility(x, v.wallets(s, d), now=MARKET_NOW).select("listing_id", "reason")


@query("i11_notification_feed", f"WITH {with_views('notes')} SELECT address, count(*) AS shown, count(*) FILTER (NOT read) AS unread, max(created) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY created DESC, event_id DESC) AS rn FROM notes) WHERE rn <= 50 GROUP BY address")
def _(s, d) -> DataFrame:
    return market.notification_feed(v.notifications(s, d))


# Usage

_PLANS = "plans(plan, price, quota, overage) AS (VALUES ('free', 0e0, 100, NULL), ('starter', 99e0, 200, 0.12e0), ('growth', 499e0, 300, 0.008e0), ('enterprise', NULL, 0, NULL))"
_SUBS = "subs AS (SELECT 'k' || range AS api_key, CASE range % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' WHEN 2 THEN 'mystery' ELSE NULL END AS asked FROM range(20)), terms AS (SELECT u.api_key, p.* FROM (SELECT DISTINCT api_key FROM usage) u LEFT JOIN subs USING (api_key) JOIN plans p ON p.plan = CASE WHEN asked IN ('free', 'starter', 'growth', 'enterprise') THEN asked ELSE 'free' END)"


def _usage(s):
    """Plans with quotas sized to the sample tables, and subscriptions."""
    plans = s.createDataFrame([("free", 0.0, 100, None), ("starter", 99.0, 200, 0.12), ("growth", 499.0, 300, 0.008), ("enterprise", None, 0, None)], "plan string, price double, quota long, overage double")
    subs = s.range(20).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("api_key"), F.when(F.col("id") % 4 == 0, "starter").when(F.col("id") % 4 == 1, "growth").when(F.col("id") % 4 == 2, "mystery").alias("plan"))
    return plans, subs


@query("j1_meter_usage", f"""WITH {with_views('usage')}, {_PLANS}, {_SUBS}, n AS (SELECT *, row_number() OVER (PARTITION BY api_key, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m') ORDER BY ts, event_id) AS used FROM usage), o AS (SELECT n.event_id, n.api_key, used, quota, overage, CASE WHEN overage IS NULL OR used <= quota THEN 0 ELSE (used - quota) * CAST(overage AS DECIMAL(12,6)) END AS usd FROM n JOIN terms USING (api_key))
SELECT event_id, api_key, used, CASE WHEN used > quota AND overage IS NULL THEN 'QUOTA_EXCEEDED' WHEN used > quota AND usd > 5 THEN 'OVERAGE_CAP_REACHED' END AS reason, NOT (used > quota AND (overage IS NULL OR usd > 5)) AS allowed FROM o""")
def _(s, d) -> DataFrame:
    plans, subs = _usage(s)
    return usage.meter_usage(v.usage_calls(s, d), subs, plans, cap=5).select("event_id", "api_key", F.col("used").cast("long").alias("used"), "reason", "allowed")


@query("j2_usage_rollup", f"""WITH {with_views('usage')}, {_PLANS}, {_SUBS}, n AS (SELECT api_key, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS used FROM usage GROUP BY ALL)
SELECT api_key, month, plan, used, CAST(greatest(0, quota - used) AS BIGINT) AS remaining, round(CASE WHEN overage IS NULL OR used <= quota THEN 0 ELSE (used - quota) * overage END, 6) AS overage_usd FROM n JOIN terms USING (api_key)""")
def _(s, d) -> DataFrame:
    plans, subs = _usage(s)
    return usage.usage_rollup(v.usage_calls(s, d), subs, plans).withColumn("overage_usd", r(F.col("overage_usd").cast("double")))


@query("j3_tier_economics", f"""WITH {with_views('usage')}, n AS (SELECT api_key, count(*) AS quota, CAST(substr(api_key, 2) AS INT) * 10e0 AS price FROM usage GROUP BY api_key)
SELECT api_key AS plan, price, round(price / quota, 6) AS revenue_per_score, CASE WHEN price > 0 THEN floor((price / quota - 0.0005) / (price / quota) * 1000 + 0.5) / 10 END AS margin_pct FROM n""")
def _(s, d) -> DataFrame:
    own = v.usage_calls(s, d).groupBy(F.col("api_key").alias("plan")).agg(F.count("*").alias("quota")).withColumn("price", F.substring("plan", 2, 9).cast("int") * F.lit(10.0))
    return usage.tier_economics(own).withColumn("revenue_per_score", r("revenue_per_score"))


@query("j4_subscription_state", f"""WITH {with_views('usage')}, b AS (SELECT 'k' || (user_id % 20) AS api_key, CASE k % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' ELSE 'free' END AS plan, CASE event_type WHEN 'purchase' THEN 'active' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'past_due' ELSE 'active' END WHEN 'error' THEN 'canceled' END AS status, sec, event_id FROM (SELECT * REPLACE (CAST(k AS INT) AS k) FROM ev) WHERE event_id % 3 <> 0 AND event_id % 7 NOT IN (0, 1, 2))
SELECT api_key, arg_max(plan, sec * 1000000 + event_id) AS plan, arg_max(status, sec * 1000000 + event_id) AS status FROM b WHERE status IS NOT NULL GROUP BY api_key""")
def _(s, d) -> DataFrame:
    e, k = v._events(s, d), F.col("k").cast("int")
    kind = F.when(F.col("event_type") == "purchase", "checkout.session.completed").when(F.col("event_type") == "click", "customer.subscription.updated").when(F.col("event_type") == "error", "customer.subscription.deleted").otherwise("invoice.paid")
    seven = F.col("event_id") % 7  # empty keys, empty plans, and keys that are numbers
    key = F.when(seven == 0, "").otherwise(F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")))
    plan = F.when(seven == 1, "").when(k % 3 == 0, "starter").when(k % 3 == 1, "growth").otherwise("free")
    meta = F.when(F.col("event_id") % 3 != 0, F.struct(key.alias("apiKeyId"), plan.alias("planId")))
    body = F.to_json(F.struct(meta.alias("metadata"), F.when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0), "past_due").alias("status")))
    body = F.when(seven == 2, F.regexp_replace(body, '"k([0-9]+)"', "$1")).otherwise(body)
    return usage.subscription_state(e.select(kind.alias("type"), body.alias("body"), F.col("sec").alias("at"), "event_id"))


_OPS_NOW = 1705708800


def _outbox(s, d):
    e, k = v._events(s, d), F.col("k").cast("int")
    return e.select("event_id", F.col("sec").alias("ts"), F.col("value").alias("amount"), F.when(k % 3 == 0, "x").when(k % 3 == 1, "email").otherwise("seo").alias("channel"), F.when(F.col("event_type").isin("purchase", "click"), "EXECUTED").otherwise("PENDING").alias("status"), F.when(k % 4 == 0, "POST").otherwise("SPEND").alias("kind"))


_OUT = "outbox AS (SELECT event_id, sec AS ts, value AS amount, CASE CAST(k AS INT) % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'email' ELSE 'seo' END AS channel, CASE WHEN event_type IN ('purchase', 'click') THEN 'EXECUTED' ELSE 'PENDING' END AS status, CASE CAST(k AS INT) % 4 WHEN 0 THEN 'POST' ELSE 'SPEND' END AS kind FROM ev)"


@query("j5_ops_digest", f"""WITH {with_views('usage')}, {_OUT}, o AS (SELECT count(*) FILTER (status = 'PENDING') AS pending, round(coalesce(sum(amount) FILTER (kind = 'SPEND' AND status = 'EXECUTED' AND ts BETWEEN {_OPS_NOW} - 86400 AND {_OPS_NOW}), 0), 4) AS spend FROM outbox)
SELECT 'agent' || (user_id % 3) AS agent, event_type AS status, count(*) AS n, round(sum(value / 100), 4) AS cost, any_value(pending) AS pending, any_value(spend) AS spend FROM ev, o WHERE sec >= {_OPS_NOW} - 86400 AND sec <= {_OPS_NOW} GROUP BY 1, 2""")
def _(s, d) -> DataFrame:
    runs = v._events(s, d).select(F.concat(F.lit("agent"), (F.col("user_id") % 3).cast("string")).alias("agent"), F.col("event_type").alias("status"), F.col("sec").alias("ts"), (F.col("value") / 100).alias("cost"))
    return usage.ops_digest(runs, _outbox(s, d), now=_OPS_NOW).withColumns({"cost": r("cost", 4), "spend": r("spend", 4)})


@query("j6_spend_cap_audit", f"""WITH {with_views('usage')}, {_OUT}, x AS (SELECT *, sum(CAST(amount AS DECIMAL(18,6))) OVER (PARTITION BY ts // 86400 ORDER BY ts, event_id) AS ds, sum(CAST(amount AS DECIMAL(18,6))) OVER (PARTITION BY ts // 86400, channel ORDER BY ts, event_id) AS cs FROM outbox WHERE status = 'EXECUTED') SELECT event_id, round(CAST(ds AS DOUBLE), 3) AS day_spend, round(CAST(cs AS DOUBLE), 3) AS channel_spend, ds > 500 OR cs > 200 AS over_cap FROM x""")
def _(s, d) -> DataFrame:
    x = usage.spend_cap_audit(_outbox(s, d), day_cap=500, channel_cap=200)
    return x.select("event_id", r(F.col("day_spend").cast("double"), 3).alias("day_spend"), r(F.col("channel_spend").cast("double"), 3).alias("channel_spend"), "over_cap")


@query("j7_csp_summary", f"""WITH {with_views('usage')}, x AS (SELECT 'd' || (CAST(k AS INT) % 5) AS directive, 'https://b' || (CAST(k AS INT) % 7) AS blocked, CASE WHEN event_type = 'click' THEN 'report' ELSE 'enforce' END AS disposition FROM ev WHERE event_type IN ('click', 'purchase'))
SELECT directive, disposition, count(*) AS n, count(DISTINCT blocked) AS blocked_uris FROM x GROUP BY ALL""")
def _(s, d) -> DataFrame:
    k = F.col("k").cast("int")
    directive, blocked = F.concat(F.lit("d"), (k % 5).cast("string")), F.concat(F.lit("https://b"), (k % 7).cast("string"))
    old = F.to_json(F.struct(F.struct(directive.alias("violated-directive"), blocked.alias("blocked-uri"), F.lit("report").alias("disposition")).alias("csp-report")))
    new = F.to_json(F.array(F.struct(F.lit("csp-violation").alias("type"), F.struct(directive.alias("effectiveDirective"), blocked.alias("blockedURL"), F.lit("enforce").alias("disposition")).alias("body")), F.struct(F.lit("deprecation").alias("type"), F.struct(directive.alias("effectiveDirective"), blocked.alias("blockedURL"), F.lit("x").alias("disposition")).alias("body"))))
    body = F.when(F.col("event_type") == "click", old).when(F.col("event_type") == "purchase", new).when(F.col("event_type") == "error", "[{").otherwise("{}")
    return usage.csp_summary(v._events(s, d).select(body.alias("body")))


# Content


_SAY = ["We partnered with Globex Finance today.", 'He said it plainly: "the best tool we ever used" - Jane Roe', "Our model flags 88% of cases. Trusted by Aave, and by everyone.", "Over 25K+ wallets scored since 2024. Now live on base and launching on Initech.", "Run `scan --top 999` on v5,000 builds, see https://site.example/x?n=42",
        "Bye {{unsubscribe_url}} we are the team behind Hooli and we are official us", "see https://own.example/a-b now, https://own.example and https://other.example/a; on behalf of us all, ON BEHALF OF Acme"]


def _content(s, d):
    """Every document's own text with a line that a claims check has something to say on."""
    k = F.col("doc_id")
    say = F.element_at(F.array(*(F.lit(x) for x in _SAY)), (k % 7 + 1).cast("int"))
    channel = F.element_at(F.array(*(F.lit(c) for c in content.CADENCE)), (k % 5 + 1).cast("int"))
    return v.table(s, d, "documents").select("doc_id", channel.alias("channel"), (1706745600 + k * 311).alias("posted"), F.concat_ws("\n", "text", say).alias("text"))


_CONTENT = "content AS (SELECT doc_id, [" + ", ".join(f"'{c}'" for c in content.CADENCE) + "][doc_id % 5 + 1] AS channel, concat_ws(chr(10), text, [" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SAY) + "][doc_id % 7 + 1]) AS text FROM documents)"


def _facts(s):
    return s.createDataFrame([(0.8815, "ratio", True), (254729.0, "count", True), (20717.0, "count", True), (25000.0, "count", False)], "value double, unit string, verified boolean")


# Fixed value: the number pattern, for an engine without look-behind: digits that stand behind an identifier are marked by a control character first.
_NUM = r"'(' || chr(1) || '?)(\d[\d,]*(?:\.\d+)?)\s*([kKmMbB])?\s*(\+)?\s*(%|percent)?'"


def _claims(content: str) -> str:
    parts = ", ".join(f"unnest(regexp_extract_all(t, {_NUM}, {i})) AS {n}" for i, n in enumerate(("raw", "glued", "digits", "suffix", "plus", "percent")))
    return rf"""stripped AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', ' ', 'g'), '`[^`]*`', ' ', 'g'), '([A-Za-z_#@/-])(\d)', '\1' || chr(1) || '\2', 'g') AS t FROM {content}),
found AS (SELECT doc_id, {parts}, unnest(range(len(regexp_extract_all(t, {_NUM}, 0)))) AS pos FROM stripped),
claims AS (SELECT doc_id, CAST(pos AS INT) AS pos, regexp_replace(raw, '\s+$', '') AS raw, CAST(replace(digits, ',', '') AS DOUBLE) * CASE lower(suffix) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END AS magnitude, coalesce(plus, '') <> '' AS is_bound, coalesce(percent, '') <> '' AS is_percent
 FROM found WHERE glued = '' AND NOT (regexp_full_match(replace(digits, ',', ''), '(19|20)\d\d') AND suffix = '' AND plus = '' AND percent = '')),
facts(value, ratio) AS (VALUES (0.8815e0, false), (88.15e0, true), (254729e0, false), (20717e0, false)), shape AS (SELECT *, length(regexp_replace(split_part(raw, '.', 2), '\D', '', 'g')) AS d FROM claims),
faults AS (SELECT doc_id, pos, raw, magnitude, is_bound, is_percent FROM shape c WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE (NOT ratio OR is_percent) AND CASE WHEN is_bound THEN magnitude > 0 AND value >= magnitude
 AND floor(value / power(10e0, floor(log10(magnitude)) - (length(regexp_replace(CAST(CAST(round(magnitude) AS HUGEINT) AS VARCHAR), '0+$', '')) - 1))) * power(10e0, floor(log10(magnitude)) - (length(regexp_replace(CAST(CAST(round(magnitude) AS HUGEINT) AS VARCHAR), '0+$', '')) - 1)) = magnitude
 ELSE abs(value - magnitude) <= CASE WHEN d > 0 THEN power(10e0, -d) ELSE 0.5 END END))"""


@query("k1_numeric_claims", f"WITH {_CONTENT}, {_claims('content')} SELECT * FROM claims")
def _(s, d) -> DataFrame:
    return content.numeric_claims(_content(s, d))


@query("k2_claim_violations", f"WITH {_CONTENT}, {_claims('content')} SELECT * FROM faults")
def _(s, d) -> DataFrame:
    return content.claim_violations(content.numeric_claims(_content(s, d)), _facts(s))


_NAME = r"([\w.$-]+(?:\s+[A-Z][\w.$-]*)*)"
# The phrases of the check, written for the other engine; a name that begins with the own one is left out afterwards, as it has no look-ahead.
_PHRASES = [
    ("partnership", rf"(?i)\b(?:partner(?:ed|ship|ing)?\s+with|official\s+partner\s+of)\s+{_NAME}", 1), ("endorsement", rf"(?i)\b(?:backed|endorsed|approved|audited|vetted)\s+by\s+{_NAME}", 1), ("endorsement", rf"(?i)\btrusted\s+by\s+{_NAME}", 1),
    ("partnership", rf"(?i)\b(?:integrated|integration)\s+with\s+{_NAME}", 1), ("partnership", rf"(?i)\b(?:now\s+live|launching)\s+on\s+{_NAME}", 1), ("endorsement", rf"(?i)\bused\s+by\s+(?:teams\s+at\s+)?{_NAME}", 1),
    ("testimonial", r'["“][^"”]{10,}["”]\s*[-,]{1,2}\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)', 0), ("testimonial", r"\b(?:says|said)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*[,:]", 0),
    ("impersonation", r"(?i)\bwe\s+are\s+(?:the\s+)?(?:team\s+behind|official)\s+([A-Z][\w.$-]*)", 0), ("impersonation", r"(?i)\bon\s+behalf\s+of\s+([A-Z][\w.$-]*)", 0),
]
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {proper} AS proper, unnest(regexp_extract_all(text, '{p}', 1)) AS entity FROM content" for kind, p, proper in _PHRASES)


_COVERED_SQL = rf"""CASE WHEN kind = 'impersonation' THEN NOT regexp_matches(entity, '(?i)^us\b') ELSE regexp_replace(lower(trim(entity)), '[.,;:!?]+$', '') NOT IN ({', '.join(f"'{n}'" for n in (*content.COVERED, 'us'))}) END"""


@query("k3_proof_violations", rf"""WITH {_CONTENT}, f AS ({_FOUND}) SELECT doc_id, kind, entity FROM f WHERE (proper = 0 OR regexp_matches(entity, '^[A-Z0-9$]'))
AND {_COVERED_SQL}""")
def _(s, d) -> DataFrame:
    return content.proof_violations(_content(s, d))


_SITE_LINK = r"(https://own\.example(?:/[\w/#-]*)?)"
_POSTS = f"""body AS (SELECT doc_id, channel, doc_id * 311 + 1706745600 AS posted, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Over 777 rows' ELSE 'News' END AS title, regexp_replace(text, '{_SITE_LINK}', '\\1?utm_source=' || channel || '&utm_medium=autopilot', 'g') AS text FROM content),
whole AS (SELECT doc_id, coalesce(title, '') || chr(10) || text AS text FROM body)"""


@query("k4_publish_decision", rf"""WITH {_CONTENT}, {_POSTS}, {_claims('whole')}, f AS ({_FOUND.replace('FROM content', 'FROM whole')}), proofs AS (SELECT doc_id FROM f WHERE (proper = 0 OR regexp_matches(entity, '^[A-Z0-9$]')) AND {_COVERED_SQL}),
j AS (SELECT *, doc_id IN (SELECT doc_id FROM faults) OR doc_id IN (SELECT doc_id FROM proofs) OR channel = 'email' AND NOT contains(text, '{{{{unsubscribe_url}}}}') AS blocked FROM body),
n AS (SELECT *, row_number() OVER (PARTITION BY channel, posted // 86400, blocked ORDER BY posted, doc_id) AS turn FROM j)
SELECT doc_id, channel, CASE WHEN blocked THEN 'BLOCKED' WHEN turn > CASE channel {' '.join(f"WHEN '{c}' THEN {n}" for c, n in content.CADENCE.items())} END THEN 'deferred' ELSE 'ready' END AS decision FROM n""")
def _(s, d) -> DataFrame:
    """Every document as a post, with a title on three of four."""
    k = F.col("doc_id") % 4
    x = _content(s, d).withColumn("title", F.when(k == 1, "Over 777 rows").when(k > 1, "News"))
    return content.check_and_decide(x, _facts(s), site="own.example").select("doc_id", "channel", "decision")


@query("k5_tag_links", rf"WITH {_CONTENT} SELECT doc_id, regexp_replace(text, '(https://own\.example(?:/[\w/#-]*)?)', '\1?utm_source=' || channel || '&utm_medium=autopilot', 'g') AS text FROM content")
def _(s, d) -> DataFrame:
    return content.tag_links(_content(s, d), site="own.example").select("doc_id", "text")


# Streaming


def _stream(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    e = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a glob, as a stream's path may not be a single file
    return e.withColumn("sec", epoch_seconds(F.col("ts"))).withColumn("at", F.timestamp_seconds("sec"))


@query("s1_stream_usage", f"WITH {with_views('usage')} SELECT api_key, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS used FROM usage GROUP BY ALL")
def _(s, d) -> DataFrame:
    calls = _stream(s, d).select(F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("api_key"), "at")
    days = streaming.latest(streaming.run_available(streaming.stream_usage(calls), "usage", mode="update"), ["api_key", "day"])
    month = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("day") / DAY).cast("int")), "yyyy-MM")
    return days.groupBy("api_key", month.alias("month")).agg(F.sum("calls").alias("used"))


@query("s2_stream_activity", f"WITH {with_views('transfers')} SELECT address, ts // 86400 * 86400 AS day, count(*) AS tx_count FROM transfers GROUP BY ALL")
def _(s, d) -> DataFrame:
    t = _stream(s, d).select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), F.concat(F.lit("0x"), F.col("event_id").cast("string")).alias("hash"), "at")
    got = streaming.latest(streaming.run_available(streaming.stream_activity(t), "activity", mode="update"), ["address", "start"])
    return got.select("address", F.unix_seconds("start").alias("day"), "tx_count")


@query("s3_stream_score_changes", f"WITH {with_views('history')} SELECT address, chain, event_id, score FROM (SELECT *, lag(score) OVER (PARTITION BY address, chain ORDER BY ts, event_id) AS p FROM history) WHERE p IS NULL OR abs(score - p) >= 10")
def _(s, d) -> DataFrame:
    x = _stream(s, d).select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), v._chain(F.col("user_id")).alias("chain"), F.col("sec").alias("ts"), "event_id", (300 + F.floor(F.col("value") * 10) % 551).cast("long").alias("score"))
    return streaming.run_available(streaming.stream_score_changes(x), "changes").select("address", "chain", "event_id", "score")


@query("s4_stream_burst", f"WITH {with_views('transfers')}, g AS (SELECT address, (ts // 86400 - i) * 86400 AS start FROM transfers, (SELECT unnest(range(7)) AS i)), c AS (SELECT address, start, count(*) AS n FROM g GROUP BY ALL) SELECT address, max(n) AS peak FROM c GROUP BY address")
def _(s, d) -> DataFrame:
    t = _stream(s, d).select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), "at")
    got = streaming.latest(streaming.run_available(streaming.stream_burst(t), "burst", mode="update"), ["address", "start"])
    return got.groupBy("address").agg(F.max("in_window").alias("peak"))


@query("s2_stream_activity_sliding", f"WITH {with_views('transfers')}, g AS (SELECT address, (ts // 86400 - i) * 86400 AS start FROM transfers, (SELECT unnest(range(30)) AS i)) SELECT address, start, count(*) AS tx_count FROM g GROUP BY ALL")
def _(s, d) -> DataFrame:
    """The 30-day form: a window a day, of 30 days each."""
    t = _stream(s, d).select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), F.concat(F.lit("0x"), F.col("event_id").cast("string")).alias("hash"), "at")
    got = streaming.latest(streaming.run_available(streaming.stream_activity(t, width="30 days", slide="1 day"), "activity30", mode="update"), ["address", "start"])
    return got.select("address", F.unix_seconds("start").alias("start"), "tx_count")


@query("s5_stream_rescore", f"""WITH {_D12}, touched AS (SELECT DISTINCT address, chain FROM lending WHERE kind = 'borrow') SELECT address, chain, CAST(CASE WHEN kept THEN 600 + n % 50 ELSE own END AS BIGINT) AS score, CAST(CASE WHEN kept THEN 610 + n % 50 ELSE model_score END AS BIGINT) AS model_score FROM e JOIN touched USING (address, chain)""")
def _(s, d) -> DataFrame:
    """Wallets that a borrow touched are scored anew by the whole scorer."""
    path = scratch_path(s, "rescore")
    act = _stream(s, d).where("event_type = 'purchase'").select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), v._chain(F.col("user_id")).alias("chain"))
    rescore = lambda keys: scored_wallets(s, d).join(keys, ["address", "chain"], "left_semi").select("address", "chain", "score", "model_score")
    streaming.stream_rescore(act, rescore, lambda df, b: df.write.mode("overwrite").parquet(f"{path}/out/b={b}"), f"{path}/state").awaitTermination()
    return s.read.parquet(f"{path}/out/*").dropDuplicates(["address", "chain"]).select("address", "chain", "score", "model_score")


@query("s5_rescore_by_state", f"""WITH {_D12}, touched AS (SELECT DISTINCT address, chain FROM transfers WHERE CAST(substr(hash, 3) AS BIGINT) % 4 = 3)
SELECT address, chain, CAST(CASE WHEN kept THEN 600 + n % 50 ELSE own END AS BIGINT) AS score, CAST(CASE WHEN kept THEN 610 + n % 50 ELSE model_score END AS BIGINT) AS model_score FROM e JOIN touched USING (address, chain)""")
def _(s, d) -> DataFrame:
    """The events in four batches, each merged into the stored state; what the last batch touched is scored from the state, and equals scores from all history."""
    path = scratch_path(s, "state")
    for i in range(4):
        v.table(s, d, "events").where(F.col("event_id") % 4 == i).coalesce(1).write.parquet(f"{path}/in/b={i}")
    batches = s.readStream.schema(v.table(s, d, "events").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/in/*")
    state = WalletState(s, f"{path}/state", partitions=8)
    rescore = lambda keys: state.rescore(keys, WALLET_MODEL, as_of=v.AS_OF, **wallet_sources(s, d, keys)).select("address", "chain", "score", "model_score")
    split = lambda df: (v.transfers_of(v.events_of(df)), v.lending_of(v.events_of(df)))
    rescore_stream(batches, split, state, rescore, lambda df, b: df.write.mode("overwrite").parquet(f"{path}/out/b={b}"), f"{path}/checkpoint").awaitTermination()
    return s.read.parquet(f"{path}/out/b=3").select("address", "chain", "score", "model_score")


# The entity register

_BRIDGES = """br AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT 'w' || user_id AS x, 'w' || json_extract_string(props, '$.k') AS y FROM events WHERE event_type = 'signup') WHERE x <> y),
kept AS (SELECT a, b FROM br WHERE (CAST(substr(a, 2) AS INT) * 7 + CAST(substr(b, 2) AS INT)) % 5 <> 0), un AS (SELECT a AS u, b AS v FROM kept UNION SELECT b, a FROM kept)"""


@query("g10_entity_register", f"""WITH RECURSIVE {_BRIDGES}, reach(u, v) AS (SELECT u, v FROM un UNION SELECT r.u, un.v FROM reach r JOIN un ON r.v = un.u), comp AS (SELECT u AS address, least(u, min(v)) AS entity_id FROM reach GROUP BY u)
SELECT address, entity_id, (SELECT count(*) FROM br) AS merges, (SELECT count(*) FROM br) - (SELECT count(*) FROM kept) AS reversals FROM comp""")
def _(s, d) -> DataFrame:
    """The bridge links in three batches, each with reversals of earlier links; the members in force, and the audit's counts."""
    e = v._events(s, d).where("event_type = 'signup'").select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("x"), F.concat(F.lit("w"), F.col("k")).alias("y")).where("x <> y")
    n = lambda c: F.substring(c, 2, 9).cast("int")
    links = materialise(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().withColumns({"confidence": F.lit(0.9), "signals": F.array(F.lit("bridge")), "turn": (n("a") + n("b")) % 3, "bad": (n("a") * 7 + n("b")) % 5 == 0}))
    register = EntityRegister(s, scratch_path(s, "register"), partitions=8)
    for batch in range(4):  # a bad link is reversed a batch after it came
        register.take(links.where(F.col("turn") == batch), links.where(F.col("bad") & (F.col("turn") == batch - 1)), at=batch, batch=batch)
    told = register.audit.read().agg(F.count_if(F.col("action") == "merge").alias("merges"), F.count_if(F.col("action") == "reverse").alias("reversals"))
    return register.members.read().select("address", "entity_id").crossJoin(F.broadcast(told))  # one row


# Training


@query("d13_train")
def _(s, d) -> DataFrame:
    """Boosted trees (stopped early on held-out rows) and the baseline, applied: p of each per vector."""
    x = v.feature_rows(s, d).select("vec_id", "features", "label")
    gbt, base = training.train(x.withColumn("held", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0), held="held")
    a, b = training.predictions(gbt, x).select("vec_id", r("p").alias("p_trees")), training.predictions(base, x).select("vec_id", r("p").alias("p_linear"))
    return a.join(b, "vec_id")


_NAMES = [f"f{i}" for i in range(34)]


@query("d1_artifact", f"""WITH {_X}, {_TREES}, p AS (SELECT vec_id, c0, c10, CAST(m1 + m2 + m3 AS DOUBLE) AS margin FROM trees), q AS (SELECT *, 1 / (1 + exp(-margin)) AS pd FROM p),
x AS (SELECT *, CAST(floor(least(greatest(196.57757217918277 - 104.16637676749855 * ln(pd / (1 - pd)), 300), 850) + 0.5) AS BIGINT) AS score FROM q)
SELECT vec_id, round(margin, 6) AS margin, round(CAST(c0 AS DOUBLE), 6) AS c0, round(CAST(c10 AS DOUBLE), 6) AS c10, score, {_GRADE} AS grade, {_PCT} AS percentile, 'demo' AS model_version FROM x""")
def _(s, d) -> DataFrame:
    """The small ensemble as the two published files, read and applied from end to end."""
    path = scratch_path(s, "artifact")
    artifact.write_artifact(s, DEMO_MODEL, artifact.Meta("demo", tuple(_NAMES)), f"{path}/model", f"{path}/meta")
    x = artifact.score(_gapped(s, d), *artifact.read_artifact(s, f"{path}/model", f"{path}/meta", order=_NAMES))
    c = F.col("contributions")
    return x.select("vec_id", r("margin").alias("margin"), r(c[0]).alias("c0"), r(c[10]).alias("c10"), "score", "grade", "percentile", "model_version")


@query("d13_artifact", "SELECT vec_id, true AS same_margin, true AS adds_up, CAST(3 AS BIGINT) AS n_trees FROM embeddings")
def _(s, d) -> DataFrame:
    """Trained trees, written as the published files, read again and applied: the margins are the fitted model's, and the contributions add up to them."""
    x = v.feature_rows(s, d).select("vec_id", "features", "label")
    gbt, path = training.boosted(x, trees=3, depth=3), scratch_path(s, "artifact")
    artifact.write_artifact(s, artifact.from_boosted(gbt), artifact.Meta("trained", tuple(_NAMES)), f"{path}/model", f"{path}/meta")
    model, meta = artifact.read_artifact(s, f"{path}/model", f"{path}/meta", order=_NAMES)
    own = artifact.score(training.predictions(gbt, x), model, meta)
    whole = F.aggregate("contributions", F.lit(artifact.bias(model)), lambda a, c: a + c)
    return own.select("vec_id", (F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("p")) < 1e-9).alias("same_margin"), (F.abs(whole - F.col("margin")) < 1e-9).alias("adds_up"), F.lit(len(model.trees)).cast("long").alias("n_trees"))


@query("d13_importances")
def _(s, d) -> DataFrame:
    """(feature, gain) of the boosted trees."""
    gbt = training.boosted(v.feature_rows(s, d).select("vec_id", "features", "label"))
    return s.createDataFrame(training.importances(gbt, [f"f{i}" for i in range(34)]), "feature string, gain double")


@query("d13_fold_auc")
def _(s, d) -> DataFrame:
    """Held-out ROC AUC of five stratified folds."""
    auc = training.fold_auc(v.feature_rows(s, d).select("vec_id", "features", "label"))
    return s.createDataFrame(list(enumerate(auc)), "fold int, roc_auc double")


@query("d14_fit_calibration")
def _(s, d) -> DataFrame:
    """The fitted monotone grid over the predictions."""
    x, y = training.fit_calibration(_weighted(s, d))
    return s.createDataFrame([(float(a), round(float(b), 6)) for a, b in zip(x, y, strict=True)], "x double, y double")
