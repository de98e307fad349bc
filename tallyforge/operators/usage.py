"""Metering, billing state and operations audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import DAY, round_half_up, utc_date, utc_month
from tallyforge.plans.prefix import running_sums

# Plans (id, monthly price, scores a month, overage per score), default cap, blended cost per score.
PLANS = [("free", 0.0, 1000, None), ("starter", 99.0, 10000, 0.012), ("growth", 499.0, 75000, 0.008), ("enterprise", None, 0, None)]
OVERAGE_CAP = 50.0
BLENDED_COST = 0.0005


def plan_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, price double, quota long, overage double")


def money(c: Column) -> Column:
    """Dollars as decimals of six places, so that sums and caps compare exactly."""
    return c.cast("decimal(18,6)")


def _overage(used: Column) -> Column:
    return money(F.when(F.col("overage").isNull() | (used <= F.col("quota")), 0).otherwise((used - F.col("quota")).cast("decimal(12,0)") * F.col("overage").cast("decimal(12,6)")))


def _with_plan(df: DataFrame, subs: DataFrame, plans: DataFrame) -> DataFrame:
    """df (api_key) with its plan's terms; an unknown plan or no subscription is free."""
    known = plans.select("plan")
    met = df.join(subs.select("api_key", F.col("plan").alias("asked")), "api_key", "left").join(F.broadcast(known.withColumn("known", F.lit(True))), F.col("asked") == F.col("plan"), "left")
    return met.withColumn("plan", F.when(F.col("known"), F.col("asked")).otherwise("free")).drop("asked", "known").join(F.broadcast(plans), "plan")


def meter_usage(calls: DataFrame, subs: DataFrame, plans: DataFrame, *, cap: float = OVERAGE_CAP) -> DataFrame:
    """Each call with used (its running number in the key's UTC month, refused calls included), allowed and reason.

    Calls are numbered by range partitions, so a key's month is spread over tasks.
    """
    month = calls.withColumns({"month": utc_month(F.col("ts")), "one": F.lit(1)})
    numbered = running_sums(month, ["api_key", "month"], ["ts", "event_id"], ["one"])
    met = _with_plan(numbered.withColumn("used", F.col("before_one") + 1).drop("one", "before_one"), subs, plans).withColumn("overage_usd", _overage(F.col("used")))
    over = F.col("used") > F.col("quota")
    reason = F.when(over & F.col("overage").isNull(), "QUOTA_EXCEEDED").when(over & (F.col("overage_usd") > money(F.lit(cap))), "OVERAGE_CAP_REACHED")
    return met.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def usage_rollup(calls: DataFrame, subs: DataFrame, plans: DataFrame) -> DataFrame:
    """Per key and month: used, quota left (never negative), overage dollars. Counts combine on the map side."""
    used = calls.groupBy("api_key", utc_month(F.col("ts")).alias("month")).agg(F.count("*").alias("used"))
    met = _with_plan(used, subs, plans)
    return met.select("api_key", "month", "plan", "used", F.greatest(F.lit(0), F.col("quota") - F.col("used")).alias("remaining"), _overage(F.col("used")).alias("overage_usd"))


def tier_economics(plans: DataFrame, *, cost: float = BLENDED_COST) -> DataFrame:
    """Revenue per score and gross margin % (1 decimal); null for custom and free plans."""
    revenue = F.when(F.col("price").isNotNull() & (F.col("quota") > 0), F.col("price") / F.col("quota"))
    return plans.select("plan", "price", revenue.alias("revenue_per_score"), F.when(revenue > 0, round_half_up((revenue - cost) / revenue * 100, 1)).alias("margin_pct"))


def subscription_state(events: DataFrame) -> DataFrame:
    """Latest plan and status per API key from billing events (type, body JSON, at, event_id).

    Events whose key or plan is missing, empty or no string are skipped, as are junk bodies and other types.
    """
    doc = F.try_parse_json("body")

    def text(path: str):
        """The value at a path if it is a JSON string."""
        part = F.try_variant_get(doc, path, "variant")
        return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(doc, path, "string"))

    updated = F.coalesce(text("$.status"), F.lit("active"))
    status = F.when(F.col("type") == "checkout.session.completed", "active").when(F.col("type") == "customer.subscription.updated", updated).when(F.col("type") == "customer.subscription.deleted", "canceled")
    own = events.select(text("$.metadata.apiKeyId").alias("api_key"), text("$.metadata.planId").alias("plan"), status.alias("status"), "at", "event_id").where("api_key <> '' and plan <> '' and status is not null")
    return own.groupBy("api_key").agg(F.max(F.struct("at", "event_id", "plan", "status")).alias("x")).select("api_key", "x.plan", "x.status")


def ops_digest(runs: DataFrame, outbox: DataFrame, *, now: int) -> DataFrame:
    """Runs of the last day by agent and status with their cost, all pending items, and the last day's executed spend: what items of kind SPEND cost."""
    recent = runs.where((F.col("ts") >= now - DAY) & (F.col("ts") <= now)).groupBy("agent", "status").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    own = outbox.agg(F.sum((F.col("status") == "PENDING").cast("long")).alias("pending"), F.sum(F.when((F.col("kind") == "SPEND") & (F.col("status") == "EXECUTED") & F.col("ts").between(now - DAY, now), F.col("amount")).otherwise(0.0)).alias("spend"))
    return recent.crossJoin(F.broadcast(own))  # one row


def spend_cap_audit(outbox: DataFrame, *, day_cap: float, channel_cap: float) -> DataFrame:
    """Executed items with running spend of the UTC day, and of the day and channel, flagged beyond either cap. Sums go by range partitions."""
    done = outbox.where("status = 'EXECUTED'").withColumns({"day": utc_date(F.col("ts")), "cost": money(F.col("amount"))})
    by_day = running_sums(done, ["day"], ["ts", "event_id"], ["cost"]).withColumn("day_spend", F.col("before_cost") + F.col("cost")).drop("before_cost")
    run = running_sums(by_day, ["day", "channel"], ["ts", "event_id"], ["cost"]).withColumn("channel_spend", F.col("before_cost") + F.col("cost")).drop("before_cost", "cost")
    return run.withColumn("over_cap", (F.col("day_spend") > money(F.lit(day_cap))) | (F.col("channel_spend") > money(F.lit(channel_cap))))


_REPORT = "struct<`effective-directive`:string,effectiveDirective:string,`violated-directive`:string,`blocked-uri`:string,blockedURL:string,`document-uri`:string,documentURL:string,disposition:string,`source-file`:string,sourceFile:string>"


def csp_reports(raw: DataFrame) -> DataFrame:
    """raw (body JSON) in either of two shapes to rows (directive, blocked, document, disposition, source); junk gives none."""
    many = F.from_json("body", f"array<struct<type:string,body:{_REPORT}>>")
    one = F.from_json("body", f"struct<`csp-report`:{_REPORT}>")
    is_list = F.startswith(F.ltrim("body"), F.lit("["))
    batch = F.transform(F.filter(many, lambda x: (x["type"] == "csp-violation") & x["body"].isNotNull()), lambda x: x["body"])
    single = F.filter(F.array(one["csp-report"]), lambda x: x.isNotNull())
    r = raw.select(F.explode(F.when(is_list, batch).otherwise(single)).alias("r"))
    f = lambda *names: F.coalesce(*(F.col("r")[n] for n in names), F.lit("unknown"))
    return r.select(f("effective-directive", "effectiveDirective", "violated-directive").alias("directive"), f("blocked-uri", "blockedURL").alias("blocked"), f("document-uri", "documentURL").alias("document"), f("disposition").alias("disposition"), F.coalesce(F.col("r")["source-file"], F.col("r")["sourceFile"], F.lit("")).alias("source"))


def csp_summary(raw: DataFrame) -> DataFrame:
    return csp_reports(raw).groupBy("directive", "disposition").agg(F.count("*").alias("n"), F.count_distinct("blocked").alias("blocked_uris"))
