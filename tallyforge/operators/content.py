"""Checks of published text: numeric claims against verified facts, and claims about others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import utc_date
from tallyforge.plans.prefix import carry_forward, running_sums
from tallyforge.plans.scratch import materialise
from tallyforge.plans.skew import lookup

# Posts a UTC day per channel, the e-mail token, and names that are covered in fact.
CADENCE = {"x": 12, "farcaster": 16, "email": 1, "seo": 4, "video": 4}
UNSUBSCRIBE = "{{unsubscribe_url}}"
COVERED = ["aave", "compound", "ethereum", "arbitrum", "optimism", "polygon", "base", "avalanche", "scroll", "solana"]

# Fixed value: the number pattern. The look-ahead keeps the look-behind group from being set where no number starts
_NUMBER = r"(?=\d)(?:(?<=([A-Za-z0-9_#@/-])))?(\d[\d,]*(?:\.\d+)?)\s*([kKmMbB])?\s*(\+)?\s*(%|percent)?"
# Fixed value: the name after a phrase. Its patterns ignore case, so words of small letters go on with the name too.
_ENTITY = r"([\w.$-]+(?:\s+[A-Z][\w.$-]*)*)"
# Phrases that claim a relationship; the name that follows must look like a proper noun.
_RELATIONS = [
    ("partnership", r"\b(?:partner(?:ed|ship|ing)?\s+with|official\s+partner\s+of)\s+"), ("endorsement", r"\b(?:backed|endorsed|approved|audited|vetted)\s+by\s+"), ("endorsement", r"\btrusted\s+by\s+"),
    ("partnership", r"\b(?:integrated|integration)\s+with\s+"), ("partnership", r"\b(?:now\s+live|launching)\s+on\s+"), ("endorsement", r"\bused\s+by\s+(?:teams\s+at\s+)?"),
]
# A person's name, and how a quote is attributed to one.
_PERSON = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"
_TESTIMONIALS = [rf'["“][^"”]{{10,}}["”]\s*[-,]{{1,2}}\s*{_PERSON}', rf"\b(?:says|said)\s+{_PERSON}\s*[,:]"]


def numeric_claims(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, raw, magnitude, is_bound, is_percent) of each number that reads as a claim.

    URLs and code spans do not count; nor numbers glued to an identifier, or bare years.
    """
    stripped = F.regexp_replace(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"https?://\S+", " "), r"`[^`]*`", " ")
    group = lambda i: F.regexp_extract_all(F.col("t"), F.lit(_NUMBER), F.lit(i))
    found = docs.select(F.col(id_col), stripped.alias("t")).where(F.col("t").rlike(r"\d"))
    names = ["raw", "glued", "digits", "suffix", "plus", "percent"]
    zipped = F.arrays_zip(*(group(i).alias(n) for i, n in enumerate(names)))
    each = found.select(id_col, F.posexplode(zipped).alias("pos", "m")).select(id_col, "pos", *(F.coalesce(F.col("m")[n], F.lit("")).alias(n) for n in names))
    bare = F.regexp_replace("digits", ",", "")
    year = bare.rlike(r"^(19|20)\d{2}$") & (F.col("suffix") == "") & (F.col("plus") == "") & (F.col("percent") == "")
    scale = F.when(F.lower("suffix") == "k", 1e3).when(F.lower("suffix") == "m", 1e6).when(F.lower("suffix") == "b", 1e9).otherwise(1.0)
    kept = each.where((F.col("glued") == "") & ~year)
    return kept.select(id_col, "pos", F.regexp_replace("raw", r"\s+$", "").alias("raw"), (bare.cast("double") * scale).alias("magnitude"), (F.col("plus") != "").alias("is_bound"), (F.col("percent") != "").alias("is_percent"))


def claim_violations(claims: DataFrame, facts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Claims that no verified fact backs. facts: value, unit, verified.

    A claim is backed if a fact lies within its precision, or, for a lower bound, if a fact is
    floored to it; a percentage also by a ratio times 100. The nearest fact on either side of a
    claim decides, so claims of each shape enter the facts in order of size, and the last fact is
    carried forward to them, upwards and downwards: nothing is paired, and neither side is broadcast.
    """
    decimals = F.length(F.regexp_replace(F.coalesce(F.get(F.split("raw", r"\."), 1), F.lit("")), r"\D", ""))
    shaped = claims.withColumn("__decimals", decimals).withColumn("__shape", F.concat_ws("|", "magnitude", "is_bound", "is_percent", "__decimals"))
    shapes = materialise(shaped.groupBy("__shape").agg(*(F.first(c).alias(c) for c in ("magnitude", "is_bound", "is_percent", "__decimals")), F.count("*").alias("__n")), "shapes")
    ok = facts.where("verified and value is not null").select(F.col("value").cast("double").alias("value"), "unit")
    plain = ok.select("value", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_percent"))
    known = plain.unionByName(ok.where("unit = 'ratio'").select((F.col("value") * 100).alias("value"), F.lit(True).alias("is_percent"))).distinct()
    rows = shapes.select("*", F.col("magnitude").alias("__at")).unionByName(known.withColumn("__at", F.col("value")), allowMissingColumns=True)
    # of equal sizes the fact comes before the claim, both ways
    rows = rows.withColumn("__claim", F.col("__shape").isNotNull().cast("int"))
    up = carry_forward(rows, ["is_percent"], ["__at", "__claim", "__shape"], "value", "__below")
    both = carry_forward(up.withColumn("__down", -F.col("__at")), ["is_percent"], ["__down", "__claim", "__shape"], "value", "__above").where("__claim = 1")
    m = F.col("magnitude")
    tolerance = F.when(F.col("__decimals") > 0, F.pow(F.lit(10.0), -F.col("__decimals"))).otherwise(0.5)
    near = lambda v: F.coalesce(F.abs(F.col(v) - m) <= tolerance, F.lit(False))
    digits = F.length(F.regexp_replace(F.round(m).cast("decimal(30,0)").cast("string"), "0+$", ""))
    grain = F.pow(F.lit(10.0), F.floor(F.log10(m)) - (digits - 1))
    floored = F.coalesce((m > 0) & (F.floor(F.col("__above") / grain) * grain == m), F.lit(False))
    judged = both.select(F.col("__shape"), F.col("__n"), F.when(F.col("is_bound"), floored).otherwise(near("__below") | near("__above")).alias("__backed"))
    return lookup(shaped, judged, ["__shape"], "__n", max(1, claims.count())).where("not __backed").select(*claims.columns)


def proof_violations(docs: DataFrame, *, allowed: list[str] = (), own_name: str = "us", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, entity) of claimed relationships, testimonials and impersonations that the allow-list does not cover."""
    listed = [n.lower() for n in (*allowed, *COVERED, own_name)]
    patterns = [(k, f"(?i){p}{_ENTITY}", True) for k, p in _RELATIONS] + [("testimonial", p, False) for p in _TESTIMONIALS]
    # Phrases that speak as or for somebody else
    patterns += [("impersonation", rf"(?i)\bwe\s+are\s+(?:the\s+)?(?:team\s+behind|official)\s+(?!{own_name}\b)([A-Z][\w.$-]*)", False), ("impersonation", rf"(?i)\bon\s+behalf\s+of\s+(?!{own_name}\b)([A-Z][\w.$-]*)", False)]

    def found(kind: str, pattern: str, proper: bool):
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1)), lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entity"), F.lit(proper).alias("proper")))

    hits = F.flatten(F.array(*(found(*p) for p in patterns)))
    each = docs.where(F.col(text_col).isNotNull()).select(id_col, F.explode(hits).alias("h")).select(id_col, "h.*")
    name = F.regexp_replace(F.lower(F.trim("entity")), r"[.,;:!?]+$", "")
    return each.where((~F.col("proper") | F.col("entity").rlike(r"^[A-Z0-9$]")) & ((F.col("kind") == "impersonation") | ~name.isin(listed))).select(id_col, "kind", "entity")


def publish_decision(content: DataFrame, claim_faults: DataFrame, proof_faults: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """BLOCKED on any violation or an e-mail without the unsubscribe token; else deferred beyond the channel's cap of the day; else ready."""
    bad = claim_faults.select(id_col).unionByName(proof_faults.select(id_col)).distinct().withColumn("faulty", F.lit(True))
    met = content.join(bad, id_col, "left")
    blocked = F.coalesce("faulty", F.lit(False)) | ((F.col("channel") == "email") & ~F.contains(F.coalesce("text", F.lit("")), F.lit(UNSUBSCRIBE)))
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in CADENCE.items() for x in kv)), F.col("channel"))
    ordered = met.withColumns({"blocked": blocked, "day": utc_date(F.col("posted")), "one": F.lit(1)})
    turns = running_sums(ordered, ["channel", "day", "blocked"], ["posted", id_col], ["one"])  # a channel's day is spread over tasks
    return turns.withColumn("decision", F.when(F.col("blocked"), "BLOCKED").when(F.col("before_one") >= cap, "deferred").otherwise("ready")).drop("faulty", "one", "before_one", "day")


def check_and_decide(content: DataFrame, facts: DataFrame, *, site: str, allowed: list[str] = (), own_name: str = "us", id_col: str = "doc_id") -> DataFrame:
    """publish_decision() of content (id, channel, posted, text, title) as it would go out: links are tagged first, and title and body are checked together; the unsubscribe token must be in the body."""
    out = tag_links(content, site=site)
    title = F.coalesce("title", F.lit("")) if "title" in content.columns else F.lit("")
    checked = out.select(id_col, F.concat(title, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    faults = claim_violations(numeric_claims(checked, id_col), facts, id_col)
    return publish_decision(out, faults, proof_violations(checked, allowed=allowed, own_name=own_name, id_col=id_col), id_col)


def tag_links(content: DataFrame, *, site: str, text_col: str = "text") -> DataFrame:
    """Own-site links with utm tags of the row's channel. A query is not part of the link that is matched, so the tags always follow a question mark."""
    escaped = site.replace(".", r"\.")
    tags = F.concat(F.lit("utm_source="), F.col("channel"), F.lit("&utm_medium=autopilot"))
    tagged = F.regexp_replace(F.col(text_col), F.lit(rf"(https://{escaped}(?:/[\w/#-]*)?)"), F.concat(F.lit("$1?"), tags))
    return content.withColumn(text_col, tagged)
