"""Licence scan by sentence rules.

A text is cut into sentences; each is normalised and looked up among known licence
sentences. What is left of a document is the sequence of identifiers of the sentences
that are known. Ordered licence rules, each a sequence of identifiers, are then matched
against that sequence: a rule takes the identifiers that it matches out of the sequence
(those around them stay apart), so a longer rule (a full licence text) comes before the rules for its parts. Identifiers
that no rule takes are reported as unmatched.

Sentences end at a blank line, or at one of . ! ? before white space. Runs of two or more of
these marks do not end one: they are noise between words. A line break, and : or ; before white
space, may end a sentence or stand between two of its words, so hard-wrapped texts and lines
without a mark are both found, the longest first. Normalising turns A-Z to lower case, and everything but a-z, 0-9, "." and "-"
to single spaces.

All of it is one projection over each row: no shuffle, no Python, whole texts. The SQL twin is
narrower: it ends sentences at every line break and at . ! ? only, so it agrees on texts that
are not wrapped.

Edge cases: null, empty, and licence-free texts give no licences and n_sentences of known
sentences 0. Repeated sentences give repeated identifiers, and a rule that matches twice
is listed once. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

# The rule base is the data file beside this module; tag lines follow one rule.
_BASE = json.loads((Path(__file__).parent / "licence_rules.json").read_text())
SENTENCES: dict[str, list[str]] = _BASE["sentences"] | {f"tag-{name}": [f"spdx-license-identifier {name.lower()}"] for name in _BASE["tags"]}
RULES: list[tuple[str, list[str]]] = [(name, ids) for name, ids in _BASE["rules"]] + [(name, [f"tag-{name}"]) for name in _BASE["tags"]]


def marked(text: Column) -> Column:
    """The normalised text, with \\x01 where a sentence ends and a line feed where one may end."""
    t = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\x01", "abcdefghijklmnopqrstuvwxyz ")
    t = F.regexp_replace(t, r"[.!?]{2,}", " ")
    t = F.regexp_replace(t, r"[.!?](\s+|$)|\n[^\S\n]*\n", "\x01")
    t = F.regexp_replace(t, r"[:;](\s+|$)", "\n")
    t = F.regexp_replace(t, r"[^-a-z0-9.\n\x01]+", " ")
    return F.trim(F.regexp_replace(t, r" *([\n\x01]) *", "$1"))


def identifiers(text: Column, known: dict[str, list[str]] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    by_sentence = {s: k for k, forms in known.items() for s in forms}
    any_of = "|".join(s.replace(".", r"\.").replace(" ", r"[ \n]") for s in sorted(by_sentence, key=len, reverse=True))
    hits = F.regexp_extract_all(marked(text), F.lit(rf"(?<![^\n\x01])({any_of})(?![^\n\x01])"), F.lit(1))
    table_of = F.create_map(*(F.lit(x) for pair in by_sentence.items() for x in pair))
    return F.transform(hits, lambda s: F.element_at(table_of, F.translate(s, "\n", " ")))


def match_rules(ids: Column, rules=RULES) -> Column:
    """struct(licences, unmatched): the ordered rules applied to a sequence of identifiers.

    Every identifier stands between bars of its own, and what a rule takes leaves a mark
    behind, so that identifiers on both sides of it do not become neighbours.
    """
    barred = lambda seq: "".join(f"|{x}|" for x in seq)
    tried = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(barred(seq)).alias("seq")) for name, seq in rules))
    start = F.struct(F.array_join(F.transform(ids, lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "").alias("rest"), F.array().cast("array<string>").alias("found"))

    def apply(done: Column, rule: Column) -> Column:
        taken = F.struct(F.replace(done["rest"], rule["seq"], F.lit("#")).alias("rest"), F.concat(done["found"], F.array(rule["name"])).alias("found"))
        return F.when(F.contains(done["rest"], rule["seq"]), taken).otherwise(done)

    end = F.aggregate(tried, start, apply)
    left = F.filter(F.split(end["rest"], r"[|#]+"), lambda x: x != "")
    return F.struct(F.array_distinct(end["found"]).alias("licences"), left.alias("unmatched"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, sentence_ids, licences, unmatched."""
    found = docs.select(F.col(id_col), identifiers(F.col(text_col)).alias("sentence_ids"))
    none = F.array().cast("array<string>")
    matched = F.when(F.size("sentence_ids") > 0, match_rules(F.col("sentence_ids"))).otherwise(F.struct(none.alias("licences"), none.alias("unmatched")))
    return found.withColumn("m", matched).select(id_col, "sentence_ids", "m.licences", "m.unmatched")


def op2_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, sentence_ids and licences joined by commas, n_unmatched."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), F.size("unmatched").cast("long").alias("n_unmatched"))


def _sql() -> str:
    """Sentences by lines and marks; rules by positions: a rule of k identifiers matches at p if the slice from p on is the rule."""
    known = ", ".join(f"('{s}', '{k}')" for k, forms in SENTENCES.items() for s in forms)
    steps = []
    for i, (name, seq) in enumerate(RULES):
        k, want = len(seq), "[" + ", ".join(f"'{x}'" for x in seq) + "]"
        at = f"SELECT *, list_filter(range(1, len(ids) - {k} + 2), lambda p: ids[p:p + {k - 1}] = {want}) AS spots FROM s{i}"
        taken = f"list_transform(range(1, len(ids) + 1), lambda j: CASE WHEN list_has_any(range(j - {k} + 1, j + 1), spots) THEN '' ELSE ids[j] END)"
        steps.append(f"s{i + 1} AS (SELECT doc_id, told, {taken} AS ids, CASE WHEN len(spots) > 0 AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM ({at}))")
    return rf"""
WITH known(s, k) AS (VALUES {known}),
d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.!?]{{2,}}', ' ', 'g'), '[.!?](\s+|$)', chr(10), 'g'), '[^a-z0-9.\n-]+', ' ', 'g') AS t FROM documents),
u AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
s0 AS (SELECT u.doc_id, list(k ORDER BY pos) AS told, list(k ORDER BY pos) AS ids, CAST([] AS VARCHAR[]) AS found FROM u JOIN known ON trim(u.s, ' ') = known.s GROUP BY u.doc_id),
{", ".join(steps)}
SELECT documents.doc_id, coalesce(array_to_string(told, ','), '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licences,
  CAST(coalesce(len(list_filter(ids, lambda x: x <> '')), 0) AS BIGINT) AS n_unmatched
FROM documents LEFT JOIN s{len(RULES)} USING (doc_id)
"""


SQL = _sql()
