"""Surrogates for personal data.

Entities are found by patterns: e-mail addresses, IPv4 and IPv6 addresses, phone numbers,
payment cards (an issuer's first digits and a valid check digit), social security numbers (in
the ranges that are given out), bank accounts (valid check digits), secrets, and names behind
a form of address. Each has a kind and a canonical form (an e-mail in lower case, a number's
digits, one name part), and each canonical form gets one surrogate of its kind for the
whole corpus: a keyed hash (HMAC-SHA-256, with the caller's key) draws it, so mentions of the same entity agree
wherever they stand (coreference), and nothing can be drawn back without the key. A
surrogate keeps the length, layout and character classes of what it replaces: digits for
digits, the country code and the punctuation of a phone number, a card's issuer digit and
check digit, an account's country and check digits, private addresses private; a name is
replaced by one word of the same gender, script and capitals, built of syllables, of which
there are millions a script and more with each further draw.

Distinctness is checked over the corpus, on canonical forms (names without regard to case and
gender). All distinct entities are gathered as a table; where two of a kind drew the same
surrogate, all but the first (by canonical form) draw again, and so does every one that drew a
real entity of that kind, until there are no collisions. Entities that
had to draw again travel to their documents as a short list beside the text.

Edge cases: a null text stays null, with no entities; empty and entity-free texts stay as
they are. Repeated rows and ids are rewritten alike. Mentions never overlap: the pattern
that begins first wins, then the order of KINDS. Empty tables give no rows. Other columns
are carried by rewrite(), whatever they are called.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, table
from tallyforge.plans.rows import small
from tallyforge.plans.scratch import materialise

ROUNDS = 40
#: The Spark setting that names the key; without it a run draws one of its own, and its surrogates are its own.
KEY_SETTING = "spark.tallyforge.surrogateKey"

# Forms of address by the gender that they tell.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "Srta", "г-жа", "госпожа", "κα", "κυρία", "السيدة", "श्रीमती"],
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "κ", "κύριος", "السيد", "श्री"],
    "x": ["Dr", "Prof", "Mx"],
}
# By script its letters' ranges, first parts and vowels of syllables, and name endings by gender (x also for family names).
SCRIPTS = {
    "latin": ("A-Za-zÀ-ɏ", "b d f g h k l m n p r s t v".split(), "a e i o u".split(), {"f": ["na", "ra", "lia", "ta"], "m": ["no", "ras", "len", "tor"], "x": ["man", "ler", "vin", "ser", "dal", "rin"]}),
    "cyrillic": ("Ѐ-ӿ", "б в г д з к л м н п р с т".split(), "а е и о у".split(), {"f": ["на", "ра", "лия", "та"], "m": ["тон", "рис", "лан", "мир"], "x": ["ков", "лин", "нов", "рин", "вич", "мов"]}),
    "greek": ("Ͱ-Ͽἀ-῿", "β γ δ θ κ λ μ ν π ρ σ τ".split(), "α ε ι ο".split(), {"f": ["να", "ρα", "λία"], "m": ["νος", "ρας", "λης"], "x": ["άκης", "ίδης", "πουλος"]}),
    "arabic": ("؀-ۿ", "ب د ر س ف ك ل م ن".split(), "ا و ي".split(), {"f": ["نة", "رة", "لة"], "m": ["ن", "ر", "ل"], "x": ["ني", "ري", "لي"]}),
    "devanagari": ("ऀ-ॿ", "क ग त द न प म र ल स".split(), "ा ि ी ु ो".split(), {"f": ["ना", "रा", "ली"], "m": ["न", "र", "ल"], "x": ["वाल", "कर", "दास"]}),
    "han": ("一-鿿", "安 文 明 林 雨 海 山 春 秋 月 星 云".split(), [""], {"f": ["芳", "丽", "娟"], "m": ["伟", "强", "军"], "x": ["平", "华", "宁"]}),
}
_SCRIPT = [(name, re.compile(f"[{letters}]")) for name, (letters, *_) in SCRIPTS.items()]
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_WORD = r"[^\W\d_](?:[\w'’-]|[\u0900-\u0903\u093a-\u094f])*"
_HEX = "[0-9A-Fa-f]{1,4}"
KINDS = {
    "email": r"[\w.%+-]*[\w%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"\b(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
    + rf"|(?<![\w:.])(?:{_HEX}:){{2,7}}(?::?{_HEX}(?::{_HEX}){{0,6}}|:)(?![\w:])|(?<![\w:.])(?:{_HEX}:)?:{_HEX}(?::{_HEX}){{1,6}}(?![\w:])",
    "name": rf"(?<!\w)(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))})\.? {_WORD}(?: {_WORD})?",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
_MAYBE = re.compile(rf"[@\d]|(?<!\w)(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))})\.? ")


def draw(key: bytes, kind: str, canon: str, attempt: int, n: int) -> list[int]:
    """n numbers below 2**16 from a keyed stream."""
    out, block = b"", 0
    while len(out) < 2 * n:
        out += hmac.new(key, f"{kind}\x00{canon}\x00{attempt}\x00{block}".encode(), hashlib.sha256).digest()
        block += 1
    return [int.from_bytes(out[2 * i : 2 * i + 2], "big") for i in range(n)]


def _shape(text: str, numbers: list[int]) -> str:
    """Another character of the same class in each place; hexadecimal stays so."""
    lower = "abcdef" if re.fullmatch(r"[0-9a-f]{32,}", text) else "abcdefghijklmnopqrstuvwxyz"
    classes = (("0123456789", str.isdigit), (lower, lambda c: c.isalpha() and c.islower()), (lower.upper(), str.isalpha))
    return "".join(next((s[n % len(s)] for s, of in classes if of(c)), c) for c, n in zip(text, numbers, strict=True))


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def issued(digits: str) -> bool:
    """Whether a card number has an issuer's first digits and a valid check digit."""
    return (digits[0] in "3456" or 2221 <= int(digits[:4]) <= 2720) and luhn(digits)


def _account_rest(account: str) -> int:
    """A bank account's number modulo 97, letters as numbers; 1 if the check digits are right."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _address(text: str) -> str | None:
    """The canonical form of an IP address; null if it is none, or has fewer than three groups or no digit."""
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    if found.version == 4:
        return text
    return found.exploded if len([g for g in text.split(":") if g]) >= 3 and re.search(r"\d", text) else None


def script_of(word: str) -> str:
    return next((name for name, letters in _SCRIPT if letters.match(word)), "latin")


def new_name(key: bytes, canon: str, attempt: int) -> str:
    """A made-up name of the gender and script of a canonical form; each fourth further draw has a syllable more."""
    part, gender, script, _ = canon.split("|")
    _, first, vowels, endings = SCRIPTS[script]
    n = draw(key, "name", canon, attempt, 12)
    syllables = (3 if script == "han" else 2) + (part == "family") + attempt // 4
    stem = "".join(first[n[2 * i % 10] % len(first)] + vowels[n[(2 * i + 1) % 10] % len(vowels)] for i in range(min(syllables, 5)))
    return (stem + endings[gender][n[10] % len(endings[gender])]).capitalize()


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The surrogate of a canonical form, itself canonical."""
    n = draw(key, kind, canon, attempt, len(canon) + 8)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.rsplit(".", 1)
        of_domain = draw(key, "domain", domain, attempt, len(labels[0]))
        return f"{_shape(local, n[: len(local)])}@{_shape(labels[0], of_domain)}.{labels[1]}"
    if kind == "ip" and ":" in canon:
        local = canon[:2] in ("fc", "fd") or canon[:3] in ("fe8", "fe9", "fea", "feb")
        return ":".join([canon[:4] if local else f"{0x2000 | n[0] & 0x1FFF:04x}", *(f"{x:04x}" for x in n[1:8])])
    if kind == "ip":
        first = canon.split(".")[0]
        private = canon.startswith(("10.", "192.168.", "127.")) or (first == "172" and 16 <= int(canon.split(".")[1]) < 32)
        return ".".join(["10" if private else str(11 + n[0] % 115), str(n[1] % 256), str(n[2] % 256), str(1 + n[3] % 254)])
    if kind == "card":
        body = (canon[:4] if canon[0] == "2" else canon[0]) + "".join(str(x % 10) for x in n)
        body = body[: len(canon) - 1]
        return body + next(d for d in "0123456789" if luhn(body + d))
    if kind == "phone":
        head, _, rest = canon.partition("|")
        return f"{head}|" + "".join(str(2 + x % 8) if i == 0 else str(x % 10) for i, x in enumerate(n[: len(rest)]))
    if kind == "ssn":
        return "9" + "".join(str(x % 10) for x in n[: len(canon) - 1])
    if kind == "iban":
        body = _shape(canon[4:], n[: len(canon) - 4])
        return f"{canon[:2]}{98 - _account_rest(f'{canon[:2]}00{body}'):02d}{body}"
    if kind == "name":
        return f"{canon.rsplit('|', 1)[0]}|{new_name(key, canon, attempt)}"
    return _shape(canon, n[: len(canon)])


def _entities(kind: str, found: str) -> list[tuple[str, str]]:
    """(surface, canonical form) of the parts of a mention that get a surrogate of their own."""
    if kind == "email":
        return [(found, found.lower())]
    if kind in ("card", "ssn"):
        digits = re.sub(r"\D", "", found)
        real = issued(digits) if kind == "card" else digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
        return [(found, digits)] if real else []
    if kind == "ip":
        canon = _address(found)
        return [(found, canon)] if canon else []
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=\D)|\+1", found)
        head = country[0] if country else ""
        return [(found, f"{head}|{re.sub(r'\D', '', found[len(head) :])}")]
    if kind == "iban":
        account = found.replace(" ", "")
        return [(found, account)] if _account_rest(account) == 1 else []
    if kind == "name":
        title, *words = found.split(" ")
        gender, parts = _GENDER[title.rstrip(".")], []
        words = words[: next((i for i, w in enumerate(words) if w[0].islower()), len(words))]  # scripts without capitals count as capital
        for i, w in enumerate(words):
            script = script_of(w)
            part = "given" if len(words) == 2 and i == 0 else "family"
            parts.append((w, f"{part}|{gender if part == 'given' else 'x'}|{script}|{w.casefold()}"))
        return parts
    return [(found, found)]


def _dress(kind: str, surface: str, new: str) -> str:
    """A canonical surrogate in the layout of the mention it replaces."""
    if kind == "name":
        word = new.rsplit("|", 1)[1]
        return word.upper() if surface.isupper() and len(surface) > 1 else word
    if kind in ("card", "ssn", "phone", "iban"):
        head = ""
        if kind == "phone":
            head, new = new.split("|")
        rest = iter(new)
        return head + "".join(next(rest) if c.isalnum() else c for c in surface[len(head) :])
    if kind == "ip" and ":" in new:
        new = ipaddress.ip_address(new).compressed
    if kind in ("email", "ip") and surface.isupper():
        return new.upper()
    return new


def mentions(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, surface, canonical form) of every entity of a text, in order."""
    if not text or not _MAYBE.search(text):
        return []
    out = []
    for m in _FIND.finditer(text):
        at = m.start()
        for surface, canon in _entities(m.lastgroup, m[0]):
            at = text.index(surface, at, m.end())
            out.append((at, at + len(surface), m.lastgroup, surface, canon))
            at += len(surface)
    return out


def replaced(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[str]]:
    """(text with surrogates, kinds of its entities in order)."""
    found, out, at = mentions(text), [], 0
    if not found:
        return text, []
    for start, end, kind, surface, canon in found:
        out += [text[at:start], _dress(kind, surface, surrogate(key, kind, canon, attempts.get((kind, canon), 0)))]
        at = end
    return "".join([*out, text[at:]]), [f[2] for f in found]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, canon) of the entities, once a slice."""
    for batch in slices(batches):
        seen = sorted({(k, c) for t in batch.column("text").to_pylist() for _, _, k, _, c in mentions(t)})
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen]), pa.array([c for _, c in seen])], ["kind", "canon"])


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, canon) of every distinct entity of the corpus."""
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_listed, "kind string, canon string").distinct()


def identity(kind: Column, canon: Column) -> Column:
    """What tells two entities of a kind apart for a reader: of a name its part and the name in lower case, else the canonical form."""
    fields = F.split(canon, r"\|")
    return F.when(kind == "name", F.concat_ws("|", fields[0], F.lower(fields[3]))).otherwise(canon)


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt, surrogate) for every entity: no two of a kind share a surrogate, and none is a real entity."""

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, canon: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, c, a) for k, c, a in zip(kind, canon, attempt, strict=True)], dtype=object)

    real = found.select(F.col("kind").alias("r_kind"), identity(F.col("kind"), F.col("canon")).alias("r_same")).distinct()
    todo, settled = found, None
    for attempt in range(ROUNDS):
        tried = materialise(todo.select("kind", "canon", F.lit(attempt).alias("attempt")).withColumn("surrogate", drawn("kind", "canon", "attempt")).withColumn("same", identity(F.col("kind"), F.col("surrogate"))), "drawn")
        first = F.row_number().over(Window.partitionBy("kind", "same").orderBy("canon")) == 1
        clear = tried.withColumn("first", first).where("first").drop("first")
        clear = clear.join(real, (F.col("kind") == F.col("r_kind")) & (F.col("same") == F.col("r_same")), "left_anti")
        if settled is not None:
            taken = settled.select(F.col("kind").alias("t_kind"), F.col("same").alias("taken"))
            clear = clear.join(taken, (F.col("kind") == F.col("t_kind")) & (F.col("same") == F.col("taken")), "left_anti")
        clear = materialise(clear, "settled")
        settled = clear if settled is None else settled.unionByName(clear)
        done = clear.select(F.col("kind").alias("d_kind"), F.col("canon").alias("d_canon"))
        todo = materialise(tried.join(done, (F.col("kind") == F.col("d_kind")) & (F.col("canon") == F.col("d_canon")), "left_anti").select("kind", "canon"), "collided")
        if todo.isEmpty():
            return settled.drop("same")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds; the pools of names are too small")


def rewrite(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and pii_kinds: the kinds of the entities replaced, in order."""
    if not key:
        raise ValueError("surrogates need a secret key")
    chosen = assigned(materialise(entities(docs, text_col), "entities"), key)
    again = materialise(chosen.where("attempt > 0").select(F.col("kind").alias("a_kind"), F.col("canon").alias("a_canon"), "attempt"), "again")
    tagged = docs.withColumn("__row", F.xxhash64(F.col(id_col), F.col(text_col).cast("string")))
    empty = F.array().cast("array<struct<kind:string,canon:string,attempt:int>>")
    if again.isEmpty():
        met = tagged.withColumn("__again", empty)
    else:
        where = tagged.select("__row", F.col(text_col).cast("string").alias("text")).mapInArrow(_placed, "row long, kind string, canon string")
        lists = where.join(small(again), (F.col("kind") == F.col("a_kind")) & (F.col("canon") == F.col("a_canon"))).select("row", "kind", "canon", "attempt").distinct()
        lists = materialise(lists.groupBy("row").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("list")), "lists")
        met = tagged.join(small(lists), F.col("__row") == F.col("row"), "left").withColumn("__again", F.coalesce("list", empty)).drop("row", "list")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text="__text"):
            done = [replaced(t, key, {(x["kind"], x["canon"]): x["attempt"] for x in again}) for t, again in zip(batch.column("__text").to_pylist(), batch.column("__again").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns if c != text_col), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], [*(c for c in columns if c != text_col), text_col, "pii_kinds"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns if c != text_col]
    out = met.select(*(c for c in columns if c != text_col), F.col(text_col).cast("string").alias("__text"), "__again")
    return out.mapInArrow(run, ", ".join([*fields, f"`{text_col}` string", "pii_kinds array<string>"]))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [(r, k, c) for r, t in zip(batch.column("__row").to_pylist(), batch.column("text").to_pylist(), strict=True) for _, _, k, _, c in mentions(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], ["row", "kind", "canon"])


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, pii_kinds, n_entities."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    done = rewrite(table(spark, sf_dir, "documents").select("doc_id", "text"), key.encode())
    return done.select("doc_id", "text", "pii_kinds", F.size("pii_kinds").alias("n_entities"))
