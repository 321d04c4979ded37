"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

All of it is DataFrame functions. The patterns are written so that Java's matcher needs
neither backtracking nor recursion (possessive loops, bounded counts), however long a text is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import between, digest, fold, joined, segments, with_matches

#: Characters of context on each side of a span, the score that context adds, and the score from which the method's own kinds count.
AROUND, CONTEXT_BONUS, MIN_SCORE = 40, 0.3, 0.5
BASE = ("email", "ip", "card", "phone")
PIECE = "struct<at:int,start:int,end:int,kind:string>"
#: kind: pattern, score before context, context words. A card is a whole chain of 13 to 19 digits, a phone a whole run of 9 to 15.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, r"(?i)mail|contact|write|send|reply"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", 0.5, r"(?i)\bip\b|host|server|address|login|from"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])", 0.7, r"(?i)card|visa|credit|debit|payment|account"),
    "phone": (r"\+[0-9](?:[\x20().-]*+[0-9]){8,14}+(?![\x20().-]*+[0-9])", 0.5, r"(?i)phone|tel|call|mobile|fax"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", 0.6, r"(?i)iban|bank|account|konto|transfer"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"(?i)ssn|social security|tax id|insurance"),
}


def luhn(digits):
    """True for digits whose Luhn sum is a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _luhn_digit(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _luhn_digit(d, i):
    twice = d * 2
    return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)


def mod97(iban):
    """True for an IBAN (no spaces) whose rearranged number is 1 modulo 97."""
    chars = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")

    def step(acc, c):
        code = F.ascii(c)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, s):
    plain = F.regexp_replace(s["hit"], r"[^A-Z0-9]", "")
    alone = ~s["before"].rlike(r"[A-Za-z0-9]\z") & ~s["after"].rlike(r"\A[A-Za-z0-9]")
    if kind == "ip":
        return s["hit"].rlike(r"\A0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}\z")
    if kind == "card":
        return luhn(plain)
    if kind == "iban":
        return alone & mod97(plain)
    return alone if kind == "ssn" else F.lit(True)


def confirmed(kind: str, spans):
    """The spans of one kind that pass its checks: array<struct<kind,start,end,hit,score>>."""
    _, prior, words = KINDS[kind]

    def scored(s):
        near = s["before"].rlike(words) | s["after"].rlike(words)
        score = F.lit(prior) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.round(score, 2).alias("score"))

    found = F.transform(F.filter(spans, lambda s: _valid(kind, s)), scored)
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= MIN_SCORE)


def find_pii(docs: DataFrame, text: str = "text", kinds=tuple(KINDS)) -> DataFrame:
    """docs with _email, _ip, ...: the confirmed spans of each kind.

    A null or empty text has empty arrays. The spans of the four base kinds always stay,
    whatever their score; the method's own kinds stay from MIN_SCORE on. Rows repeated are
    scanned alike; other columns stay unless they bear one of these names, which are replaced.
    """
    found = with_matches(docs, F.coalesce(F.col(text), F.lit("")), {f"_{k}": KINDS[k][0] for k in kinds}, AROUND)
    kept = [c for c in docs.columns if c not in {f"_{k}" for k in kinds}]
    return found.select(*kept, *[confirmed(k, F.col(f"_{k}")).alias(f"_{k}") for k in kinds])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; of overlapping spans the first, then the longer one counts.

    The columns stay the same, n_chars is counted anew where there is one; a null text stays null.
    """
    found = find_pii(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_text")
    every = F.concat(*[F.col(f"_{k}") for k in KINDS])
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))

    def step(at, s):
        piece = F.struct(at.alias("at"), s["start"].alias("start"), (-s["minus_end"]).alias("end"), s["kind"].alias("kind"))
        free = s["start"] >= at
        return F.when(free, -s["minus_end"]).otherwise(at), F.when(free, F.array(piece)).otherwise(F.array().cast(f"array<{PIECE}>"))

    rows = found.select("_row", "_text", ordered.alias("_spans"))
    rows = rows.select("_row", "_text", fold(F.col("_spans"), F.lit(0), "int", PIECE, step).alias("_pieces"))
    rows = rows.select("_row", "_text", "_pieces", F.when(F.size("_pieces") > 0, segments(F.col("_text"))).alias("_parts"))
    parts, last = F.col("_parts"), F.element_at("_pieces", -1)["end"]
    new = F.array_join(F.transform("_pieces", lambda p: F.concat(between(parts, p["at"], p["start"]), F.lit("["), F.upper(p["kind"]), F.lit("]"))), "")
    clean = F.when(F.size("_pieces") > 0, F.concat(new, between(parts, last, F.length("_text")))).otherwise(F.col("_text"))
    rows = rows.select("_row", clean.alias("_new"))
    columns = [F.col("_new").alias(c) if c == text else F.length("_new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return rows.select(*columns)


def op2_pii_spans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).drop("text")
    base = F.concat(*[F.col(f"_{k}") for k in BASE])
    every = F.concat(*[F.col(f"_{k}") for k in KINDS])
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, digest(base).alias("base_sha256"), joined(every).alias("spans"))


def _duck(kind: str, pattern: str, keep: str) -> str:
    return rf"""
{kind}_m AS (SELECT id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')),
{kind}_s AS (SELECT id, unnest(range(len(m))) AS i, m, p FROM {kind}_m),
{kind}_e AS (SELECT id, m[i + 1] AS hit, p[i + 1] AS pre, p[i + 2] AS post,
   CAST(list_sum(list_transform(p[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS s FROM {kind}_s),
{kind} AS (SELECT id, count(*) AS n, string_agg('{kind}:' || s || ':' || (s + length(hit)), ',' ORDER BY s) AS t FROM (
   SELECT *, regexp_replace(hit, '[^0-9A-Z]', '', 'g') AS plain, right(pre, 40) AS pre40, left(post, 40) AS post40 FROM {kind}_e) WHERE {keep} GROUP BY id)"""


_ALONE = "NOT regexp_matches(pre40, '[A-Za-z0-9]$') AND NOT regexp_matches(post40, '^[A-Za-z0-9]')"
_LUHN = "list_sum(list_transform(range(1, length(plain) + 1), lambda k: CASE WHEN (length(plain) - k) % 2 = 0 THEN CAST(plain[k:k] AS INT) WHEN CAST(plain[k:k] AS INT) > 4 THEN 2 * CAST(plain[k:k] AS INT) - 9 ELSE 2 * CAST(plain[k:k] AS INT) END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split(plain[5:] || plain[1:4], ''), lambda c: ascii(c))), lambda a, c: CASE WHEN c < 65 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"
ORACLE = (
    "WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),"
    + ",".join(
        [
            _duck("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
            _duck("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(hit, '.'), lambda x: CAST(x AS DOUBLE))) <= 255"),
            _duck("card", r"[0-9]([\x20-]?[0-9])+", f"length(plain) BETWEEN 13 AND 19 AND {_LUHN}"),
            _duck("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(plain) BETWEEN 9 AND 15"),
            _duck("iban", KINDS["iban"][0], f"{_ALONE} AND {_MOD97}"),
            _duck("ssn", KINDS["ssn"][0], f"{_ALONE} AND (regexp_matches(pre40, '{KINDS['ssn'][2]}') OR regexp_matches(post40, '{KINDS['ssn'][2]}'))"),
        ]
    )
    + """
SELECT doc_id, coalesce(email.n, 0) AS n_email, coalesce(ip.n, 0) AS n_ip, coalesce(card.n, 0) AS n_card, coalesce(phone.n, 0) AS n_phone,
       sha256(concat_ws(',', email.t, ip.t, card.t, phone.t)) AS base_sha256, concat_ws(',', email.t, ip.t, card.t, phone.t, iban.t, ssn.t) AS spans
FROM d LEFT JOIN email USING (id) LEFT JOIN ip USING (id) LEFT JOIN card USING (id) LEFT JOIN phone USING (id) LEFT JOIN iban USING (id) LEFT JOIN ssn USING (id)
"""
)
