"""Personal data by patterns, checksums and context (operator 9). DataFrame functions only.

Patterns propose spans for each kind, left to right without overlap; validators confirm them: octets for ip, Luhn for card,
digit counts for phone, mod 97 for iban. Words near a span then raise or lower its score. Spans have code-point offsets,
end exclusive. A null text is empty. Each row keeps its own row; extra columns are ignored.

The patterns run in linear time on any text, without nested repetition: the dots between labels of a domain, and the
lone separators inside a number, are first told from others by one substitution of equal length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import table

KINDS = ["email", "ip", "card", "phone", "iban"]
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
DOT, NO_DOT = "\uE000", "\uE001"
PATTERNS = {
    "email": f"(?:(?<![{DOT}{LOCAL}])|\\G)[{DOT}{LOCAL}]++@[{LABEL}]++{DOT}[{DOT}{LABEL}]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][\x20\-0-9]*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Score of a confirmed span, what a word near it adds or takes, and how many code points count as near.
CONFIRMED = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.85}
NEAR, STEP = 40, 0.1
FOR = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": "card|credit|visa|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
AGAINST = "example|version|isbn|order|serial"


def _around(rows: DataFrame, kind: str, text: Column) -> DataFrame:
    """Columns ``_m`` and ``_p`` of a kind: matches, and what lies between them."""
    pattern = F.lit(PATTERNS[kind])
    return rows.withColumn(f"_m_{kind}", F.regexp_extract_all(text, pattern, F.lit(0))).withColumn(f"_p_{kind}", F.split(text, PATTERNS[kind], -1))


def _placed(kind: str) -> Column:
    """Array of (start, end, match, near) of the proposed spans."""
    m, p = F.col(f"_m_{kind}"), F.col(f"_p_{kind}")
    pairs = F.arrays_zip(m.alias("m"), p.alias("before"), F.slice(p, 2, F.size(m)).alias("after"))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string,near:string>>)")

    def add(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        near = F.lower(F.concat(F.right(x["before"], F.lit(NEAR)), F.lit(" "), F.left(x["after"], F.lit(NEAR))))
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), near.alias("near"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn sum."""
    def add(acc, c):
        d = c.cast("int") * F.when(acc["odd"], 2).otherwise(1)
        return F.struct((acc["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    signs = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(signs, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add, lambda a: a["sum"] % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an account number (no separators) has remainder 1."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    def add(acc, c):
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    signs = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(signs, F.lit(0), add) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return mod97(F.regexp_replace(match, " ", "")) if kind == "iban" else F.lit(True)


def _scored(kind: str, spans: Column) -> Column:
    def one(x):
        score = F.lit(CONFIRMED[kind]) + F.when(x["near"].rlike(FOR[kind]), STEP).otherwise(0.0) - F.when(x["near"].rlike(AGAINST), STEP).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"),
                        F.translate(x["match"], DOT, ".").alias("match"), F.round(F.least(score, F.lit(1.0)), 3).alias("score"))

    return F.transform(F.filter(spans, lambda x: _confirmed(kind, x["match"])), one)


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii_spans``: array of (start, rank, end, kind, match, score) by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a text without the characters a kind needs is not searched for it
    dotted = F.regexp_replace(F.translate(text, DOT, NO_DOT), f"(?<=[{LABEL}])\\.(?=[{LABEL}])", DOT)
    single = F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "_")
    wanted = {"email": (text.contains("@"), dotted), "ip": (text.rlike(r"[0-9]\.[0-9]"), text), "card": (text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), single),
              "phone": (text.rlike(r"\+[0-9]"), text), "iban": (text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), text)}
    rows = docs.withColumns({f"_t_{k}": F.when(has, t).otherwise("") for k, (has, t) in wanted.items()})
    for k in KINDS:
        rows = _around(rows, k, F.col(f"_t_{k}"))
    rows = rows.withColumns({f"_s_{k}": F.when(F.size(f"_m_{k}") > 0, _scored(k, _placed(k))) for k in KINDS})
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,match:string,score:double>>)")
    rows = rows.withColumn("pii_spans", F.array_sort(F.flatten(F.array(*[F.coalesce(F.col(f"_s_{k}"), none) for k in KINDS]))))
    return rows.drop(*[f"_{a}_{k}" for a in "tmps" for k in KINDS])


def told(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, least: float = 0.5, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every span scored ``least`` or more replaced by its kind in brackets. Where spans overlap, the text from
    the first's start to the last's end goes under the first's kind. A null text stays null; ``count_col``, if named, gets the new length."""
    rows = find_spans(docs, text_col).withColumn("pii_spans", F.filter("pii_spans", lambda x: x["score"] >= least))
    none = F.expr("cast(array() as array<string>)")

    def add(acc, x):
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substr(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    done = F.aggregate("pii_spans", F.struct(F.lit(0).alias("at"), none.alias("out")), add,
                       lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col(text_col), a["at"] + 1)))
    rows = rows.withColumn(text_col, F.when(F.size("pii_spans") > 0, done).otherwise(F.col(text_col))).drop("pii_spans")
    return rows.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col else rows


def op9_pii(spark, sf_dir):
    rows = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda x: x["kind"] != "iban")
    rows = rows.select("doc_id", "pii_spans", base.alias("base"))
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return rows.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("pii_spans")).alias("spans"))


def _duck_kind(kind: str, pattern: str, valid: str) -> str:
    """Confirmed spans (doc_id, kind, rank, s, e) of a kind; ``d`` holds a match's digits, ``m`` the match."""
    return f"""SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS rank, s, s + length(m) AS e FROM (
SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, CAST(coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0)
+ coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
SELECT doc_id, ms, p, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (
SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS p FROM documents WHERE text IS NOT NULL))) WHERE {valid}"""


_LUHN = """length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INTEGER)
ELSE (2 * CAST(d[length(d) - i] AS INTEGER)) // 10 + (2 * CAST(d[length(d) - i] AS INTEGER)) % 10 END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(replace(m, ' ', '')[5:] || m[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48
ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""
_DUCK = "\nUNION ALL ".join([
    _duck_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _duck_kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", f"regexp_full_match(m, '{OCTET}(?:\\.{OCTET}){{3}}')"),
    _duck_kind("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    _duck_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
    _duck_kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", _MOD97)])
QUERIES = {"op9_pii": op9_pii}
ORACLES = {"op9_pii": f"""WITH f AS ({_DUCK}), g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'iban') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""}
