"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Base kinds (fixed patterns; leftmost, not overlapping within a kind; a match that fails its check is
dropped and not retried): ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits that pass the
Luhn sum), ``phone`` (8 to 15 digits). Base spans always stay. Added kinds: ``iban`` (confirmed by the
mod-97 remainder) and ``ssn`` (no checksum exists, so it stays only if a word nearby speaks for it).

A span's score is the prior of its kind, plus CONTEXT if one of the kind's words stands in the WINDOW
characters before it, less CONTEXT if one of the words for other numbers does; added kinds need MIN_SCORE.

Positions come from marking each match in the text and splitting at the mark, so everything is Spark SQL.
Group repetitions are possessive: nothing follows them that could take characters back, so the matches are
the same, and Java's matcher does not recurse on long runs.

Defined cases: null text is empty and has no spans; the two control characters used as marks count as an
ordinary character outside every pattern; ids, ties, repeated rows and other columns don't matter; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, OTHER = "\u0001", "\u0003"
WINDOW = 40
CONTEXT = 0.3
MIN_SCORE = 0.6

# A match starts where a run of its characters does, or where the last match ended in one: from inside, it would fail as from the start.
# Kinds in order, with pattern, a cheap sign that a text may hold one, prior score and words that speak for the kind.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", r"@[A-Za-z0-9-]+\.", 0.9, "mail|contact|write|reply"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9]\.[0-9]", 0.7, "ip|address|host|server|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", 0.8, "card|visa|credit|payment|debit|master"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|mobile|fax|cell"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank|transfer"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, "ssn|social|security|tax"),
}
BASE = ("email", "ip", "card", "phone")
AGAINST = "order|invoice|isbn|version|serial|ticket|part|model"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string is divisible by 10."""
    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda a: a["sum"] % 10 == 0)


def _mod97(value: Column) -> Column:
    """The country code and check digits moved to the end, letters as 10 to 35: the remainder by 97 is 1."""
    v = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)
    return F.length(v).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), add) == 1)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return _mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """array<struct(kind, start, end, value, score)> of one kind in ``text``, ordered by start."""
    pattern, sign, prior, words = KINDS[kind]
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)

    def add(acc: Column, p: Column) -> Column:
        end = acc["pos"] + F.length(p)
        hit = F.array(F.struct(acc["pos"].alias("start"), end.alias("end"), p.alias("value")))
        return F.struct(end.alias("pos"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    found = F.filter(F.aggregate(pieces, start, add, lambda a: a["out"]), lambda s: _valid(kind, s["value"]))

    def score(s: Column) -> Column:
        at = F.greatest(s["start"] - WINDOW, F.lit(0))
        near = F.lower(F.substring(text, at + 1, s["start"] - at))
        sc = F.lit(prior) + F.when(near.rlike(rf"\b(?:{words})"), CONTEXT).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{AGAINST})"), CONTEXT).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sc)), 2).alias("score"))

    scored = F.transform(found, score)
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s["score"] >= MIN_SCORE)
    return F.when(text.rlike(sign), scored).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a struct ``out`` of one array of spans (kind, start, end, value, score) per kind, ordered
    by start. ``start`` and ``end`` count code points; end is exclusive."""
    clean = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), MARK, OTHER)
    return docs.withColumn("_pii_text", clean).withColumn(out, F.struct(*[_spans(F.col("_pii_text"), k).alias(k) for k in KINDS])).drop("_pii_text")


def _joined(arrays: list[Column]) -> Column:
    """kind:start:end, comma-joined."""
    every = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; where spans of two kinds overlap, the
    first one names the place and both are covered. Null text stays null."""
    found = find_pii(docs, text, "_pii")
    spans = F.array_sort(F.transform(F.concat(*[F.col(f"_pii.{k}") for k in KINDS]), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    t = F.col(text)

    def add(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["pos"]
        head = F.concat(acc["out"], F.substring(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(free, head).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, add, lambda a: F.concat(a["out"], F.substring(t, a["pos"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t)).drop("_pii")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and scores (in the order of spans)."""
    found = find_pii(docs.select("doc_id", "text"))
    arr = {k: F.col(f"pii.{k}") for k in KINDS}
    scores = F.array_join(F.transform(F.concat(*arr.values()), lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *[F.size(arr[k]).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(_joined([arr[k] for k in BASE]), 256).alias("base_sha256"), _joined(list(arr.values())).alias("spans"), scores.alias("scores"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text replaced and n_chars counted anew where the text changed."""
    old = docs.withColumn("_old", F.col("text"))
    new = redact(old)
    changed = ~F.col("text").eqNullSafe(F.col("_old"))
    return new.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def _oracle() -> str:
    """The base kinds, counted and placed by DuckDB with plain patterns; added kinds are tested apart."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"""
    check = {"email": "true", "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) < 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') <= '255')))",
             "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15"}
    parts = []
    for n, k in enumerate(BASE):
        parts.append(f"""SELECT doc_id, {n} AS k, s, s + length(v) AS e, v, lower(substring(t, greatest(s - {WINDOW}, 0)::BIGINT + 1, (s - greatest(s - {WINDOW}, 0))::BIGINT)) AS near FROM (
          SELECT doc_id, t, unnest(list_transform(range(2, len(p) + 1, 2), lambda i: p[i])) AS v,
                 unnest(list_transform(range(2, len(p) + 1, 2), lambda i: list_sum(list_transform(p[1:i - 1], lambda x: length(x))))) AS s
          FROM (SELECT doc_id, t, string_split(regexp_replace(t, '({plain[k]})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM d WHERE regexp_matches(t, '{plain[k]}')))
          WHERE {check[k]}""")
    cols = ", ".join(f"coalesce(sum((k = {n})::INT), 0)::BIGINT AS n_{k}" for n, k in enumerate(BASE))
    name = "CASE k " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(BASE)) + " END"
    join = f"coalesce(string_agg({name} || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY k, s), '')"
    score = "round(least(1, greatest(0, CASE k " + " ".join(f"WHEN {n} THEN {KINDS[k][2]} + 0.3 * regexp_matches(near, '\\b(?:{KINDS[k][3]})')::INT" for n, k in enumerate(BASE)) + f" END - 0.3 * regexp_matches(near, '\\b(?:{AGAINST})')::INT)), 2)::DOUBLE"
    return f"""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(3)) AS t FROM documents),
    hit AS ({' UNION ALL '.join(parts)})
    SELECT doc_id, {cols}, sha256({join}) AS base_sha256, {join} AS spans, coalesce(string_agg({score}, ',' ORDER BY k, s) FILTER (k IS NOT NULL), '') AS scores
    FROM d LEFT JOIN hit USING (doc_id) GROUP BY doc_id"""


ORACLE = _oracle()
