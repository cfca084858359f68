"""Case grading and the documents and texts around it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.snapshots import latest

# Patterns, thresholds and labels of the grading rules.
STRUCTURING = "(?i)threshold|structur"
CLEAN = "(?i)consistent|long-standing|legitimate"
STRONG_MATCH, CLEAN_LIMIT, WEAK_MATCH = 0.75, 0.7, 0.5
GRADES = ("LOW", "MEDIUM", "HIGH")
RECOMMENDATIONS = ("APPROVE", "DENY", "ESCALATE")
SEVERITIES = ("low", "medium", "high")
CONFIDENCE = 0.6
DECISIONS = ("APPROVED", "DENIED")
# The answers of the two agents: their fields, all required, and the list whose entries carry a severity.
DATA_ANSWER = (
    "grade STRING, recommendation STRING, confidence DOUBLE, rationale STRING, "
    "risk_indicators ARRAY<STRUCT<indicator: STRING, severity: STRING, evidence: STRING>>",
    "risk_indicators", ("indicator", "severity", "evidence"),
)
DOCUMENT_ANSWER = (
    "detected_language STRING, document_summary STRING, "
    "document_findings ARRAY<STRUCT<finding: STRING, severity: STRING, evidence: STRING>>, "
    "grade STRING, recommendation STRING, confidence DOUBLE, grade_changed BOOLEAN, change_reason STRING, rationale STRING",
    "document_findings", ("finding", "severity", "evidence"),
)


def comma_list(column: str) -> Column:
    """Parts of a comma list, trimmed, without empty ones; a null list is empty."""
    parts = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def case_records(flat: DataFrame) -> DataFrame:
    """Flat warehouse rows as nested case records."""

    def party(side: str) -> Column:
        return F.struct(*[F.col(f"{side}_{c}").alias(c) for c in ("name", "country", "id_type")])

    return flat.select(
        F.col("mtcn").cast("string").alias("mtcn"), party("sender").alias("sender"), party("receiver").alias("receiver"),
        F.col("amount").cast("double").alias("amount"), "currency", "corridor", "channel",
        F.struct(
            F.col("gsi_list").alias("list"), F.col("gsi_matched_name").alias("matched_name"),
            F.col("gsi_match_score").cast("double").alias("match_score"), comma_list("gsi_matched_fields").alias("matched_fields"),
        ).alias("gsi_hit"),
        F.struct(
            F.col("transfers_30d").cast("int").alias("transfers_30d"), F.col("total_30d_usd").cast("double").alias("total_30d_usd"),
            F.col("avg_amount_usd").cast("double").alias("avg_amount_usd"),
        ).alias("history"),
        comma_list("flags").alias("flags"),
    )


def flat_case_records(flat: DataFrame) -> DataFrame:
    """The nested record's fields side by side, lists as text, for tools without nesting."""
    r = case_records(flat)
    return r.select(
        "mtcn", "sender.name", "sender.country", "amount", F.col("gsi_hit.match_score").alias("match_score"),
        F.concat_ws("|", "gsi_hit.matched_fields").alias("matched_fields"), F.size("flags").alias("flag_count"),
        F.concat_ws("|", "flags").alias("flags"), F.col("history.transfers_30d").alias("transfers_30d"),
    )


def _has(pattern: str) -> Column:
    return F.exists("flags", lambda f: f.rlike(pattern))


def grade_cases(records: DataFrame) -> DataFrame:
    """Grade, recommendation and confidence by rule, first match wins."""
    score = F.col("gsi_hit.match_score")
    high = (score >= STRONG_MATCH) | _has(STRUCTURING)
    grade = (
        F.when(high, "HIGH")
        .when(_has(CLEAN) & (score < CLEAN_LIMIT), "LOW")
        .when(score >= WEAK_MATCH, "MEDIUM")
        .otherwise("LOW")
    )
    return records.withColumn("grade", grade).select(
        "mtcn", "grade", F.when(F.col("grade") == "LOW", "APPROVE").otherwise("ESCALATE").alias("recommendation"),
        F.lit(CONFIDENCE).alias("confidence"),
    )


def risk_indicators(records: DataFrame) -> DataFrame:
    """One row per indicator: the match strength and, if flagged, possible structuring."""
    score = F.col("gsi_hit.match_score")
    strength = F.struct(
        F.lit(1).alias("position"), F.lit("Screening match strength").alias("indicator"),
        F.when(score >= STRONG_MATCH, "high").when(score >= WEAK_MATCH, "medium").otherwise("low").alias("severity"),
        F.concat(F.col("gsi_hit.list"), F.lit(" (score "), score.cast("string"), F.lit(")")).alias("evidence"),
    )
    suspicious = F.filter("flags", lambda f: f.rlike(STRUCTURING))
    structuring = F.when(
        F.size(suspicious) > 0,
        F.struct(
            F.lit(2).alias("position"), F.lit("Possible structuring").alias("indicator"), F.lit("high").alias("severity"),
            F.get(suspicious, F.lit(0)).alias("evidence"),
        ),
    )
    return records.select("mtcn", F.inline(F.array_compact(F.array(strength, structuring))))


def regrade_with_document(graded: DataFrame, prior: str = "prior_grade") -> DataFrame:
    """Grade after a document was read: the prior grade if it is one, else MEDIUM."""
    keep = F.when(F.col(prior).isin(*GRADES), F.col(prior)).otherwise("MEDIUM")
    return graded.withColumns(
        {
            "document_grade": keep, "document_recommendation": F.lit("ESCALATE"), "document_confidence": F.lit(CONFIDENCE),
            "grade_changed": F.lit(False),
        }
    )


def final_grade(data: DataFrame, documents: DataFrame) -> DataFrame:
    """The document grade where there is one, else the data grade."""
    d = documents.select("mtcn", "document_grade")
    return data.join(d, "mtcn", "left").select("mtcn", F.coalesce("document_grade", "grade").alias("final_grade"))


# File endings, image formats and the characters allowed in a document name.
IMAGE_ENDINGS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "webp": "webp"}
IMAGE_FORMATS = ("png", "jpeg", "gif", "webp")
NAME_FORBIDDEN = r"[^a-zA-Z0-9 \-\(\)\[\]]"
NAME_LENGTH = 60
BLOCK_CHARS = 20000


def route_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Sort documents into pdf, image and text by content type, then by file ending.

    Needs ``filename``, ``content_type`` and ``text``. A text becomes blocks of at most
    ``block_chars`` characters that together hold all of it.
    """
    ct = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    lower = F.lower("filename")
    ending = F.regexp_extract(lower, r"\.([a-z0-9]+)$", 1)
    is_pdf = (ct == "application/pdf") | (ending == "pdf")
    is_image = ct.startswith("image/") | ending.isin(*IMAGE_ENDINGS)
    kind = F.when(is_pdf, "pdf").when(is_image, "image").otherwise("text")
    by_ending = F
    for suffix, fmt in IMAGE_ENDINGS.items():
        by_ending = by_ending.when(ending == suffix, fmt)
    by_type = F.element_at(F.split(ct, "/"), -1)
    fmt = by_ending.otherwise(F.when(by_type.isin(*IMAGE_FORMATS), by_type).otherwise("png"))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    name = F.substring(F.regexp_replace(stem, NAME_FORBIDDEN, "-"), 1, NAME_LENGTH)
    routed = docs.withColumns(
        {
            "route": kind,
            "format": F.when(is_pdf, "pdf").when(is_image, fmt),
            "safe_name": F.when(name == "", "document").otherwise(name),
        }
    )
    text = F.when(F.col("route") == "text", F.coalesce(F.col("text"), F.lit("")))
    last = F.greatest(F.ceil(F.length(text) / block_chars), F.lit(1)).cast("int") - 1
    numbers = F.sequence(F.lit(0), F.coalesce(last, F.lit(0)))
    return routed.withColumn("block_no", F.explode(numbers)).withColumn(
        "block", F.substring(text, F.col("block_no") * block_chars + 1, F.lit(block_chars))
    ).drop("text")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    A plain projection would be merged into every later expression that mentions the
    column, and a JSON text parsed again for each field; a generator is not merged.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def parse_model_outputs(texts: DataFrame, column: str = "text", answer: tuple = DATA_ANSWER) -> dict[str, DataFrame]:
    """Read the JSON object inside each model answer; answers that break the schema go to quarantine.

    The object runs from the first opening to the last closing brace, which also leaves out
    code fences and talk around it. Every field of the ``answer`` and of the entries of its list is required.
    """
    schema, listed, parts = answer
    body = F.nullif(F.regexp_extract(column, r"(?s)\{.*\}", 0), F.lit(""))
    parsed = _once(texts, "_json", body)
    parsed = _once(parsed, "_p", F.from_json("_json", schema, {"mode": "PERMISSIVE"}))
    p = F.col("_p")
    levels = F.coalesce(p[listed], F.array())
    fields = parsed.schema["_p"].dataType.fieldNames()
    lacking = reduce(or_, [p[f].isNull() for f in fields])
    lacking |= F.exists(levels, lambda r: r.isNull() | reduce(or_, [r[f].isNull() for f in parts]))
    bad_level = F.exists(levels, lambda r: ~F.coalesce(r["severity"].isin(*SEVERITIES), F.lit(False)))
    reason = (
        F.when(~F.coalesce(F.col(column).rlike(r"\S"), F.lit(False)), "empty answer")
        .when(F.col("_json").isNull(), "no JSON object")
        .when(p.isNull() | lacking, "schema")
        .when(~p["grade"].isin(*GRADES), "grade")
        .when(~p["recommendation"].isin(*RECOMMENDATIONS), "recommendation")
        .when(bad_level, "severity")
    )
    marked = parsed.withColumn("reason", reason)
    keep = [c for c in texts.columns if c != column]
    good = marked.filter("reason IS NULL").select(*keep, "_p.*")
    return {"good": good, "quarantine": marked.filter("reason IS NOT NULL").select(*keep, "reason", column)}


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Latest accepted decision per case; other actions are refused."""
    valid = decisions.filter(F.col("action").isin(*DECISIONS))
    return latest(valid, ("mtcn",), ("decided_at", "decision_id")).select("mtcn", "action", "grade", "decided_at")


def threshold_structuring(transfers: DataFrame, limit: float, band: float, days: int = 30) -> DataFrame:
    """Per transfer: count, total and average over the sender's last ``days`` days, and how
    many of those lie within ``band`` below the reporting limit.

    Transfers are first summed per (sender, day), so the running window sorts days, not
    transfers: a sender with a third of all transfers is a few thousand rows. The daily
    figures then join back.
    """
    amount = F.col("amount")
    near = (amount < F.lit(limit)) & (amount >= F.lit(limit - band))
    daily = transfers.groupBy("sender_id", "sent_on").agg(
        F.count("*").alias("n"), F.sum("amount").alias("s"), F.count_if(near).alias("u")
    )
    # Day numbers make the range frame a plain integer range.
    w = (
        Window.partitionBy("sender_id")
        .orderBy(F.unix_date("sent_on"))
        .rangeBetween(-days, 0)
    )
    rolling = daily.select(
        "sender_id", "sent_on", F.sum("n").over(w).alias("transfers_30d"),
        F.sum("s").over(w).cast("decimal(38,2)").alias("total_30d"), F.sum("u").over(w).alias("just_under_limit"),
    )
    return transfers.join(rolling, ["sender_id", "sent_on"]).withColumn(
        "avg_amount", F.col("total_30d").cast("double") / F.col("transfers_30d")
    )
