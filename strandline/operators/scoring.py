"""Rule tables as ordered expressions: points, first match, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bands, clamp

Rules = list[tuple[str, float]]


def points(rules: Rules, base: float = 0, low: float = 0, high: float = 100) -> Column:
    """Base plus the points of every rule (SQL condition) that holds, within bounds."""
    total = F.lit(base)
    for condition, p in rules:
        total = total + F.when(F.expr(condition), p).otherwise(0)
    return clamp(total, low, high)


def first_rule(rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first rule (SQL condition) that holds."""
    out = None
    for condition, value in rules:
        out = F.when(F.expr(condition), F.lit(value)) if out is None else out.when(F.expr(condition), F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def reasons(tests: dict[str, str]) -> Column:
    """Names of the tests (SQL conditions) that a row fails, in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(F.expr(t), F.lit(False)), F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def count_reasons(df: DataFrame, tests: dict[str, str]) -> DataFrame:
    return df.select(F.explode(reasons(tests)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def levels(c: Column, high: float, medium: float, names: tuple[str, str, str] = ("high", "medium", "low")) -> Column:
    return F.when(c >= high, names[0]).when(c >= medium, names[1]).otherwise(names[2])


# Points of a found source by what is known of it. The columns are text, lower case, blank if unknown.
STRONG_KINDS = "document_type in ('cba', 'arbitration_award', 'factfinding', 'memorandum_or_settlement', 'wage_schedule_or_compensation_plan')"
SOURCE_POINTS: Rules = [
    ("owner_type = 'city' or contains(lower(url), '.gov')", 20),
    ("owner_type = 'state_labor_board'", 20),
    ("owner_type = 'union'", 12),
    (f"endswith(lower(url), '.pdf') or {STRONG_KINDS}", 15),
    ("completeness = 'full_document'", 10),
    ("exists(regexp_extract_all(contract_years, '(20\\\\d{2})', 1), y -> cast(y as int) >= 2018)", 10),
    ("n_unit_types >= 2", 10),
    ("title <> '' and not generic_title", 8),
    ("union_name not in ('', 'unknown') and employer not in ('', 'unknown')", 8),
    ("unit_type = 'non_safety' and comparator_role in ('', 'ordinary_non_safety_comparator', 'authoritative_civilian_wage_setting')", 7),
    ("owner_type = 'news'", -20),
    ("document_type in ('context_only', 'agenda_cover_sheet', 'meeting_minutes', 'ordinance_or_policy')", -20),
    ("stage in ('context_only_candidate', 'insufficient_candidate') or context_only", -25),
    ("completeness in ('summary_only', 'index_or_landing_page')", -15),
    ("completeness = 'dead_or_unreachable' or document_type in ('dead_or_unreachable', 'insufficient_source')", -30),
    ("blocked or completeness = 'blocked_or_unreadable' or document_type = 'blocked_or_unreadable'", -20),
    ("anchor_overlap = 'non_overlap_deferred'", -20),
    ("duplicate_risk = 'possible'", -15),
    ("duplicate_risk = 'exact_known_source'", -40),
    ("wrong_employer_risk = 'possible'", -15),
    ("wrong_employer_risk = 'high'", -30),
    ("third_party_host", -15),
    ("url = ''", -25),
    ("generic_title", -8),
    ("mentions_request", -25),
    ("owner_type = 'school' and not contains(why_relevant, 'compar')", -15),
]
SOURCE_LEVELS = (65, 35)

# Points of a queued lead, from a base of 25; the verified fields replace the found ones beforehand.
TRIAGE_BASE = 25
TRIAGE_POINTS: Rules = [
    ("owner_type in ('city', 'state_labor_board')", 12),
    ("owner_type = 'union'", 8),
    ("owner_type in ('third_party', 'news', 'school')", -8),
    (STRONG_KINDS, 15),
    ("document_type in ('context_only', 'meeting_minutes', 'agenda_cover_sheet', 'index_page')", -20),
    ("completeness in ('full', 'full_document', 'full_document_with_exhibits')", 12),
    ("completeness in ('partial', 'partial_document')", 3),
    ("completeness in ('index_or_landing_page', 'blocked_or_unreadable', 'dead_or_unreachable')", -15),
    ("n_units = 3", 20),
    ("n_units = 2", 8),
    ("anchor_overlap = 'overlap'", 12),
    ("anchor_overlap = 'non_overlap_deferred'", -15),
    ("year_evidence in ('cover_or_title', 'duration_clause', 'award_period', 'other_operative_text')", 6),
    ("year_evidence in ('index_or_snippet_only', 'model_inference_only')", -4),
    ("confidence = 'high'", 5),
    ("confidence = 'medium'", 2),
    ("context_only", -30),
    ("duplicate_risk = 'possible'", -15),
    ("duplicate_risk = 'exact_known_source'", -45),
    ("is_known", -60),
    ("wrong_employer_risk = 'possible'", -6),
    ("wrong_employer_risk = 'high'", -25),
    ("blocked", -15),
    ("newest_year >= 2018", 5),
    ("oldest_year > 2024", -25),
    ("newest_year < 2014 and not coalesce(oldest_year > 2024, false)", -15),
    ("recommendation = 'later_ingest_candidate'", 15),
    ("recommendation in ('do_not_ingest', 'unreachable_do_not_ingest')", -30),
    ("verification = 'context_only_verified'", -30),
    ("verification = 'duplicate_or_superseded'", -60),
    ("verification in ('unreachable', 'insufficient_evidence')", -35),
    ("wrong_unit", -60),
]
TRIAGE_BUCKETS = [
    ("is_known or verification = 'duplicate_or_superseded'", "already_canonical_hold"),
    ("wrong_unit or verification = 'insufficient_evidence'", "rejected_from_calibration"),
    ("verification = 'unreachable'", "insufficient_hold"),
    ("verification = 'context_only_verified' or (context_only and not verified)", "context_only_hold"),
    ("duplicate_risk in ('possible', 'exact_known_source')", "likely_duplicate_hold"),
    ("completeness in ('blocked_or_unreadable', 'dead_or_unreachable') or (blocked and not verified)", "insufficient_hold"),
    ("score >= 70", "high_priority_later_verify"),
    ("score >= 50", "medium_priority_later_verify"),
]
INGESTION = [
    ("is_known or bucket = 'already_canonical_hold'", "already_ingested_canonical"),
    ("recommendation = 'later_ingest_candidate'", "verified_later_ingest_candidate"),
    ("bucket in ('context_only_hold', 'rejected_from_calibration', 'insufficient_hold', 'likely_duplicate_hold')", "not_queued_for_ingestion"),
]


def triage(df: DataFrame) -> DataFrame:
    """Adds score, bucket and ingestion status to a table with the columns that the triage rules name."""
    out = df.withColumn("score", points(TRIAGE_POINTS, TRIAGE_BASE))
    out = out.withColumn("bucket", first_rule(TRIAGE_BUCKETS, "low_priority_later_verify"))
    return out.withColumn("ingestion", first_rule(INGESTION, "ingestion_deferred_pending_coordinated_verification"))


def source_score(df: DataFrame) -> DataFrame:
    out = df.withColumn("score", points(SOURCE_POINTS))
    return out.withColumn("priority", levels(F.col("score"), *SOURCE_LEVELS))


# Weights of the seven parts of a priority, and two variants.
PRIORITY_WEIGHTS = {"pop": 30, "gov": 10, "state_yield": 20, "research": 20, "geo": 10, "completeness": 5, "evidence": 5}
PRIORITY_VARIANTS = {
    "pop_heavier": {"pop": 40, "gov": 10, "state_yield": 15, "research": 15, "geo": 10, "completeness": 5, "evidence": 5},
    "yield_heavier": {"pop": 25, "gov": 10, "state_yield": 30, "research": 20, "geo": 5, "completeness": 5, "evidence": 5},
}


def priority(weights: dict[str, float] = PRIORITY_WEIGHTS) -> Column:
    """Weighted sum of the parts (each 0 to 1, columns of these names), 0 to 100."""
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.lit(float(w)) * F.col(k)
    return clamp(total)


def evidence_signal(candidates: Column, complete: Column, good: Column, failed: Column) -> Column:
    some = 0.4 + 0.3 * F.least(candidates / 5, F.lit(1.0)) + 0.2 * complete.cast("int") + 0.1 * F.least(good / F.greatest(candidates, F.lit(1)), F.lit(1.0))
    return F.when(candidates > 0, F.least(F.lit(1.0), some)).when(failed, 0.2).otherwise(0.0)


def readiness(covered: Column, positive: Column, high: Column, sets: Column, context: Column) -> Column:
    """0 without anything covered, else 20 to 100 by yield, leads, matched sets and context."""
    s = 20 + 20 * F.coalesce(F.try_divide(positive, covered), F.lit(0.0)) + 20 * F.least(high / 10, F.lit(1.0)) + 30 * F.least(sets / 10, F.lit(1.0)) + 10 * context.cast("int")
    return F.when(covered <= 0, 0.0).otherwise(F.round(F.least(s, F.lit(100.0)), 1))


def yield_advice(n: Column, rate: Column, density: Column) -> Column:
    return (
        F.when(n < 10, "calibration_sample_needed").when((rate >= 0.7) | (density >= 1.75), "strong_yield_consider_next_wave")
        .when((rate >= 0.5) | (density >= 1.0), "moderate_yield_use_priority_targets").otherwise("lower_yield_use_for_strategic_coverage")
    )


def status(successes: Column, failures: Column, found: Column) -> Column:
    """Success before failure before nothing; success split by what was found."""
    return F.when((successes > 0) & (found > 0), "scouted_with_candidates").when(successes > 0, "scouted_no_candidates").when(failures > 0, "scout_attempt_failed_connection").otherwise("not_scouted")


def queue_status(successes: Column, failures: Column, found: Column, queued: Column) -> Column:
    return F.when(queued > 0, "queued_for_later_verification").when(found > 0, "candidate_holds_only").otherwise(status(successes, failures, F.lit(0)))


def group_advice(tier1: Column, tier2: Column, confidence: Column, yield_: Column) -> Column:
    """What to do with a group, by its top-tier rows and how well it is known."""
    many = tier1 >= 25
    return (
        F.when(many & (confidence == "high") & (yield_ >= 0.72), "priority_high_evidence_state").when(many & (confidence == "medium"), "priority_growing_evidence_state")
        .when(many & (confidence == "low"), "priority_exploratory_state").when(tier1 + tier2 >= 25, "cross_state_priority_fill").otherwise("defer_or_geographic_balance_only")
    )


def readiness_level(covered: Column, positive: Column, sets: Column, context: Column) -> Column:
    return (
        F.when(sets > 0, "matched_set_leads_need_verification").when(positive > 0, "candidate_leads_need_verification").when(covered > 0, "scout_coverage_only")
        .when(context, "claim_context_without_current_scout_coverage").otherwise("not_started")
    )


def retry_plan(failed_only: Column, tier: Column) -> Column:
    """(priority, timing) of a retry by tier; not applicable to other rows."""
    pair = lambda a, b: F.struct(F.lit(a).alias("priority"), F.lit(b).alias("timing"))
    return (
        F.when(~failed_only, pair("not_applicable", "not_applicable")).when(tier <= 2, pair("high", "next_separately_authorized_failure_retry_wave"))
        .when(tier == 3, pair("medium", "retry_after_next_300_to_600_new_scouts")).otherwise(pair("low", "defer_until_state_or_selection_balance_requires_retry"))
    )


# Points and tiers of the plain (unsmoothed) score.
SIZE_POINTS = [(50_000, 50), (25_000, 40), (10_000, 30), (5_000, 20), (2_000, 10)]
SIZE_BANDS = [(50_000, "50,000+"), (25_000, "25,000-49,999"), (10_000, "10,000-24,999"), (5_000, "5,000-9,999"), (2_000, "2,000-4,999")]
TYPE_POINTS = {"CITY": 15, "MUNICIPALITY": 12, "BOROUGH": 8, "TOWN": 8, "TOWNSHIP": 5}
PLAIN_TIERS = [(60, "tier_1_high_plausibility"), (45, "tier_2_medium_high_plausibility"), (25, "tier_3_systematic_mid_small")]
CONTEXT_POINTS = {"seen": 10, "positive": 5, "complete": 5}


def plain_score(size: Column, kind: Column, has_site: Column, areas: Column, known: dict[str, Column], several: Column) -> Column:
    """Size and type points, 15 for a site, points for sharing an area with each known set, 3 for lying in several areas."""
    s = bands(F.coalesce(size, F.lit(0)), SIZE_POINTS, 0) + 15 * has_site.cast("int") + 3 * several.cast("int")
    s = s + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_POINTS.items() for x in kv]), F.upper(kind)), F.lit(0))
    for name, group in known.items():
        s = s + F.when(F.arrays_overlap(areas, group), CONTEXT_POINTS[name]).otherwise(0)
    return s


def failure_kind(error: Column, response: Column, has_id: Column, timeout: str, connection: str) -> Column:
    """Kind of a failed response: by markers in the error, then by what came back."""
    low = F.lower(F.coalesce(error, F.lit("")))
    there = F.trim(F.coalesce(response, F.lit(""))) != ""
    return (
        F.when(low.rlike(timeout), "timeout_or_capacity").when(low.rlike(connection), "connection_error").when(there, "json_parse_error")
        .when(has_id, "empty_response_with_response_id").otherwise("empty_response_no_response_id")
    )


def evidence_status(given: Column, excerpt: Column, allowed: tuple[str, ...] = ("present", "not_found", "unclear")) -> tuple[Column, Column]:
    """Status coerced to the allowed ones, and the excerpt, blank unless present."""
    s = F.when(given.isin(*allowed), given).otherwise("unclear")
    return s, F.when(s == "present", F.coalesce(excerpt, F.lit(""))).otherwise("")


def text_quality(layer_chars: Column, scanned_chars: Column, pages: Column, least: int = 100) -> Column:
    """(method, quality): the embedded text if it is rich enough a page, else the scan, else the richer of two poor ones."""
    pair = lambda a, b: F.struct(F.lit(a).alias("method"), F.lit(b).alias("quality"))
    per = lambda c: F.coalesce(c, F.lit(0)) / F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1))
    return (
        F.when(per(layer_chars) >= least, pair("text_layer", "clean")).when((per(scanned_chars) >= least) & (layer_chars > scanned_chars), pair("text_layer", "partial"))
        .when(per(scanned_chars) >= least, pair("ocr", "ocr_messy")).otherwise(pair("text_layer+ocr_partial", "partial"))
    )


def transport_failure(error: Column, response: Column, response_id: Column, tokens_out: Column) -> Column:
    """An error of the connection with neither text, id nor output tokens."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    marked = F.lower(F.coalesce(error, F.lit(""))).rlike("connection error|timed out|timeout|maximum capacity")
    return marked & empty(response) & empty(response_id) & F.lower(F.trim(F.coalesce(tokens_out, F.lit("")))).isin("", "0", "none", "nan")


# Stage of a found row by its kind, state of a verified one.
VERIFIED_STATES = {
    "verified_candidate": "calibration_verified_candidate", "partially_verified_candidate": "calibration_partially_verified_candidate", "context_only_verified": "calibration_context_only",
    "duplicate_or_superseded": "calibration_already_canonical", "unreachable": "calibration_unreachable", "insufficient_evidence": "calibration_insufficient_or_rejected", "trace_only_not_candidate": "calibration_trace_only",
}
BUCKET_ADVICE = {
    "high_priority_later_verify": "include_in_earliest_coordinated_verification_wave",
    "medium_priority_later_verify": "include_after_high_priority_matched_set_leads",
    "low_priority_later_verify": "retain_for_later_gap_or_pattern_review",
    "context_only_hold": "hold_as_locator_or_mechanism_context; verify only with linked qualifying need",
    "likely_duplicate_hold": "deduplicate_against_canonical_and_queue_before source review",
    "insufficient_hold": "hold until a bounded access or completeness task is justified",
    "rejected_from_calibration": "do not re-verify absent new project need or new source evidence",
    "already_canonical_hold": "do not verify or ingest again; retain only for scout-quality accounting",
}


def stage_of(stage: Column, kind: Column) -> Column:
    context = F.trim(F.coalesce(kind, F.lit(""))).isin("context_only", "agenda_cover_sheet", "meeting_minutes", "index_page")
    return F.when(F.trim(F.coalesce(stage, F.lit(""))) != "", F.trim(stage)).when(context, "context_only_candidate").otherwise("legacy_unverified_candidate")


def verified_state(verification: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in VERIFIED_STATES.items() for x in kv])
    return F.when(verification.isNull() | (verification == ""), "not_calibrated").otherwise(F.coalesce(F.element_at(table, verification), F.concat(F.lit("calibration_"), verification)))


def bucket_advice(bucket: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in BUCKET_ADVICE.items() for x in kv]), bucket)
