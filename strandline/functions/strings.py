"""String columns: normalising, labels, keys, redaction. All functions take and return Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Missing: null or empty."""
    return c.isNull() | (c == "")


def text_or(c: Column, default: str) -> Column:
    return F.when(blank(c), F.lit(default)).otherwise(c)


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column) -> Column:
    return F.lower(squeeze(c))


def alnum_key(c: Column) -> Column:
    """Lower case, every other character than a-z and 0-9 a space, squeezed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def snake(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), "[ -]", "_")


# Legal suffixes and prefixes, the longer before the shorter.
LEGAL_SUFFIXES = (
    "city and borough", "consolidated government", "metropolitan government", "unified government", "urban county", "municipality",
    "township", "plantation", "borough", "village", "town", "city",
)
LEGAL_PREFIXES = (
    "consolidated government of", "metropolitan government of", "unified government of", "city and borough of", "city and county of",
    "municipality of", "charter township of", "township of", "borough of", "village of", "town of", "city of",
)
AREA_SUFFIXES = ("County", "Parish", "Borough", "Census Area", "Planning Region", "Municipality", "city", "City and Borough")
AREA_PREFIXES = ("City and Borough of", "Municipality of")


def strip_suffix(c: Column, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """Without the first of ``suffixes`` (any case) that ends the squeezed name."""
    return F.trim(F.regexp_replace(squeeze(c), f"(?i) (?:{'|'.join(suffixes)})$", ""))


def title_case(c: Column) -> Column:
    """First letter of every run of letters upper, the rest lower (also after apostrophes and hyphens)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def strip_prefix_title(c: Column, prefixes: tuple[str, ...] = LEGAL_PREFIXES) -> Column:
    return title_case(F.regexp_replace(squeeze(c), f"(?i)^(?:{'|'.join(prefixes)}) ", ""))


def name_key(c: Column) -> Column:
    return alnum_key(strip_suffix(c))


def area_key(c: Column) -> Column:
    """Area name as a_snake_case key: one prefix and the first listed suffix dropped, no dots or apostrophes."""
    x = F.regexp_replace(F.trim(c), f"^(?:{'|'.join(AREA_PREFIXES)}) ", "")
    tested = None
    for s in AREA_SUFFIXES:
        hit = x.endswith(" " + s)
        cut = F.substring(x, F.lit(1), F.length(x) - len(s) - 1)
        tested = F.when(hit, cut) if tested is None else tested.when(hit, cut)
    x = F.regexp_replace(F.lower(tested.otherwise(x)), "[.']", "")
    return F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), " ", "_")


def area_kind(state: Column, name: Column) -> Column:
    """Kind of county equivalent by state, then by name."""
    far = (
        F.when(name.startswith("City and Borough of ") | name.endswith(" City and Borough"), "city_and_borough")
        .when(name.startswith("Municipality of ") | name.endswith(" Municipality"), "municipality")
        .when(name.endswith(" Census Area"), "census_area").otherwise("borough")
    )
    return (
        F.when(state == "DC", "federal_district").when(state == "CT", "planning_region").when(state == "LA", "parish")
        .when((state == "NV") & (name == "Carson City"), "independent_city").when(state == "AK", far)
        .when(name.endswith(" city"), "independent_city").otherwise("county")
    )


def mapped(c: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """Dictionary lookup; absent keys give ``default`` (or the key itself)."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, c), c if default is None else default)


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """Label of the key, else of its lower case, else the key."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(table, c), F.element_at(table, F.lower(c)), c)


# Owner synonyms; document kinds and the patterns that tell them, in order of precedence.
OWNERS = {
    "city": "city", "city_government": "city", "government": "city", "municipal": "city", "city_legislation_portal": "city", "city_council": "city",
    "municipality": "city", "state_labor_board": "state_labor_board", "labor_board": "state_labor_board", "perc": "state_labor_board",
    "state_agency": "state_labor_board", "union": "union", "labor_union": "union", "union_local": "union", "union_website": "union",
    "school": "school", "school_district": "school", "third_party": "third_party", "document_host": "third_party",
    "private_legal_vendor": "third_party", "legal_database": "third_party", "case_law_database": "third_party",
    "news": "news", "media": "news", "newspaper": "news",
}
DOCUMENT_KINDS = {
    "dead_or_unreachable": r"dead link|unreachable|not found|\b404\b|\b410\b|dns failure",
    "blocked_or_unreadable": "access denied|forbidden|blocked|cannot inspect|unreadable",
    "agenda_cover_sheet": "agenda cover|agenda item|cover sheet",
    "meeting_minutes": "meeting minutes|council minutes|minutes only",
    "memorandum_or_settlement": r"memorandum of agreement|memorandum of understanding|settlement agreement|settlement memorandum|\bmoa\b|\bmou\b",
    "arbitration_award": "arbitration award|interest arbitration|act 111 award",
    "factfinding": "fact[- ]?finding",
    "wage_schedule_or_compensation_plan": "pay plan|wage schedule|salary schedule|compensation plan",
    "ordinance_or_policy": "ordinance|resolution|personnel policy|compensation policy",
    "cba": r"collective bargaining agreement|\bcba\b|labor agreement|full agreement",
    "index_page": r"\bindex\b|contract(s)? (library|page|archive)|document (archive|portal)",
    "insufficient_source": "insufficient|snippet only|search result only|javascript shell",
    "context_only": "news|press release|budget document|operating budget|legislation|summary|meeting memo",
    "unknown": "",
}


def owner_kind(c: Column, synonyms: dict[str, str] = OWNERS) -> Column:
    key = snake(F.coalesce(c, F.lit("")))
    return mapped(key, synonyms, F.when(key == "", "unknown").otherwise(key))


def first_pattern(c: Column, patterns: dict[str, str], default: str = "unknown") -> Column:
    """Name of the first pattern found in ``c``; a value that is a name itself stays."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    plain = F.regexp_replace(low, "[_-]", " ")
    out = F.when(low.isin(*patterns), low)
    for name, p in patterns.items():
        if p:
            out = out.when(plain.rlike(p), name)
    return out.otherwise(default)


def unit_kind(c: Column) -> Column:
    low = snake(F.coalesce(c, F.lit("")))
    return (
        F.when(low.isin("police", "fire", "non_safety", "unclear", "unknown"), low).when(low.contains("police"), "police").when(low.contains("fire"), "fire")
        .when((low.contains("non") & low.contains("safety")) | low.contains("civilian") | low.contains("general_municipal"), "non_safety")
        .when(low.contains("unclear") | low.contains("ambiguous") | low.contains("mixed"), "unclear").otherwise("unknown")
    )


def retry_kind(c: Column, allowed: dict[str, str]) -> Column:
    """Mapped failure kind; an unknown one raises."""
    table = F.create_map(*[F.lit(x) for kv in allowed.items() for x in kv])
    return F.coalesce(F.element_at(table, c), F.raise_error(F.concat(F.lit("unknown failure kind: "), c)))


def yes_no(c: Column, default: str = "unclear") -> Column:
    """yes or no, else the default (the strict reading)."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("yes", "no"), low).otherwise(default)


def truthy(c: Column) -> Column:
    """yes, true or 1 (the lenient reading)."""
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("yes", "true", "1")


def domain(url: Column) -> Column:
    """Between :// and the next slash (port kept), lower case; null without a scheme."""
    return F.lower(F.nullif(F.regexp_extract(url, "://([^/]+)", 1), F.lit("")))


def host_in(url: Column, hosts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: F.contains(F.lower(url), h))


def generated_id(prefix: str, *parts: Column, number: Column, width: int = 4) -> Column:
    return F.concat_ws("-", F.lit(prefix), *parts, F.format_string(f"%0{width}d", number))


def default_id(given: Column, *parts: Column) -> Column:
    return F.when(blank(given), F.concat_ws("_", *parts)).otherwise(given)


def row_identity(kept: Column, own: Column, state: Column, number: Column, name: Column) -> Column:
    """Kept identity, else own id, else state and number, else state and folded name, else an error."""
    ok = lambda c: ~blank(F.trim(c))
    return (
        F.when(ok(kept), F.trim(kept)).when(ok(own), F.concat(F.lit("id:"), F.trim(own)))
        .when(ok(state) & ok(number), F.concat_ws("|", F.lit("number"), F.upper(F.trim(state)), F.trim(number)))
        .when(ok(state) & ok(name), F.concat_ws("|", F.lit("name"), F.upper(F.trim(state)), fold(name)))
        .otherwise(F.raise_error(F.lit("row without identity")))
    )


def legacy_token(identity: Column) -> Column:
    return F.concat(F.lit("legacy_"), F.substring(F.sha2(identity, 256), 1, 20))


# Credential syntax; the first group stays.
CREDENTIALS = (
    r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+",
    r"(?i)(ocp-apim-subscription-key\s*[:=]\s*)[^\s,;]+",
    r"""(?i)((?:api[_-]?key|subscription[_-]?key)\s*[=:]\s*)[^\s,;"']+""",
)


def redact(c: Column, known: tuple[str, ...] = (), patterns: tuple[str, ...] = CREDENTIALS, limit: int | None = 2000) -> Column:
    """Known secrets (the longest first), then credential syntax, become [REDACTED]; cut to ``limit`` (None: whole)."""
    for s in sorted({k for k in known if k}, key=len, reverse=True):
        c = F.replace(c, F.lit(s), F.lit("[REDACTED]"))
    for p in patterns:
        c = F.regexp_replace(c, p, "$1[REDACTED]")
    return c if limit is None else F.substring(c, 1, limit)


def hints(templates: tuple[str, ...], **columns: Column) -> Column:
    """Array of texts from templates with {name} places."""
    out = []
    for t in templates:
        c = F.lit(t)
        for k, v in columns.items():
            c = F.replace(c, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
        out.append(c)
    return F.array(*out)


def coerce_list(c: Column, most: int) -> Column:
    """Non-blank items of an array, ``most`` at most."""
    return F.slice(F.filter(c, lambda x: ~blank(F.trim(x))), 1, most)


def parts_label(*parts: Column, sep: str = " ") -> Column:
    """The non-blank parts in order."""
    return F.array_join(F.filter(F.array(*parts), lambda x: ~blank(F.trim(x))), sep)


def urls_in(text: Column) -> Column:
    """Distinct URLs in order of first sight, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def bold_in(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\*\*([^*]+)\*\*"), F.lit(1)), lambda x: F.trim(x)))
