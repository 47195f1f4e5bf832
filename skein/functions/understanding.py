"""What a question asks for: intent, format, entities, time references, metrics.  Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words of the classification, in the order of precedence.
DIRECT = {
    "greeting": (r"^hi$", r"^hello$", r"^hey$", r"^hi there$", r"^hello there$", r"^good\s*(morning|afternoon|evening)$", r"^greetings$", r"^howdy$", r"^hiya$", r"^yo$"),
    "chitchat": (r"^how\s+are\s+you", r"^what'?s\s+up", r"^how\s+do\s+you\s+do", r"^how'?s\s+it\s+going", r"^what\s+is\s+your\s+name", r"^who\s+are\s+you", r"^are\s+you\s+(a\s+)?(robot|ai|bot)", r"^what\s+can\s+you\s+do"),
    "gratitude": (r"^thank\s*you", r"^thanks", r"^thx", r"^appreciate", r"^great\s+job", r"^well\s+done", r"^good\s+job"),
    "farewell": (r"^bye", r"^goodbye", r"^see\s+you", r"^take\s+care", r"^later$", r"^cya$"),
    "help": (r"^help$", r"^help\s+me", r"^what\s+can\s+you\s+(do|help)", r"^how\s+to\s+use", r"^commands$", r"^\?$"),
}
INTENTS = {
    "comparison": (r"\bcompare\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference\s+between\b", r"\bhigher\s+than\b", r"\blower\s+than\b", r"\bmore\s+than\b", r"\bless\s+than\b", r"\bbetter\b", r"\bworse\b"),
    "trend": (r"\btrend\b", r"\bover\s+time\b", r"\bover\s+the\s+years?\b", r"\bgrowth\b", r"\bchange[ds]?\b", r"\bincrease[ds]?\b", r"\bdecrease[ds]?\b", r"\bevolution\b", r"\bhistor(y|ical)\b"),
    "aggregation": (r"\btotal\b", r"\bsum\b", r"\baverage\b", r"\bmean\b", r"\boverall\b", r"\bcombined\b", r"\baggregate\b"),
    "list": (r"\blist\b", r"\bwhat\s+are\s+(the|all)\b", r"\bshow\s+(me\s+)?(all|the)\b", r"\benumerate\b", r"\bname\s+(all|the)\b", r"\bidentify\s+(all|the)\b"),
    "explanation": (r"\bwhy\b", r"\bexplain\b", r"\bhow\s+does\b", r"\bhow\s+do\b", r"\breason\b", r"\bcause\b", r"\bimpact\b", r"\baffect\b"),
    "yes_no": (r"^is\s+", r"^are\s+", r"^does\s+", r"^do\s+", r"^did\s+", r"^was\s+", r"^were\s+", r"^has\s+", r"^have\s+", r"^can\s+"),
    "summary": (r"\bsummar(y|ize)\b", r"\boverview\b", r"\bbrief\b", r"\bhighlight\b", r"\bkey\s+points?\b", r"\bmain\s+points?\b"),
}
FORMATS = {"factual": "single_value", "comparison": "comparison_table", "trend": "paragraph", "aggregation": "single_value", "list": "bullet_list", "explanation": "paragraph", "yes_no": "paragraph", "summary": "bullet_list"}
METRIC_WORDS = tuple("revenue sales income profit loss margin expense cost ebitda ebit eps earnings asset liability equity debt cash capital roi roe roa ratio growth return dividend share stock market price value".split())
TIME_PATTERNS = (r"\b(q[1-4])\b", r"\b(fy\s*\d{2,4})\b", r"\b(20\d{2})\b", r"\b(fiscal\s+year)\b", r"\b(quarter)\b", r"\b(annual)\b", r"\b(yearly)\b", r"\b(monthly)\b", r"\b(ytd)\b")
COMPARED = (r"(\w+)\s+(?:vs\.?|versus)\s+(\w+)", r"compare\s+(\w+)\s+(?:and|to|with)\s+(\w+)", r"between\s+(\w+)\s+and\s+(\w+)")
GENERAL = (r"\btell\s+me\s+about\b", r"\bwhat\s+do\s+you\s+know\b", r"\bgive\s+me\s+information\b", r"\boverall\b")
CALCULATION = (r"\bcalculate\b", r"\bcompute\b", r"\bsum\b", r"\btotal\b", r"\baverage\b", r"\bpercentage\b", r"\bratio\b", r"\bgrowth\s+rate\b")
ENGINE_INTENTS = {
    "comparison": (r"\bcompare\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference\b", r"\bhigher\b", r"\blower\b"),
    "trend": (r"\btrend\b", r"\bover time\b", r"\bgrowth\b", r"\bincrease\b", r"\bdecrease\b", r"\bchange\b"),
    "aggregation": (r"\btotal\b", r"\bsum\b", r"\baverage\b", r"\bcount\b", r"\bhow many\b", r"\bhow much\b"),
    "lookup": (r"\bwhat is\b", r"\bwhat was\b", r"\bwhat are\b", r"\bshow me\b", r"\bfind\b", r"\blist\b"),
    "analytical": (r"\bwhy\b", r"\bexplain\b", r"\banalyze\b", r"\bimpact\b", r"\bcause\b", r"\breason\b"),
}
EXPANSIONS = {"comparison": "comparison analysis", "trend": "over time historical", "aggregation": "total summary"}
PREFERRED = (("balance sheet", "balance_sheet"), ("income statement", "income_statement"), ("cash flow", "cash_flow"))

#: Our own wording.
DIRECT_RESPONSES = {
    "greeting": "Hello! Load some documents and ask about their figures, trends or segments.",
    "chitchat": "All well here. I answer questions about the documents you load.",
    "gratitude": "You're welcome. Ask on whenever you like.",
    "farewell": "Goodbye!",
    "help": "Load documents (pdf, docx, xlsx, csv, txt), then ask: 'What is the total revenue?', 'Compare Q1 and Q2', 'List the segments'.",
    "unclear": "Please say more: which figure, document or period do you mean?",
}


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found; one alternation, so the text is scanned once."""
    return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def first_of(text: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for kind, patterns in kinds.items():
        hit = any_of(text, patterns)
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def metrics_asked(low: Column) -> Column:
    return F.filter(F.array(*[F.lit(m) for m in METRIC_WORDS]), lambda m: low.contains(m))


def unclear(low: Column) -> Column:
    words = F.size(F.regexp_extract_all(low, F.lit(r"(?U)\S+"), F.lit(0)))
    return (F.length(low) < 3) | ~low.rlike("[a-zA-Z]") | ((words < 2) & (F.size(metrics_asked(low)) == 0))


def analysis(query: Column) -> Column:
    """struct(query_type, response_format, requires_search, key_entities, time_references, metrics, comparison_items, is_specific, requires_calculation, direct_response)."""
    low = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"(?U)^\s+|\s+$", "")
    direct = first_of(low, DIRECT)
    kind = F.when(direct.isNotNull(), direct).when(unclear(low), F.lit("unclear")).otherwise(F.coalesce(first_of(low, INTENTS), F.lit("factual")))
    searched = ~kind.isin("unclear", *DIRECT)
    shape = F.when(low.rlike("breakdown|by segment|by category"), F.lit("table")).when(low.rlike("step|how to"), F.lit("step_by_step")).otherwise(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[kind])
    none = F.array().cast("array<string>")
    quoted = F.regexp_extract_all(low, F.lit('"([^"]+)"'), F.lit(1))
    times = F.concat(*[F.regexp_extract_all(low, F.lit(f"(?U){p}"), F.lit(1)) for p in TIME_PATTERNS])
    metrics = metrics_asked(low)
    pair = lambda p: F.when(low.rlike(f"(?U){p}"), F.array(F.regexp_extract(low, f"(?U){p}", 1), F.regexp_extract(low, f"(?U){p}", 2))).otherwise(none)
    compared = F.when(kind == "comparison", F.concat(*[pair(p) for p in COMPARED])).otherwise(none)
    specific = (F.size(metrics) > 0) | (F.size(quoted) > 0) | ~any_of(low, GENERAL)
    only = lambda c, other: F.when(searched, c).otherwise(other)
    answers = F.create_map(*[F.lit(x) for kv in DIRECT_RESPONSES.items() for x in kv])
    return F.struct(
        kind.alias("query_type"), only(shape, F.lit("direct_message")).alias("response_format"), searched.alias("requires_search"), only(quoted, none).alias("key_entities"), only(times, none).alias("time_references"),
        only(metrics, none).alias("metrics"), compared.alias("comparison_items"), only(specific, F.lit(False)).alias("is_specific"), only(any_of(low, CALCULATION), F.lit(False)).alias("requires_calculation"),
        F.when(~searched, F.try_element_at(answers, kind)).alias("direct_response"),
    )


def engine_intent(query: Column) -> Column:
    return F.coalesce(first_of(F.lower(query), ENGINE_INTENTS), F.lit("general"))


def expanded(query: Column, intent: Column) -> Column:
    out = query
    for kind, words in EXPANSIONS.items():
        out = F.when(intent == kind, F.concat(query, F.lit(f" {words}"))).otherwise(out)
    return out


def filter_hints(query: Column, has_date: Column) -> Column:
    """struct(date_mentioned, preferred_type)."""
    preferred = None
    for words, kind in PREFERRED:
        hit = F.lower(query).contains(words)
        preferred = F.when(hit, F.lit(kind)) if preferred is None else preferred.when(hit, F.lit(kind))
    return F.struct(has_date.alias("date_mentioned"), preferred.alias("preferred_type"))
