"""Rule-based routing and quality predicates as column expressions.

The word lists and patterns of this module are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say little in any English query.
STOP_WORDS = [
    "a", "an", "the", "of", "in", "on", "at", "for", "to", "and", "or", "is", "are", "was", "were", "be", "been",
    "being", "am", "it", "its", "this", "that", "these", "those", "with", "from", "by", "as", "into", "than", "then",
    "there", "here", "about", "what", "which", "who", "whom", "whose", "where", "when", "how", "why", "did", "does",
    "do", "done", "has", "have", "had", "will", "would", "could", "should", "shall", "can", "may", "might", "must",
    "their", "his", "her", "they", "them", "he", "she", "we", "you", "i", "my", "our", "your", "hers", "not", "no",
]

#: Words whose share marks a prose paraphrase.
FUNCTION_WORDS = [
    "the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "is", "are", "was", "were", "that", "this", "with",
    "from", "by", "as", "at", "be", "it", "they", "its", "his", "her", "their", "how", "who", "which", "where",
    "what", "when", "could", "following",
]

#: Words that a keyword-only variant of a query leaves out.
KEYWORD_STOP = [
    "the", "a", "an", "of", "to", "in", "and", "or", "is", "are", "was", "were", "what", "who", "where", "when",
    "why", "how", "did", "do", "does", "with", "for", "on", "at", "by", "this", "that", "those", "these", "be",
    "been", "have", "has", "had", "i", "you", "he", "she", "it", "we", "they", "my", "your", "their",
]

#: Cues of a complex question.
COMPLEX_CUES = ["compare", "vs", "versus", "difference", "differences", "and", "explain why", "how do", "trade-off", "trade off", "step by step", "all", "list every", "each"]

#: Phrases of an answer that refuses.
REFUSALS = [
    "i don't have", "i cannot find", "i am unable", "i do not have", "the document does not", "the document doesn't",
    "no information about", "not provided in", "not mentioned in", "not available in", "not in the document",
]

#: Level, action, keywords and patterns; the most sensitive level comes first.
PRIVACY = [
    (
        "S3", "redirect",
        ["id_rsa", "private_key", ".pem", ".env", "master_password", "身份证", "银行卡", "病历", "密钥"],
        [r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"AKIA[0-9A-Z]{16}", r"(?i)(password|passwd|pwd)\s*[=:]\s*['\"][^'\"]{8,}", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"],
    ),
    (
        "S2", "desensitize",
        ["password", "api_key", "secret", "token", "credential", "salary", "合同", "客户", "intranet"],
        [r"\b(?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b", r"(?:mysql|postgres|mongodb|redis)://[^\s]+", r"\b(?:sk|key|token)-[A-Za-z0-9]{16,}\b", r"(?i)ghp_[a-zA-Z0-9]{36}"],
    ),
]

#: Tokens that make a summary specific, distinctive tokens of a query, and the signs of a workload.
SPECIFIC = r"\b(\d+(\.\d+)?(%|ms|s|min|h|GB|MB|req/s)?|[A-Z][a-zA-Z]{2,})\b"
DISTINCTIVE = r"\bItem\s+\d+[A-Z]?\b|\b[A-Z]{2,}\b|\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\b\d+\s*(?:percent|%)\b"
TURN = r"(?im)^\s*(user|assistant|system|tool)\s*:"
JSON_KEY = r'"\w+"\s*:\s*[\["\d{tn]'
STAMP = r"\b\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:?\d{2})?)?\b"


#: Java's word boundary counts letters with accents as parts of words, that of SQL engines only ASCII ones.
ASCII_BOUND = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries between ASCII letters, digits and underscores and all else."""
    return pattern.replace(r"\b", ASCII_BOUND)


def stripped(text: Column) -> Column:
    """Without blanks of any kind at both ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def any_of(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def privacy(text: Column, rules=PRIVACY) -> Column:
    """struct(level, action, matched) of the first rule that fires; S1, passthrough and an empty text where none does."""
    low, out = F.lower(text), None
    for level, action, keywords, patterns in rules:
        tests = [(F.contains(low, F.lit(k.lower())), f"keyword:{k}") for k in keywords] + [(text.rlike(p), f"pattern:{p[:24]}") for p in patterns]
        for fires, matched in tests:
            hit = F.struct(F.lit(level).alias("level"), F.lit(action).alias("action"), F.lit(matched).alias("matched"))
            out = F.when(fires, hit) if out is None else out.when(fires, hit)
    return out.otherwise(F.struct(F.lit("S1").alias("level"), F.lit("passthrough").alias("action"), F.lit("").alias("matched")))


def complexity(text: Column, cues: list[str] = COMPLEX_CUES) -> Column:
    """0.15 for each capitalised word up to 4, 0.25 for each cue up to 3, 0.2 for a conjunction or a comma."""
    low = F.lower(text)
    caps = F.least(F.regexp_count(text, F.lit(r"\b[A-Z][a-zA-Z]+\b")), F.lit(4))
    n = sum((F.contains(low, F.lit(c)).cast("int") for c in cues), F.lit(0))
    joint = (F.contains(low, F.lit(" and ")) | F.contains(text, F.lit(","))).cast("int")
    return F.round(caps * 0.15 + F.least(n, F.lit(3)) * 0.25 + joint * 0.2, 3)


def query_type(text: Column, function_words: list[str] = FUNCTION_WORDS) -> Column:
    """`mixed` for questions; `vec` for texts that begin with or are rich in function words; `kw` with distinctive tokens."""
    raw = stripped(text)
    w = F.split(raw, r"\s+")
    share = F.size(F.filter(w, lambda x: F.lower(x).isin(function_words))) / F.size(w)
    leads = F.lower(w[0]).isin(function_words) & w[0].rlike("^[a-z]")
    return F.when(raw.endswith("?"), "mixed").when(leads | (share >= 0.4), "vec").when(raw.rlike(ascii_bounds(DISTINCTIVE)) | raw.rlike("^[A-Z]"), "kw").otherwise("vec")


def low_quality(text: Column, refusals: list[str] = REFUSALS, least: int = 80) -> Column:
    """Empty, `insufficient context`, a refusal, short, or without a page citation."""
    t = stripped(text)
    low = F.lower(t)
    return any_of(low, ["insufficient context", *refusals]) | (F.length(t) < least) | ~any_of(low, ["[page", "pages"])


def word_count(text: Column) -> Column:
    """Runs of anything but blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def length_score(n: Column) -> Column:
    """1 at 15 words, less by a fifteenth for each word away from there; 0 below 5 words and 0.2 above 40."""
    return F.when(n < 5, 0.0).when(n > 40, 0.2).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(n - 15) / 15.0))


def specificity(text: Column) -> Column:
    """A third for each number or capitalised word, up to 1."""
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(SPECIFIC)) / 3.0)


def novelty(best: Column) -> Column:
    """1 less the highest similarity to what is stored; 1 where nothing is."""
    return F.coalesce(1 - best, F.lit(1.0))


def quality(text: Column, best: Column) -> Column:
    """Weighted length, specificity and novelty; `best` is the highest similarity to what is stored."""
    return F.round(0.3 * length_score(word_count(text)) + 0.4 * specificity(text) + 0.3 * novelty(best), 6)


def workload(text: Column) -> Column:
    """struct(shape, confidence): conversation, log_stream, structured or unknown, by speakers and densities per line."""
    speakers = F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TURN), F.lit(1)), lambda s: F.lower(s))))
    breaks = F.regexp_count(text, F.lit("\n"))
    lines = F.greatest(breaks + F.when(text.endswith("\n"), 0).otherwise(1), F.lit(1))
    keys, stamps = F.regexp_count(text, F.lit(JSON_KEY)) / lines, F.regexp_count(text, F.lit(STAMP)) / lines
    mean = (F.length(text) - breaks) / lines

    def out(shape: str, confidence: float) -> Column:
        return F.struct(F.lit(shape).alias("shape"), F.lit(confidence).alias("confidence"))

    rules = F.when(F.coalesce(F.length(text), F.lit(0)) < 8, out("unknown", 0.0)).when(speakers >= 2, out("conversation", 0.9)).when(speakers == 1, out("conversation", 0.8))
    rules = rules.when((keys >= 0.5) & (stamps >= 0.5) & (mean < 200), out("log_stream", 0.9)).when((keys >= 0.7) & (stamps < 0.2), out("structured", 0.85))
    return rules.otherwise(out("unknown", 0.4))


def layered(text: Column, speaker: Column) -> Column:
    """struct(shape, timing, store, confidence): a declared speaker decides first, then a confident shape, else read time."""

    def out(shape: str, timing: str, store: str, confidence: Column | float) -> Column:
        c = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(shape).alias("shape"), F.lit(timing).alias("timing"), F.lit(store).alias("store"), c.alias("confidence"))

    seen = workload(text)
    sure = lambda shape: (seen["shape"] == shape) & (seen["confidence"] >= 0.85)
    return (
        F.when(F.lower(speaker).isin("user", "system"), out("structured", "write_time", "guild", 0.95))
        .when(F.lower(speaker) == "tool", out("log_stream", "write_time", "typed_schema", 0.95))
        .when(sure("conversation"), out("conversation", "read_time", "qdrant", seen["confidence"]))
        .when(sure("log_stream"), out("log_stream", "write_time", "typed_schema", seen["confidence"]))
        .when(sure("structured"), out("structured", "write_time", "guild", seen["confidence"]))
        .otherwise(out("unknown", "read_time", "qdrant", 0.5))
    )
