"""Query strings, lenient parsing, grading and small decision rules over model answers, as column expressions.

Patterns and word lists marked so are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Proper nouns, words that begin a question, characters with a meaning in a full-text query.
PROPER = r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b"
ASKING = ["Which", "What", "How", "When", "Where", "Who", "Why", "Tell", "List"]
RESERVED = r'[+\-!(){}\[\]^"~*?:\\/]'

#: Questions whose answer is put together from several places.
SYNTHESIS = [
    r"what did .+ (say|write|describe|note|mention)", r"how does .+ (describe|characterize|frame|portray|view)", r"what does .+ (say|write|think) about",
    r"how (do|does) .+ (relate|connect|compare)", r"(discuss|describe).+(non-controlled|relationship|approach|philosophy)", r"what.+(secret weapon|moat|advantage|edge)",
]

#: Capitalised words that name nothing.
NO_NAMES = ["What", "Who", "Where", "Which", "When", "How", "Why", "Does", "Did", "Is", "Are", "The", "In", "Of", "A", "An"]
NAME = r"\b[A-Z][a-zA-Z]+\b"


def seeds(text: Column) -> Column:
    """The first five proper nouns that are not question words."""
    return F.slice(F.filter(F.regexp_extract_all(text, F.lit(PROPER), F.lit(0)), lambda s: ~s.isin(ASKING)), 1, 5)


def query_tokens(text: Column) -> Column:
    """Lower-cased tokens of three characters or more, without reserved characters."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, RESERVED, " ")), r"\s+"), lambda t: F.length(t) >= 3)


def all_query(text: Column) -> Column:
    """A query that requires every token; one token stands alone, none gives the text."""
    t = query_tokens(text)
    return F.when(F.size(t) == 0, F.trim(text)).when(F.size(t) == 1, F.element_at(t, 1)).otherwise(F.array_join(F.transform(t, lambda x: F.concat(F.lit("+"), x)), " "))


def any_query(text: Column) -> Column:
    """A query for any token, of capitalised words only where there are some."""
    proper = F.filter(F.split(text, r"\s+"), lambda w: w.rlike("^[A-Z]"))
    t = query_tokens(F.when(F.size(proper) > 0, F.array_join(proper, " ")).otherwise(text))
    return F.when(F.size(t) > 0, F.array_join(t, " OR ")).otherwise(F.trim(text))


def is_synthesis(text: Column) -> Column:
    low, out = F.lower(F.trim(text)), F.lit(False)
    for p in SYNTHESIS:
        out = out | low.rlike(p)
    return out


def short_lookup(text: Column) -> Column:
    """`keyword` for at most nine words with two names or more, else `hybrid`."""
    names = F.size(F.filter(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), lambda w: ~w.isin(NO_NAMES)))
    return F.when((names >= 2) & (F.size(F.split(text, r"\s+")) <= 9), "keyword").otherwise("hybrid")


def answer_of(text: Column) -> Column:
    """What follows the first `ANSWER:` on its line, or the text; lower-cased, without dots at the end."""
    found = F.regexp_extract(text, r"(?i)ANSWER:\s*(.+?)(?:\n|$)", 1)
    t = F.trim(F.when(F.length(found) > 0, found).otherwise(text))
    return F.lower(F.regexp_replace(t, r"\.+$", ""))


def plain_number(text: Column) -> Column:
    """Without dots at both ends, currency, grouping commas, percent signs and zeros after a point; lower-cased."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\.+|\.+$", ""), "[$,%]", ""))
    return F.lower(F.when(t.rlike(r"^-?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t))


def grade_last(reply: Column, expected: Column) -> Column:
    """Whether the last `ANSWER:` gives what is expected; false without one."""
    found = F.regexp_extract_all(reply, F.lit(r"(?i)ANSWER:\s*(.+)"), F.lit(1))
    return F.when(F.size(found) > 0, plain_number(F.element_at(found, -1)) == plain_number(expected)).otherwise(F.lit(False))


def has_number(text: Column, expected: Column) -> Column:
    """Whether the expected number stands anywhere in the text, up to 1e-6; grouping commas do not matter."""
    found = F.regexp_extract_all(F.regexp_replace(text, ",", ""), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.exists(found, lambda x: F.abs(x.try_cast("double") - expected) < 1e-6)


def json_candidates(raw: Column) -> Column:
    """The text without a code fence, then its part from the first to the last bracket."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.filter(F.array(bare, inner), lambda c: F.length(c) > 0)


def json_items(raw: Column) -> Column:
    """The items of the first candidate that begins with a JSON array, as texts without blanks at their ends; else none."""
    parsed = F.filter(F.transform(json_candidates(raw), lambda c: F.from_json(F.when(c.rlike(r"^\s*\["), c), "array<string>")), lambda a: a.isNotNull() & ~F.exists(a, lambda x: x.isNull()))
    items = F.coalesce(F.try_element_at(parsed, F.lit(1)), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def json_objects(raw: Column) -> Column:
    """The items that are objects, as JSON texts."""
    return F.filter(json_items(raw), lambda x: x.startswith("{") & F.get_json_object(x, "$").isNotNull())


def coerced(item: Column) -> Column:
    """struct(key, value) of an item: of an object's `key` and `value`, or its first pair; other items have no key."""
    pairs = F.map_entries(F.from_json(F.when(item.startswith("{"), item), "map<string,string>"))
    named = F.get_json_object(item, "$.key")
    first = F.try_element_at(pairs, F.lit(1))
    return F.struct(F.coalesce(named, first["key"]).alias("key"), F.coalesce(F.when(named.isNotNull(), F.get_json_object(item, "$.value")), first["value"], item).alias("value"))


#: Fixed value: a step of a plan.
STEP = r"(?m)#E(\d+)\s*=\s*(\w+)\s*\[(.*?)\]\s*$"


def plan_steps(text: Column) -> Column:
    """array<struct(name, tool, args)> of the steps of a plan."""
    lines = F.regexp_extract_all(text, F.lit(STEP), F.lit(0))
    return F.transform(lines, lambda x: F.struct(F.concat(F.lit("#E"), F.regexp_extract(x, STEP, 1)).alias("name"), F.regexp_extract(x, STEP, 2).alias("tool"), F.trim(F.regexp_extract(x, STEP, 3)).alias("args")))


def substituted(args: Column, evidence: Column) -> Column:
    """`args` with every name of the map `evidence` replaced by its value, quoted names with their quotes.

    Longer names first, so that #E12 is not read as #E1.
    """
    order = F.array_sort(F.map_keys(evidence), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(order, args, lambda s, k: F.replace(F.replace(s, F.concat(F.lit('"'), k, F.lit('"')), evidence[k]), k, evidence[k]))


def unlinked(text: Column) -> Column:
    """[[folder/some-name]] as `some name`."""
    links = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.aggregate(F.array_distinct(links), text, lambda s, x: F.replace(s, F.concat(F.lit("[["), x, F.lit("]]")), F.replace(F.element_at(F.split(x, "/"), -1), F.lit("-"), F.lit(" "))))


def semantic_query(title: Column, body: Column) -> Column:
    """Tokens of more than two characters of the first sentence that the title lacks; null if fewer than three are left."""
    plain = F.trim(F.regexp_replace(unlinked(F.trim(F.regexp_replace(body, "(?m)^#.*$", ""))), r"\s+", " "))
    first = F.regexp_extract(plain, r"^(.*?[.!?])(\s|$)", 1)
    first = F.when(F.length(first) > 0, first).otherwise(plain)
    tokens = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))
    own = tokens(title)
    kept = F.filter(tokens(first), lambda t: (F.length(t) > 2) & ~F.array_contains(own, t))
    return F.when(F.size(kept) >= 3, F.array_join(kept, " "))


def title_tail(raw: Column, fallback: Column) -> Column:
    """What follows the last `>` of a breadcrumb, or the fallback."""
    tail = F.trim(F.element_at(F.split(F.coalesce(raw, F.lit("")), ">"), -1))
    return F.coalesce(F.nullif(tail, F.lit("")), fallback)


def kept_entries(text: Column, marks: tuple[str, ...] = ("· [completed]", "· [journal]")) -> Column:
    """Lines that begin with a mark, without it, joined by blanks; the text itself without such lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))

    def cut(line: Column) -> Column:
        return F.coalesce(*[F.when(line.startswith(m), F.trim(F.substring(line, len(m) + 1, 1 << 30))) for m in marks])

    kept = F.filter(F.transform(lines, cut), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def session_time(text: Column) -> Column:
    """A time like `2023/04/10 (Mon) 17:50`, or its day alone; null for anything else."""
    t = F.trim(F.regexp_replace(text, r"\s*\([^)]*\)", ""))
    return F.coalesce(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}$"), t), F.lit("yyyy/M/d H:m")), F.try_to_timestamp(F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), t), F.lit("yyyy/M/d")))


def session_index(id_: Column) -> Column:
    """The number after `sess` in an id, else -1."""
    return F.coalesce(F.nullif(F.regexp_extract(id_, r"sess(\d+)", 1), F.lit("")).try_cast("int"), F.lit(-1))


def testability(dynamic: Column, concurrent: Column, decorated: Column, io: Column) -> Column:
    """The first of four flags decides."""
    return F.when(dynamic, "escalate").when(concurrent, "property_test").when(decorated, "fixture_required").when(io, "mock_required").otherwise("pure_stateless")


def regime(first_batch: Column, first_rate: Column, last_batch: Column, last_rate: Column, n: Column) -> Column:
    """How throughput scales with the batch size, from the first to the last measurement."""
    scaling = F.try_divide(F.try_divide(last_rate, first_rate), F.try_divide(last_batch, first_batch))
    return F.when(n < 2, "insufficient_data").when(scaling > 0.8, "compute-bound").when(scaling < 0.4, "memory-bound").otherwise("mixed")


def heavier(a: Column, b: Column, order: list[str]) -> Column:
    """Of two labels the one that comes later in `order`."""
    at = F.array(*map(F.lit, order))
    return F.when(F.array_position(at, a) >= F.array_position(at, b), a).otherwise(b)


def at_least(items: Column, least: int) -> Column:
    """All items, or none if there are fewer than `least`."""
    return F.when(F.size(items) >= least, items).otherwise(F.array().cast("array<string>"))


def kv_cache_gb(layers: Column, heads: Column, width: Column, length: Column, bytes_each: int = 2) -> Column:
    return 2 * layers.cast("double") * heads * width * length * bytes_each / 1e9


def diffused(x: Column, noise: Column, alpha_bar: Column) -> Column:
    """sqrt(a) * x + sqrt(1 - a) * noise, element by element."""
    return F.zip_with(x, noise, lambda u, e: F.sqrt(alpha_bar) * u + F.sqrt(1 - alpha_bar) * e)


def long_enough(text: Column, least: int = 80) -> Column:
    """The text; the query fails on one that is shorter than `least`."""
    return F.when(F.length(text) >= least, text).otherwise(F.raise_error(F.lit(f"a text has fewer than {least} characters")))


#: Words that mark what happened to the agent rather than what it did.
ENVIRONMENT = ["500", "connection", "network", "refused", "provider", "http"]


def from_environment(text: Column) -> Column:
    """Whether a text holds a marker of its environment; null texts hold none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, ENVIRONMENT)), lambda m: F.contains(low, m))
