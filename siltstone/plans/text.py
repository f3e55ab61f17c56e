"""Chunking, extraction, scrubbing and routing over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions.text import all_words, without, words
from siltstone.operators import lexical, ranking, retrieval, routing, textops
from siltstone.plans import forms
from siltstone.session import table

STOP = ["the", "a", "an", "of", "to", "in"]  # fixed values: words that scoring leaves out


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def char_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(textops.char_chunks(F.col("text"))).alias("ix", "chunk"))
    return d.select("doc_id", "ix", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def word_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(textops.word_chunks(words(), 128, 32)).alias("ix", "chunk"))
    return d.select("doc_id", "ix", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def chunk_payloads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(textops.char_chunks(F.col("text"), 1000, 100)).alias("ix", "chunk"))
    return d.select(F.concat_ws("_", "doc_id", "ix").alias("chunk_id"), "lang", "source", F.length("chunk").alias("n"))


def sentence_chunks(spark, sf_dir):
    c = textops.chunk_with(_docs(spark, sf_dir), "doc_id", "text", textops.pack_sentences)
    return c.select("doc_id", "chunk_ix", F.length("chunk").alias("n"))


def line_packer(spark, sf_dir):
    c = textops.chunk_with(_docs(spark, sf_dir), "doc_id", "text", textops.pack_lines)
    return c.select("doc_id", "chunk_ix", F.length("chunk").alias("n"))


def long_docs(spark, sf_dir):
    """Eight passages of a source in order of id make one long document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d, _ = ranking.positions(d, ["source"], ["doc_id"])
    d = d.withColumn("part", F.floor(F.col("place") / 8))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n\n")
    return d.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.md5(joined).alias("digest"))


def tokenize_stats(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(words()).alias("n_words"), F.size(F.array_distinct(words())).alias("n_distinct"), F.floor(F.length("text") / 4).alias("est_tokens"))


def keyword_variant(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(without(all_words(), routing.KEYWORD_STOP), " ").alias("variant"))


def or_query(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    kept = F.array_distinct(F.filter(without(words(), routing.STOP_WORDS), lambda w: F.length(w) > 1))
    return b.select("item_id", F.when(F.size(kept) > 0, F.array_join(kept, " OR ")).otherwise(F.col("text")).alias("query"))


def entity_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(textops.entities(F.col("text")), "|").alias("entities"))


def inverted_index(spark, sf_dir):
    e = _docs(spark, sf_dir).select("doc_id", F.explode(textops.entities(F.col("text"))).alias("entity"))
    return e.groupBy("entity").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def entity_lookup(spark, sf_dir):
    """For each item, documents by number of the item's entities that they hold exactly."""
    e = _docs(spark, sf_dir).select("doc_id", F.explode(textops.entities(F.col("text"))).alias("entity"))
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(textops.entities(F.col("text"))).alias("entity"))
    n = q.join(e, "entity").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return retrieval.top_k(n, ["item_id"], [F.desc("n"), F.col("doc_id")], 10)


def pii_scrub(spark, sf_dir):
    t = textops.scrub(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(t).alias("digest"), F.regexp_count(t, F.lit("<(API_KEY|TOKEN|EMAIL|USER|HEX)>")).alias("n"))


def html_to_markdown(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return textops.html_to_markdown(p, "html").select("page_id", "markdown")


def session_scroll(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.col("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(turns, lambda t: t["line"]), "\n")).alias("digest"), F.count(F.lit(1)).alias("n_turns"))


def transcript_parse(spark, sf_dir):
    """Lines of turns longer than 15 characters, numbered."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("ix", "line"))
    return c.where(F.length(F.trim("line")) > 15).select("conv_id", "turn", "role", "ix", F.md5(F.trim("line")).alias("digest"))


def json_lenient_parse(spark, sf_dir):
    """The number under a key of each event's properties; some are cut off, some have another key, some hold a word."""
    p, n = F.col("props"), F.col("event_id") % 5
    raw = F.when(n == 1, F.expr("substring(props, 1, 3)")).when(n == 2, F.replace(p, F.lit('"k"'), F.lit('"q"'))).when(n == 3, F.replace(p, F.lit('": '), F.lit('": "x'))).otherwise(p)
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object(raw, "$.k").try_cast("long").alias("k"))
    return e.select("event_id", F.coalesce("k", F.lit(-1)).alias("k"), F.col("k").isNotNull().alias("ok"))


def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("sha"), F.octet_length("text").alias("size"), F.regexp_count("text", F.lit("\n")).alias("lines"))


def privacy_route(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", routing.privacy(F.col("text")).alias("r")).select("doc_id", "r.level", "r.action", "r.matched")


def query_type(spark, sf_dir):
    return forms.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", routing.query_type(F.col("text")).alias("kind"))


def query_complexity(spark, sf_dir):
    s = routing.complexity(F.col("text"))
    return forms.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", s.alias("score"), (s >= 0.5).alias("is_complex"))


def low_quality(spark, sf_dir):
    return forms.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", routing.low_quality(F.col("text")).alias("low"))


def quality_score(spark, sf_dir):
    """Turns against the items of `benchmark` as what is stored: similarity is the cosine of term counts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = lexical.with_best_cosine(c, table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", words(), words(), "best")
    return out.select("conv_id", "turn", "role", routing.quality(F.col("text"), F.col("best")).alias("score"))


def workload_shape(spark, sf_dir):
    return forms.passages(table(spark, sf_dir, "documents")).select("doc_id", routing.workload(F.col("text")).alias("r")).select("doc_id", "r.shape", "r.confidence")


def layered_route(spark, sf_dir):
    c = forms.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", routing.layered(F.col("text"), F.col("role")).alias("r"))
    return c.select("conv_id", "turn", "role", "r.shape", "r.timing", "r.store", "r.confidence")


def paragraph_packer(spark, sf_dir):
    c = textops.chunk_with(_docs(spark, sf_dir), "doc_id", "text", textops.pack_paragraphs)
    return c.select("doc_id", "chunk_ix", F.length("chunk").alias("n"))


def best_overlap(spark, sf_dir):
    """Shared words of each item with the best document for it by word overlap."""
    d = _docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(words())).alias("w"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(without(words(), STOP))).alias("w"))
    size = b.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    both = b.join(d, "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    best = retrieval.top_k(both, ["item_id"], [F.desc("shared"), F.col("doc_id")], 1)
    out = size.join(best, "item_id", "left")
    cover, faith = F.coalesce(F.col("shared"), F.lit(0)) / F.col("n"), (F.coalesce(F.col("shared"), F.lit(0)) >= 3).cast("double")
    return out.select("item_id", "doc_id", F.round(cover, 3).alias("coverage"), faith.alias("faithful"), F.round((cover + faith) / 2, 3).alias("confidence"))


QUERIES = {f.__name__: f for f in (char_chunks, word_chunks, chunk_payloads, sentence_chunks, line_packer, long_docs, tokenize_stats, keyword_variant, or_query, entity_extract, inverted_index, entity_lookup, pii_scrub, html_to_markdown, session_scroll, transcript_parse, json_lenient_parse, content_hash, privacy_route, query_type, query_complexity, low_quality, quality_score, workload_shape, layered_route, paragraph_packer, best_overlap)}

_STOP = ", ".join(f"'{w}'" for w in STOP)
_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_ALL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _distinct(source: str, key: str, keep: str = "TRUE") -> str:
    """Distinct words in order of first occurrence."""
    return f"SELECT {key}, list(w ORDER BY i) AS l FROM (SELECT {key}, w, MIN(i) AS i FROM (SELECT {key}, unnest({_W}) AS w, generate_subscripts({_W}, 1) AS i FROM {source}) WHERE {keep} GROUP BY 1, 2) GROUP BY 1"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# letters with accents are part of a word in one engine only, so they become a sign that is part of a word in both
_PLAIN = "regexp_replace(text, '[À-ÖØ-öø-ÿ]', '_', 'g')"
_ENTITIES = (
    "list_sort(list_distinct([e FOR e IN [trim(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN flatten(["
    + ", ".join("regexp_extract_all(" + _PLAIN + ", '" + p.replace("'", "''") + "', 1)" for p in textops.ENTITIES)
    + f"])] IF e NOT IN ({_quoted(textops.STOP_ENTITIES)})]))"
)
_SCRUBBED = "text"
for _p, _put in textops.SCRUB:
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '" + _p.replace("'", "''") + f"', '{_put}', 'g')"


def _chars(size: int, overlap: int, columns: str) -> str:
    step = size - overlap
    return f"""SELECT {columns}, CAST(i AS INT) AS ix, substr(t, CAST(i * {step} + 1 AS BIGINT), {size}) AS chunk
        FROM (SELECT *, trim(text, ' ') AS t FROM documents), LATERAL (SELECT unnest(range(0, CAST(GREATEST(1, CEIL((length(t) - {overlap}) / {step})) AS BIGINT))) AS i) WHERE length(t) > 0"""


_CONTAINS = lambda text, phrases: "(" + " OR ".join(f"contains({text}, {_quoted([p])})" for p in phrases) + ")"
_COMPLEX = f"ROUND(CAST(LEAST(len(regexp_extract_all({_PLAIN}, '\\b[A-Z][a-zA-Z]+\\b')), 4) * 0.15 + LEAST(" + " + ".join(f"CAST(contains(lower(text), '{c}') AS INT)" for c in routing.COMPLEX_CUES) + ", 3) * 0.25 + CAST(contains(lower(text), ' and ') OR contains(text, ',') AS INT) * 0.2 AS DOUBLE), 3)"
_RAW = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_PARTS = f"regexp_split_to_array({_RAW}, '\\s+')"
_FN = _quoted(routing.FUNCTION_WORDS)
_LINES = "string_split(text, chr(10))"
_N = "GREATEST(len(text) - len(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END, 1)"


def _privacy() -> str:
    cases = ""
    for level, action, keywords, patterns in routing.PRIVACY:
        for k in keywords:
            cases += f" WHEN contains(lower(text), {_quoted([k.lower()])}) THEN " + _quoted([f"{level}|{action}|keyword:{k}"])
        for p in patterns:
            cases += f" WHEN regexp_matches({_PLAIN}, {_quoted([p])}) THEN " + _quoted([f"{level}|{action}|pattern:{p[:24]}"])
    return f"SELECT doc_id, CASE{cases} ELSE 'S1|passthrough|' END AS r FROM documents"


_SHAPE = f"""SELECT *, len(list_distinct([lower(x) FOR x IN regexp_extract_all(text, {_quoted([routing.TURN])}, 1)])) AS speakers,
    len(regexp_extract_all(text, {_quoted([routing.JSON_KEY])})) / {_N} AS keys, len(regexp_extract_all({_PLAIN}, {_quoted([routing.STAMP])})) / {_N} AS stamps, len(replace(text, chr(10), '')) / {_N} AS mean"""
_SHAPED = """CASE WHEN length(text) < 8 THEN 'unknown|0.0' WHEN speakers >= 2 THEN 'conversation|0.9' WHEN speakers = 1 THEN 'conversation|0.8' WHEN keys >= 0.5 AND stamps >= 0.5 AND mean < 200 THEN 'log_stream|0.9'
    WHEN keys >= 0.7 AND stamps < 0.2 THEN 'structured|0.85' ELSE 'unknown|0.4' END"""


ORACLES = {
    "char_chunks": f"SELECT doc_id, ix, length(chunk) AS n, md5(chunk) AS digest FROM ({_chars(512, 64, 'doc_id')})",
    "word_chunks": f"""SELECT doc_id, CAST(i AS INT) AS ix, length(c) AS n, md5(c) AS digest FROM (
        SELECT doc_id, i, array_to_string(list_slice(l, i * 96 + 1, i * 96 + 128), ' ') AS c
        FROM (SELECT doc_id, {_W} AS l FROM documents), LATERAL (SELECT unnest(range(0, CAST(CEIL(len(l) / 96) AS BIGINT))) AS i))""",
    "chunk_payloads": f"SELECT doc_id || '_' || ix AS chunk_id, lang, source, length(chunk) AS n FROM ({_chars(1000, 100, 'doc_id, lang, source')})",
    "long_docs": """SELECT source, part, COUNT(*) AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS part FROM documents) GROUP BY 1, 2""",
    "tokenize_stats": f"SELECT doc_id, len({_W}) AS n_words, len(list_distinct({_W})) AS n_distinct, length(text) // 4 AS est_tokens FROM documents",
    "keyword_variant": f"SELECT item_id, array_to_string([x FOR x IN {_ALL} IF x NOT IN ({_quoted(routing.KEYWORD_STOP)})], ' ') AS variant FROM benchmark",
    "or_query": f"""SELECT b.item_id, COALESCE(array_to_string(l, ' OR '), text) AS query FROM benchmark b LEFT JOIN ({_distinct('benchmark', 'item_id', f'length(w) > 1 AND w NOT IN ({_quoted(routing.STOP_WORDS)})')}) d ON b.item_id = d.item_id""",
    "entity_extract": f"SELECT doc_id, array_to_string({_ENTITIES}, '|') AS entities FROM documents",
    "inverted_index": f"SELECT entity, COUNT(*) AS n_docs, MIN(doc_id) AS first_doc, MAX(doc_id) AS last_doc FROM (SELECT doc_id, unnest({_ENTITIES}) AS entity FROM documents) GROUP BY 1",
    "entity_lookup": f"""WITH e AS (SELECT doc_id, unnest({_ENTITIES}) AS entity FROM documents), q AS (SELECT item_id, unnest({_ENTITIES}) AS entity FROM benchmark),
        n AS (SELECT item_id, doc_id, COUNT(*) AS n FROM q JOIN e USING (entity) GROUP BY 1, 2)
        SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM n) WHERE rank <= 10""",
    "pii_scrub": f"SELECT doc_id, md5(t) AS digest, len(regexp_extract_all(t, '<(API_KEY|TOKEN|EMAIL|USER|HEX)>')) AS n FROM (SELECT doc_id, {_SCRUBBED} AS t FROM documents)",
    "session_scroll": "SELECT conv_id, md5(string_agg('[' || upper(role) || '] ' || text, chr(10) ORDER BY turn, '[' || upper(role) || '] ' || text)) AS digest, COUNT(*) AS n_turns FROM conversations GROUP BY 1",
    "transcript_parse": f"""SELECT conv_id, turn, role, ix - 1 AS ix, md5(trim(line, ' ')) AS digest FROM
        (SELECT conv_id, turn, role, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS ix FROM conversations) WHERE length(trim(line, ' ')) > 15""",
    "json_lenient_parse": """SELECT event_id, COALESCE(k, -1) AS k, k IS NOT NULL AS ok FROM
        (SELECT event_id, CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract_string(raw, '$.k') AS BIGINT) END AS k FROM
        (SELECT event_id, CASE event_id % 5 WHEN 1 THEN substr(props, 1, 3) WHEN 2 THEN replace(props, '"k"', '"q"') WHEN 3 THEN replace(props, '": ', '": "x') ELSE props END AS raw FROM events))""",
    "content_hash": "SELECT doc_id, substr(sha256(text), 1, 16) AS sha, strlen(text) AS size, len(regexp_extract_all(text, chr(10))) AS lines FROM documents",
    "privacy_route": f"SELECT doc_id, split_part(r, '|', 1) AS level, split_part(r, '|', 2) AS action, substr(r, length(split_part(r, '|', 1)) + length(split_part(r, '|', 2)) + 3) AS matched FROM ({_privacy()})",
    "query_type": f"""SELECT conv_id, turn, CASE WHEN raw LIKE '%?' THEN 'mixed'
        WHEN (lower(p[1]) IN ({_FN}) AND regexp_matches(p[1], '^[a-z]')) OR len([x FOR x IN p IF lower(x) IN ({_FN})]) / len(p) >= 0.4 THEN 'vec'
        WHEN regexp_matches(raw, {_quoted([routing.DISTINCTIVE])}) OR regexp_matches(raw, '^[A-Z]') THEN 'kw' ELSE 'vec' END AS kind FROM (SELECT *, {_RAW} AS raw, {_PARTS} AS p FROM {forms.TURNS})""",
    "layered_route": f"""SELECT conv_id, turn, role, split_part(r, '|', 1) AS shape, split_part(r, '|', 2) AS timing, split_part(r, '|', 3) AS store, CAST(split_part(r, '|', 4) AS DOUBLE) AS confidence FROM (
        SELECT *, CASE WHEN lower(role) IN ('user', 'system') THEN 'structured|write_time|guild|0.95' WHEN lower(role) = 'tool' THEN 'log_stream|write_time|typed_schema|0.95' WHEN s = 'conversation|0.9' THEN 'conversation|read_time|qdrant|0.9'
            WHEN s = 'log_stream|0.9' THEN 'log_stream|write_time|typed_schema|0.9' WHEN s = 'structured|0.85' THEN 'structured|write_time|guild|0.85' ELSE 'unknown|read_time|qdrant|0.5' END AS r
        FROM (SELECT *, {_SHAPED} AS s FROM ({_SHAPE} FROM {forms.TURNS})))""",
    "query_complexity": f"SELECT conv_id, turn, {_COMPLEX} AS score, {_COMPLEX} >= 0.5 AS is_complex FROM {forms.TURNS}",
    "low_quality": f"SELECT conv_id, turn, {_CONTAINS('lower(raw)', ['insufficient context', *routing.REFUSALS])} OR length(raw) < 80 OR NOT {_CONTAINS('lower(raw)', ['[page', 'pages'])} AS low FROM (SELECT *, {_RAW} AS raw FROM {forms.TURNS})",
    "quality_score": f"""WITH c AS (SELECT row_number() OVER () AS r, * FROM conversations), w AS (SELECT r, w, COUNT(*) AS n FROM (SELECT r, unnest({_W}) AS w FROM c) GROUP BY 1, 2),
        b AS (SELECT item_id, w, COUNT(*) AS m FROM (SELECT item_id, unnest({_W}) AS w FROM benchmark) GROUP BY 1, 2),
        p AS (SELECT r, item_id, SUM(n * m) AS dot FROM w JOIN b USING (w) GROUP BY 1, 2), wn AS (SELECT r, sqrt(SUM(n * n)) AS z FROM w GROUP BY 1), bn AS (SELECT item_id, sqrt(SUM(m * m)) AS z FROM b GROUP BY 1),
        s AS (SELECT p.r, MAX(dot / bn.z / wn.z) AS best FROM p JOIN wn ON p.r = wn.r JOIN bn ON p.item_id = bn.item_id GROUP BY 1), x AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n FROM c)
        SELECT conv_id, turn, role, ROUND(0.3 * CASE WHEN n < 5 THEN 0.0 WHEN n > 40 THEN 0.2 ELSE GREATEST(0.0, 1.0 - ABS(n - 15) / 15.0) END
               + 0.4 * LEAST(1.0, len(regexp_extract_all({_PLAIN}, {_quoted([routing.SPECIFIC])})) / 3.0) + 0.3 * COALESCE(1 - best, 1.0), 6) AS score FROM x LEFT JOIN s ON x.r = s.r""",
    "workload_shape": f"SELECT doc_id, split_part(r, '|', 1) AS shape, CAST(split_part(r, '|', 2) AS DOUBLE) AS confidence FROM (SELECT doc_id, {_SHAPED} AS r FROM ({_SHAPE} FROM {forms.PASSAGES}))",
    "best_overlap": f"""WITH d AS (SELECT doc_id, unnest(list_distinct({_W})) AS w FROM documents), b AS (SELECT item_id, w FROM (SELECT item_id, unnest(list_distinct({_W})) AS w FROM benchmark) WHERE w NOT IN ({_STOP})),
        z AS (SELECT item_id, COUNT(*) AS n FROM b GROUP BY 1), x AS (SELECT item_id, doc_id, COUNT(*) AS shared FROM b JOIN d USING (w) GROUP BY 1, 2),
        t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS r FROM x) WHERE r = 1)
        SELECT z.item_id, doc_id, ROUND(COALESCE(shared, 0) / n, 3) AS coverage, CAST(COALESCE(shared, 0) >= 3 AS DOUBLE) AS faithful,
               ROUND((COALESCE(shared, 0) / n + CAST(COALESCE(shared, 0) >= 3 AS DOUBLE)) / 2, 3) AS confidence FROM z LEFT JOIN t ON z.item_id = t.item_id""",
}
