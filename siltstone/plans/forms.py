"""Texts of the tables in the forms that rules tell apart: questions, answers with pages, refusals, logs, JSON, transcripts.

The tables' own texts are prose alone. Each row keeps its text in one of the forms, by its keys, in Spark and in SQL alike;
what form it is in is left to the rules to find out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Form: what stands before a text, how much of it is kept (0: all), and what stands after it.
FORMS = [
    ("", 0, ""),
    ("How many parts of this are there: ", 40, "?"),
    ("It happened first, long before ", 60, " and what came after"),
    ("As the report shows, ", 0, " These figures stand in full, with all their notes, on [page 3] of it and the pages after it."),
    ("The document does not mention ", 0, " at all, on any of its pages."),
    ('2024-01-02T10:00:00Z {"level": "info", "n": 17}\n2024-01-02 12:30:00 {"level": "warn"} ', 20, ""),
    ('{"a": 1,\n"b": [2],\n"c": "x"} ', 12, ""),
    ("user: ", 50, "\nassistant: that is so\nuser: thanks"),
    ("assistant: ", 50, " and no more"),
    ("Compare Acme Corp and Bolt Ltd: what did the chairman say about ", 30, ", and how does it describe each?"),
    ("Acme Bolt Corp ", 6, ""),
    ("", 3, ""),
    ("The provider returned HTTP 500 while I read ", 30, ""),
]


def formed(text: Column, key: Column) -> Column:
    k, out = F.pmod(key, F.lit(len(FORMS))), None
    for i, (before, most, after) in enumerate(FORMS):
        made = F.concat(F.lit(before), F.substring(text, 1, most) if most else text, F.lit(after))
        out = F.when(k == i, made) if out is None else out.when(k == i, made)
    return out


def formed_sql(key: str) -> str:
    quote = lambda t: " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in t.split("\n"))
    cases = " ".join(f"WHEN {i} THEN {quote(before)} || {f'substr(text, 1, {most})' if most else 'text'} || {quote(after)}" for i, (before, most, after) in enumerate(FORMS))
    return f"CASE ({key}) % {len(FORMS)} {cases} END"


def turns(conversations: DataFrame) -> DataFrame:
    """Conversations in all forms; some turns are a tool's."""
    role = F.when((F.col("conv_id") + F.col("turn")) % 13 == 0, "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), formed(F.col("text"), F.col("conv_id") * 5 + F.col("turn")).alias("text"))


TURNS = f"(SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'tool' ELSE role END AS role, {formed_sql('conv_id * 5 + turn')} AS text FROM conversations)"


def passages(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select("doc_id", *more, formed(F.col("text"), F.col("doc_id")).alias("text"))


PASSAGES = f"(SELECT doc_id, source, lang, {formed_sql('doc_id')} AS text FROM documents)"
