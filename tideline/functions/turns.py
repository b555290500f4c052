"""Rules on questions and answers in a conversation, first match first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialogue import as_word, at_start

#: What a question asks for, in the order of the rules, in lower case.
ANSWER_TYPES = {
    "greeting": at_start(r"\s*(?:hi|hello|hey|good (?:morning|evening))"),
    "exam-format": as_word(r"exam|board question|[0-9]+ marks?"),
    "bullet-points": as_word("bullet|points"),
    "stepwise": as_word("solve|calculate|step by step|steps"),
    "simplified": as_word("simple|simply|easy words"),
    "one-word": as_word("one word"),
    "brief": as_word("short|brief|briefly"),
    "paragraph": as_word("in detail|detailed|notes|lesson"),
    "factual": as_word("name the|list the|which|what (?:kind|type|sort)s? of"),
}
#: Words for small numbers.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
COUNT = r"(?:^|[^\p{L}\p{N}_])([0-9]{1,3}|one|two|three|four|five)\s+(?:sentences?|lines?|points?|bullets?)(?:[^\p{L}\p{N}_]|\z)"
COMPLAINT = as_word("you are (?:wrong|repeating|confusing)|stop (?:asking|repeating)|this is (?:boring|confusing)|i didn'?t ask")
ASKS = as_word("explain|teach|tell me|what (?:is|are|was|were)|why|how|who|when|where|can you|give me")


def answer_type(question: Column) -> Column:
    q = F.lower(question)
    out = F.lit("short-answer")
    for name, pattern in reversed(ANSWER_TYPES.items()):
        out = F.when(q.rlike(pattern), name).otherwise(out)
    return out


def requested_count(question: Column) -> Column:
    """How many sentences, lines or points a question asks for, ten at most; null if it does not say."""
    word = F.regexp_extract(F.lower(question), COUNT, 1)
    n = word.try_cast("int")
    for k, v in NUMBER_WORDS.items():
        n = F.when(word == k, v).otherwise(n)
    return F.when(n.isNotNull(), F.least(n, F.lit(10)))


def is_complaint(text: Column) -> Column:
    return F.lower(text).rlike(COMPLAINT)


def is_non_answer(text: Column) -> Column:
    """Nothing, a complaint, or a question of the learner's own."""
    return (F.trim(text) == "") | is_complaint(text) | (F.lower(text).rlike(ASKS) & F.rtrim(text).endswith("?"))


def answer_score(answer: Column, keywords: Column, forbidden: Column) -> Column:
    """Struct (score, expect, bugs) of an answer by its length, the keywords it has and the terms it should not have."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    inside = lambda terms: F.filter(terms, lambda k: F.contains(low, F.lower(k)))
    hits, bad = F.size(inside(keywords)), F.size(inside(forbidden))
    base = F.when(F.length(low) < 40, 2.0).when(F.length(low) > 80, 7.0).otherwise(5.0)
    kept = F.when(hits > 0, F.least(F.lit(10.0), base + 1.5 * hits)).otherwise(F.greatest(F.lit(1.0), base - 3.0))
    score = F.when(bad > 0, F.greatest(F.lit(1.0), kept - 2.5 * bad)).otherwise(kept)
    bugs = F.array_compact(F.array(F.when(F.length(low) < 40, "very short answer"), F.when(hits == 0, "missing expected keywords"), F.when(bad > 0, "forbidden content")))
    return F.struct(score.alias("score"), F.bround(10.0 * hits / F.greatest(F.size(keywords), F.lit(1)), 1).alias("expect"), bugs.alias("bugs"))


def clean_title(raw: Column) -> Column:
    """A contents line without its leading number, dot leaders, page number and doubled spaces."""
    x = F.regexp_replace(raw, r"^\s*(?:(?i:chapter|unit)\s+)?[0-9]+(?:\.[0-9]+)*[.):]?\s+", "")
    x = F.regexp_replace(x, r"(?:^|[\s.])[\s.]*[0-9]{1,4}\s*\z", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))
