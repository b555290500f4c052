"""Operators on texts that built-in expressions do not cover: splitting, echoes, turn pairs, quizzes."""

from __future__ import annotations

import difflib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where texts are cut, coarsest first.
SEPARATORS = ["\n\n", "\nCHAPTER ", "\nChapter ", "\n", ". ", " ", ""]


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most `size` characters cut at the coarsest separator that does, each with the end of the piece
    before it repeated up to `overlap` characters."""
    spans = _cut(text, size, 0)
    out, held = [], ""
    for part in spans:
        if held and len(held) + len(part) > size:
            out.append(held.strip())
            tail = held[-overlap:] if overlap else ""
            held = tail if len(tail) + len(part) <= size else ""
        held += part
    if held.strip():
        out.append(held.strip())
    return [x for x in out if x]


def _cut(text: str, size: int, level: int) -> list[str]:
    if len(text) <= size:
        return [text] if text else []
    sep = SEPARATORS[level]
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    cut, at = [], 0
    for m in re.finditer(re.escape(sep), text):
        keep = m.end() if not sep.strip() or sep == ". " else m.start() + 1
        cut.append(text[at:keep])
        at = keep
    cut.append(text[at:])
    return [p for x in cut for p in _cut(x, size, level + 1)]


def chunks(docs: DataFrame, tokens: int, overlap: int) -> DataFrame:
    """(doc_id, ordinal, text, n_chars) of each document's pieces; a token counts four characters."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: split_text(t, 4 * tokens, 4 * overlap))

    return docs.select("doc_id", F.posexplode(cut("text")).alias("ordinal", "text")).withColumn("n_chars", F.length("text"))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the assistant turn that follows; a later user turn
    replaces one without an answer, a last one has an empty answer."""
    c = turns.where(F.col("role").isin("user", "assistant")).withColumn("text", F.trim("text")).where("text <> ''")
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = c.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    asked = n.where((F.col("role") == "user") & (F.col("next_role").isNull() | (F.col("next_role") == "assistant")))
    return asked.select("conv_id", "turn", F.col("text").alias("question"), F.coalesce("next_text", F.lit("")).alias("answer"))


#: Words that a comparison of speech leaves out.
FILLERS = "um|uh|uhh|umm|like|you know|i mean|so|well|actually|basically|right|okay|ok|yeah|yes|hmm|ah|oh"


def spoken(text: Column) -> Column:
    """A text as it is compared: lower case, two contractions written out, without marks and fillers, single spaces."""
    out = F.lower(F.coalesce(text, F.lit("")))
    alone = lambda words: rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"
    for pattern, by in ((alone("you'?re"), "you are"), (alone("i'm"), "i am"), (r"[^\p{L}\p{N}_\s]", " "), (alone(FILLERS), " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _begins(u: Column, assistant: Column) -> Column:
    sentences = F.split(F.coalesce(assistant, F.lit("")), "[.!?]+")
    same = lambda x: F.exists(sentences, lambda raw: _let(spoken(raw), lambda s: (s == x) | F.startswith(s, F.concat(x, F.lit(" ")))))
    return F.when(F.size(F.split(u, " ")).between(2, 6), same(u)).otherwise(F.lit(False))


def starts_a_sentence(user: Column, assistant: Column) -> Column:
    """Whether the user's two to six words are the beginning of one of the assistant's sentences."""
    return _let(spoken(user), lambda u: _begins(u, assistant))


def echo(user: Column, assistant: Column) -> Column:
    """0 to 1: 1 where the user's text begins one of the assistant's sentences, stands in its text or holds its first 120
    characters, else the share of shared words and word pairs; 0 for three longer words or fewer. A window of the assistant's text that holds a
    long user's text counts 0.98 only where the whole text does not hold it, which cannot be, so that step is not there."""
    long_words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 2)
    pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x))

    def overlap(uw: Column, aw: Column, stems: Column) -> Column:
        shared = F.size(F.filter(uw, lambda w: F.array_contains(aw, w) | ((F.length(w) >= 6) & F.array_contains(stems, F.substring(w, 1, 6)))))
        recall = F.try_divide(shared, F.size(uw))
        union = F.try_divide(F.size(F.array_intersect(uw, aw)), F.size(F.array_union(uw, aw)))
        both = _let(pairs(uw), lambda p: F.coalesce(F.try_divide(F.size(F.array_intersect(p, pairs(aw))), F.size(F.array_distinct(p))), F.lit(0.0)))
        return _let(recall, lambda r: F.greatest(r, 0.55 * r + 0.25 * union + 0.20 * both))

    def scored(u: Column, a: Column, uw: Column, begins: Column) -> Column:
        probe = F.substring(a, 1, 120)
        held = (F.contains(a, u) & ((F.size(uw) >= 4) | (F.length(u) >= 28))) | ((F.length(probe) >= 24) & F.contains(u, probe))
        stems = lambda aw: F.transform(F.filter(aw, lambda w: F.length(w) >= 6), lambda w: F.substring(w, 1, 6))
        score = _let(long_words(a), lambda aw: _let(stems(aw), lambda s: overlap(uw, aw, s)))
        return F.when((F.length(u) < 3) | (a == ""), 0.0).when(begins, 1.0).when(held, 1.0).when(F.size(uw) <= 3, 0.0).otherwise(score)

    # Each text is prepared once and bound to a name; a lambda would prepare it again for every word.
    return _let(spoken(user), lambda u: _let(spoken(assistant), lambda a: _let(long_words(u), lambda uw: scored(u, a, uw, _begins(u, assistant)))))


def without_synonyms(top: DataFrame, n: int, most: float = 0.85) -> DataFrame:
    """Of ranked terms (lang, term, n, rank), the first n whose spelling is not too like one kept before; few a group."""

    def keep(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values("rank")
        kept: list[int] = []
        for i, term in zip(frame.index, frame.term, strict=True):
            if len(kept) < n and all(difflib.SequenceMatcher(None, term, frame.term[j]).ratio() <= most for j in kept):
                kept.append(i)
        return pa.Table.from_pandas(frame.loc[kept], schema=table.schema, preserve_index=False)

    return top.groupBy("lang").applyInArrow(keep, top.schema)


_QUESTION = re.compile(r"^\s*(?:Q(?:uestion)?\s*)?(\d+)[.)]\s*(.+)$", re.I)
_OPTION = re.compile(r"^\s*([A-D])[.)-]\s*(.+)$")
_ANSWER = re.compile(r"^\s*Answer\s*:\s*([A-D])\b", re.I)
_KEY = re.compile(r"^\s*(\d+)[.)]\s*([A-D])\s*$", re.I)


def parse_quiz(text: str) -> list[tuple[int, str, list[str], str | None]]:
    """(number, question, options, answer) of each numbered question with two options or more; a key at the end goes
    before an answer at the question."""
    found: dict[int, list] = {}
    key: dict[int, str] = {}
    now, in_key = None, False
    for line in text.splitlines():
        if re.match(r"^\s*#+\s*answer", line, re.I):
            in_key = True
        elif in_key and (m := _KEY.match(line)):
            key[int(m[1])] = m[2].upper()
        elif not in_key and (m := _OPTION.match(line)) and now is not None:
            found[now][1].append(m[2].strip())
        elif (m := _ANSWER.match(line)) and now is not None:
            found[now][2] = m[1].upper()
        elif not in_key and (m := _QUESTION.match(line)):
            now = int(m[1])
            found[now] = [m[2].strip(), [], None]
    return [(n, q, options, key.get(n, answer)) for n, (q, options, answer) in found.items() if len(options) >= 2]


def quiz_items(rows: DataFrame) -> DataFrame:
    """(id, number, question, options, answer) of every question in the texts of rows (id, text)."""
    kind = "array<struct<number:int,question:string,options:array<string>,answer:string>>"

    @F.pandas_udf(kind)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: [{"number": n, "question": q, "options": o, "answer": a} for n, q, o, a in parse_quiz(t)])

    return rows.select("id", F.explode(parse("text")).alias("x")).select("id", "x.*")


def longest_increasing(values: Column) -> Column:
    """One longest strictly increasing subsequence of an array of whole numbers."""

    @F.pandas_udf("array<int>")
    def run(lists: pd.Series) -> pd.Series:
        import bisect

        def one(xs):
            ends, at, before = [], [], []
            for i, x in enumerate(xs):
                k = bisect.bisect_left(ends, x)
                before.append(at[k - 1] if k else None)
                ends[k : k + 1], at[k : k + 1] = [x], [i]
            out, i = [], at[-1] if at else None
            while i is not None:
                out.append(int(xs[i]))
                i = before[i]
            return out[::-1]

        return lists.map(one)

    return run(values)
