"""Headings, numbers, tables, figures, boxes, dates and small classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dialogue import as_word

#: The numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(text: Column) -> Column:
    """The number of a Roman numeral, null for anything else: a smaller numeral before a larger one is taken off."""
    value = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in ROMAN.items()])
    values = F.transform(F.split(F.upper(text), ""), value)
    pairs = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(F.upper(text).rlike("^[IVXLCDM]+$"), F.aggregate(pairs, F.lit(0), lambda s, v: s + v))


def first_number(text: Column, fallback: Column) -> Column:
    """A natural sort key: the first whole number in the text, else the fallback."""
    return F.coalesce(F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).cast("long"), fallback.cast("long"))


def heading(line: Column) -> Column:
    """'numbered', 'chapter' or 'caps' for a heading line, else null; whole numbers from 20 on are page numbers."""
    numbered = line.rlike(r"^\s*[0-9]{1,2}(\.[0-9]{1,2})*\.?\s+\p{L}") & (F.regexp_extract(line, r"^\s*([0-9]+)", 1).try_cast("int") < 20)
    return F.when(line.rlike(r"(?i)^\s*(chapter|unit|lesson|section)\s+\w+"), "chapter").when(numbered, "numbered").when((F.length(line) <= 80) & line.rlike(r"^\s*\p{Lu}[\p{Lu}\s]{3,}$"), "caps")


def markdown_table(text: Column) -> Column:
    """Struct (rows, cols, ragged, ok) of the pipe rows of a text; the rule line under the header is no row."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\|.*\|$") & ~x.rlike(r"^\|[\s:|-]+\|$"))
    widths = F.transform(lines, lambda x: F.size(F.split(x, r"\|")) - 2)
    return F.struct(F.size(lines).alias("rows"), F.coalesce(F.get(widths, F.lit(0)), F.lit(0)).alias("cols"), (F.size(F.array_distinct(widths)) > 1).alias("ragged"), ((F.size(lines) >= 2) & (F.size(F.array_distinct(widths)) == 1)).alias("ok"))


#: How wide a question asks, in lower case.
WHOLE_CHAPTER = as_word(r"(?:whole|entire|full)\s+(?:chapter|topic|lesson|unit)")
BROAD = as_word(r"everything|overview|summari[sz]e|all about")


def breadth(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.when(q.rlike(WHOLE_CHAPTER), "chapter").when(q.rlike(BROAD), "broad").otherwise("narrow")


def figure_refs(text: Column) -> Column:
    """Distinct figure numbers that a text cites, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\bfig(?:ure)?\.?\s*([0-9]+(?:\.[0-9]+)?)"), 1))


def noise_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits, white space nor common punctuation."""
    return F.coalesce(F.try_divide(F.length(text) - F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s.,;:!?'\"()-]", "")), F.length(text)), F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def covered_percent(covered: Column, total: Column, done: Column) -> Column:
    """100 when done, 0 without topics, else the share of distinct topics covered, 99 at most."""
    share = F.bround(100.0 * F.size(F.array_distinct(covered)) / F.greatest(total, F.lit(1))).cast("int")
    return F.when(done, 100).when(total <= 0, 0).otherwise(F.least(F.lit(99), share))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Intersection of two boxes (x0, y0, x1, y1) over the smaller area; 0 for empty boxes."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    return F.coalesce(F.try_divide(side("x0", "x1") * side("y0", "y1"), F.nullif(F.least(area(a), area(b)), F.lit(0.0))), F.lit(0.0))


def within_budget(df: DataFrame, keys: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """The first rows of each key whose texts fit together into a budget of characters."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(F.length(text)).over(w)).where(F.col("_used") <= budget).drop("_used")


def page_spans(starts: DataFrame, key: str, start: str, total: int) -> DataFrame:
    """start and end of each row: the end is the page before the next start, the last page for the last row."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return starts.withColumn("end_page", F.greatest(F.col(start), F.coalesce(following - 1, F.lit(total - 1))))


def missing_numbers(df: DataFrame, key: str, number: str) -> DataFrame:
    """(key, missing): the whole numbers between a key's smallest and largest that it lacks."""
    g = df.groupBy(key).agg(F.collect_set(number).alias("have"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    return g.select(key, F.array_sort(F.array_except(F.sequence("lo", "hi"), "have")).alias("missing"))


def offset_consensus(keys: DataFrame, margins: DataFrame, contents: DataFrame, key: str, printed: str, physical: str) -> DataFrame:
    """(key, offset, votes, confidence) for every key of keys: by how much physical pages are ahead of printed ones.

    The most frequent offset of the page margins (0 to 49, the smaller on ties) is trusted with four votes and half of
    all; else that of the contents' headings (0 to 40) is taken at 0.88, else the weak margins' at 0.65, else none at 0.5.
    """

    def mode(pairs: DataFrame, most: int, name: str) -> DataFrame:
        d = pairs.withColumn("offset", F.col(physical) - F.col(printed)).where(F.col("offset").between(0, most))
        n = d.groupBy(key, "offset").agg(F.count(F.lit(1)).alias("votes"))
        return n.groupBy(key).agg(F.max(F.struct("votes", (-F.col("offset")).alias("minus"))).alias(name), F.sum("votes").alias(f"{name}_all"))

    g = keys.select(key).distinct().join(mode(margins, 49, "m"), key, "left").join(mode(contents, 40, "t"), key, "left")
    share = F.col("m.votes") / F.col("m_all")
    sure = F.coalesce((F.col("m.votes") >= 4) & (share >= 0.5), F.lit(False))
    pick = lambda f, none: F.when(sure, f("m")).when(F.col("t").isNotNull(), f("t")).when(F.col("m").isNotNull(), f("m")).otherwise(none)
    confidence = F.when(sure, F.least(F.lit(0.98), 0.7 + 0.3 * share)).when(F.col("t").isNotNull(), 0.88).when(F.col("m").isNotNull(), 0.65).otherwise(0.5)
    return g.select(key, pick(lambda x: -F.col(f"{x}.minus"), F.lit(0)).alias("offset"), pick(lambda x: F.col(f"{x}.votes"), F.lit(0)).alias("votes"), confidence.alias("confidence"))


def quiz_fold(answers: DataFrame, keys: list[str], order: list[str], grade: str) -> DataFrame:
    """keys, outcome, attempts, revealed and points of each question: a correct or partial answer ends it, a second
    wrong one reveals it, what is no answer changes nothing."""
    # The first answer ends the question or is wrong, and the second one ends it: later ones, and what is no answer, are not
    # looked at. A key without an answer keeps a row.
    is_answer = F.col(grade) != "NOT_AN_ANSWER"
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce(is_answer, F.lit(False)).desc(), *order))
    two = answers.withColumn("_nth", nth).where("_nth <= 2").groupBy(*keys).agg(*[F.max(F.when((F.col("_nth") == i) & is_answer, F.col(grade))).alias(f"_g{i}") for i in (1, 2)])
    wrong = lambda c: F.coalesce(F.col(c) == "INCORRECT", F.lit(False))
    second = wrong("_g1") & F.col("_g2").isNotNull()
    state = F.struct(
        F.when(second, F.col("_g2")).otherwise(F.col("_g1")).alias("outcome"),
        (wrong("_g1").cast("int") + (second & wrong("_g2")).cast("int")).alias("attempts"),
        (second & wrong("_g2")).alias("revealed"),
    )
    f = two.select(*keys, state.alias("a"))
    points = F.when(F.col("a.outcome") == "CORRECT", 1.0).when((F.col("a.outcome") == "PARTIAL") & ~F.col("a.revealed"), 0.5).otherwise(0.0)
    return f.select(*keys, "a.outcome", "a.attempts", "a.revealed", points.alias("points"))
