"""Relational building blocks: optional filters, paging, lookups, roster and band joins, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def filtered(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """The rows that meet every predicate that is not None."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def any_like(columns: list[Column], text: str | None) -> Column | None:
    """Whether one of the columns holds the text, whatever its case; % and _ in the text stay wildcards."""
    return reduce(lambda a, b: a | b, [c.ilike(f"%{text}%") for c in columns]) if text else None


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, int]:
    """One page of the ordered rows, and the number of all. Sizes are clamped to 1..100, page numbers start at 1."""
    size = max(1, min(100, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size), df.count()


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_terms(df: DataFrame, keys: list[str], words: str, n: int, most: int = 10_000) -> DataFrame:
    """keys, term, n and rank of each key's n most frequent words and pairs of neighbours in arrays of words; of equally
    frequent ones the first by name.

    A pair occurs no more often than either of its words, so pairs with a word less frequent than the key's n-th word are
    behind n words and are not counted. The words that remain, n a key and ties, are broadcast up to `most`.
    """
    single = df.select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc())
    often = stored(single.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= n).drop("_r"), "terms")
    few = often.limit(most + 1).count() <= most
    pairs = df.select(*keys, F.explode(F.arrays_zip(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))).alias("_p"))
    pairs = pairs.select(*keys, F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))
    for side in ("a", "b"):
        known = often.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("term").alias("_term"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        pairs = pairs.join(F.broadcast(known) if few else known, [*same, F.col(side) == F.col("_term")], "left_semi")
    double = pairs.groupBy(*keys, F.concat_ws(" ", "a", "b").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(often.unionByName(double), keys, [F.col("n").desc(), F.col("term")], n)


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Each key's row with the greatest values of `by`; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_default(df: DataFrame, side: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with a table of one row for each key; what it lacks gets the default."""
    joined = df.join(side, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def percent(x: Column) -> Column:
    """A whole percentage, halves to the even neighbour."""
    return F.bround(x).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def health_status(score: Column) -> Column:
    return F.when(score >= 70, "Good").when(score >= 45, "Fair").otherwise("At Risk")


def risk_status(completion: Column) -> Column:
    return F.when(completion >= 70, "Low").when(completion >= 45, "Medium").when(completion > 0, "High").otherwise("Not Started")


def roster(users: DataFrame, classes: DataFrame) -> DataFrame:
    """(user_id, class_id) of every user in a class: by the class's own id, or by grade and section where the
    curriculum agrees or one of the two has none.

    users: user_id, and teaching, an array of structs (class_id, grade, sections, curriculum); classes: class_id,
    grade, section, curriculum. The disjunction becomes two equi joins, so no pair of other rows is ever formed.
    """
    taught = users.select("user_id", F.explode("teaching").alias("x"))
    by_id = taught.select("user_id", F.col("x.class_id").alias("class_id")).join(classes.select("class_id"), "class_id").select("user_id", "class_id")
    pairs = taught.select("user_id", F.col("x.grade").alias("grade"), F.col("x.curriculum").alias("own"), F.explode("x.sections").alias("section"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    by_section = pairs.join(classes, ["grade", "section"]).where(blank(F.col("own")) | blank(F.col("curriculum")) | (F.col("own") == F.col("curriculum")))
    return by_id.union(by_section.select("user_id", "class_id")).distinct()


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, width: int) -> DataFrame:
    """Inner join on keys and |a - b| <= width: the right side goes to three buckets, so the join is an equi join."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width + 1))
    x = left.withColumn("_band", bucket(a))
    y = right.withColumn("_band", F.explode(F.array(bucket(b) - 1, bucket(b), bucket(b) + 1)))
    return x.join(y, [*keys, "_band"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_band")


def hamming_candidates(values: DataFrame, bits: str, most: int) -> DataFrame:
    """(va, vb), va < vb, of the distinct values that agree in two of most + 2 slices of their bits, each pair once.

    A pair that differs in `most` bits at most touches so many slices at most, so two slices or more are equal. Values
    meet by the number and the content of both, some 128 / (most + 2) bits, and a pair is kept by its first two."""
    n = most + 2
    if not 0 <= most <= 30:
        raise ValueError("a distance from 0 to 30 bits")
    ends = [64 * i // n for i in range(n + 1)]
    parts = [F.shiftrightunsigned(F.col("v"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)) for lo, hi in zip(ends, ends[1:])]
    keys = F.array(*[F.struct(F.lit(n * i + j).alias("k"), parts[i].alias("p"), parts[j].alias("q")) for i in range(n) for j in range(i + 1, n)])
    cut = values.select(F.col(bits).alias("v")).where("v IS NOT NULL").distinct().select("v", F.explode(keys).alias("x")).select("v", "x.*")
    both = cut.select("k", "p", "q", F.col("v").alias("va")).join(cut.select("k", "p", "q", F.col("v").alias("vb")), ["k", "p", "q"]).where("va < vb")
    same = F.array(*[F.shiftrightunsigned(F.col("va").bitwiseXOR(F.col("vb")), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)) == 0 for lo, hi in zip(ends, ends[1:])])
    agreeing = F.filter(F.transform(same, lambda e, i: F.when(e, i)), lambda i: i.isNotNull())
    return both.where(F.col("k") == F.transform(F.array(agreeing), lambda g: n * F.get(g, F.lit(0)) + F.get(g, F.lit(1)))[0]).select("va", "vb")


def hamming_pairs(df: DataFrame, key: str, bits: str, most: int = 4) -> DataFrame:
    """(a, b, distance), a < b, of rows whose 64-bit values differ in at most `most` bits. Distinct values are compared
    once, whatever the number of rows that have them; rows with a null key or value are near nothing."""
    rows = df.select(F.col(key).alias("_key"), F.col(bits).alias("v")).where("v IS NOT NULL AND _key IS NOT NULL")
    near = hamming_candidates(df, bits, most).withColumn("distance", F.bit_count(F.col("va").bitwiseXOR(F.col("vb"))).cast("int")).where(F.col("distance") <= most)
    a, b = rows.select(F.col("_key").alias("x"), F.col("v").alias("va")), rows.select(F.col("_key").alias("y"), F.col("v").alias("vb"))
    apart = near.join(a, "va").join(b, "vb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    copies = a.join(b, F.col("va") == F.col("vb")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("distance"))
    return apart.unionByName(copies)


def as_of(asked: DataFrame, entries: DataFrame, key: str, at: str, valid_from: str, width_s: int = 86_400) -> DataFrame:
    """The rows of asked with `_entry`, a struct of the key's last entry at or before `at` (null if there is none).

    Of entries at one time the greatest in its other columns, in their order, is the last. Both tables become one, sorted
    by time, and the last entry is carried forward: no pair of rows is formed, a key's rows pass once. Stretches of time
    of width_s seconds are sorted apart, so the rows of one key are dealt to many tasks; the entry that a stretch starts
    with comes from a table of one row for each key and stretch. Null keys and times have no entry.
    """
    rest = [c for c in entries.columns if c not in (key, valid_from)]
    entry = F.struct(F.col(valid_from).alias(valid_from), *[F.col(c).alias(c) for c in rest])
    asks = asked.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in asked.columns]).alias("_row"))
    have = entries.select(F.col(key).alias("_key"), F.col(valid_from).alias("_at"), F.lit(0).alias("_kind"), entry.alias("_entry")).where("_key IS NOT NULL AND _at IS NOT NULL")
    stretch = F.floor(F.unix_seconds(F.col("_at").cast("timestamp")) / width_s)
    both = asks.unionByName(have, allowMissingColumns=True).withColumn("_part", stretch)
    # A row without a key or a time is alone in its group, so many of them do not meet in one task.
    alone = F.when(F.col("_key").isNull() | F.col("_at").isNull(), F.monotonically_increasing_id())
    within = Window.partitionBy("_key", "_part", "_alone").orderBy("_at", "_kind", "_entry").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_alone", alone).withColumn("_last", F.last("_entry", ignorenulls=True).over(within)).where("_kind = 1")
    ends = both.where("_key IS NOT NULL AND _part IS NOT NULL").groupBy("_key", "_part").agg(F.max("_entry").alias("_end"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select("_key", "_part", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    return near.join(start, ["_key", "_part"], "left").select("_row.*", F.coalesce("_last", "_start").alias("_entry"))


def remapped(df: DataFrame, column: str, known: DataFrame, labels: DataFrame) -> DataFrame:
    """The column's value if known has it (id), else the id of the label (label, id), else the value itself."""
    k = known.select(F.col("id").alias("_known")).distinct()
    m = labels.groupBy(F.col("label").alias("_label")).agg(F.min("id").alias("_mapped"))
    joined = df.join(k, df[column] == F.col("_known"), "left").join(m, df[column] == F.col("_label"), "left")
    return joined.withColumn(column, F.coalesce("_known", "_mapped", df[column])).drop("_known", "_label", "_mapped")


def first_wins(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of the sources with one row for each key, taken from the earliest source that has it."""
    rest = [c for c in sources[0].columns if c not in keys]
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    picked = both.groupBy(*keys).agg(F.min(F.struct("_source", *rest)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_row._source").alias("source"))


def renormalised(weights: dict[str, float]) -> Column:
    """Weighted mean of the columns that are not null, the weights scaled to add up to one."""
    total = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()])
    value = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * F.lit(w), F.lit(0.0)) for c, w in weights.items()])
    return F.try_divide(value, total)
