"""Mixing documents to target weights of domains that are known only softly.

A multinomial classifier of hashed words, fitted on a bounded sample of a labelled table, gives every document its
posterior over the domains; a temperature, chosen on held-out labelled documents, keeps the posteriors honest. Each
document then gets a rate, the expected number of its copies: rates >= 0 such that the expected tokens of each domain,
sum over documents of rate * tokens * posterior, match the targets. They are fitted by projected gradient descent on
the squared mismatch, measured in the metric of the domains' Gram matrix, from rates of 1; a step adds up one number
for each domain and each pair of domains over all documents, so nothing else passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batch, bounded, owners, pieces, stored, word_hashes

BUCKETS = 1 << 16
#: The classifier is fitted on so many labelled documents at most.
SAMPLE = 20_000
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
STEPS, TOLERANCE = 15, 1e-3
#: Target shares of the tokens by domain of the labelled table, and the tokens wanted, as a multiple of those there are.
TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}
BUDGET = 1.0
#: The pipeline mixes what its filters left. Its targets are the shares that domains have there times these factors.
STAGE_FACTORS = {"clean": 1.0, "poor": 0.8, "toxic": 0.6}
#: Tokens after the stage as a multiple of those before it: enough for clean documents to keep a rate of about one.
STAGE_BUDGET = 1.1


class Classifier:
    """log-probabilities of word buckets by domain, priors and a temperature."""

    def __init__(self, names: list[str], prior: np.ndarray, table: np.ndarray, temperature: float = 1.0):
        self.names, self.prior, self.table, self.temperature = names, prior, table, temperature

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of words of each text and the sums of its words' log-probabilities by domain."""
        n, sums = np.zeros(len(column), np.int64), np.zeros((len(column), len(self.names)))
        for a, b, data, offsets in pieces(column):
            w, first = word_hashes(data, offsets)
            n[a:b] = np.diff(first)
            full = np.flatnonzero(n[a:b])
            if len(full):
                bucket = (w % np.uint64(BUCKETS)).astype(np.int64)
                for k in range(len(self.names)):
                    sums[a + full, k] = np.add.reduceat(self.table[k][bucket], first[full], dtype=np.float64)
        return n, sums

    def posterior(self, sums: np.ndarray) -> np.ndarray:
        x = self.prior + sums / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def _bucket_counts(batches):
    schema = pa.schema([("k", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("docs", pa.int64())])
    for rb in bounded(batches):
        k = rb.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in pieces(rb.column(0)):
            w, first = word_hashes(data, offsets)
            code = k[a:b][owners(first)].astype(np.int64) * BUCKETS + (w % np.uint64(BUCKETS)).astype(np.int64)
            keys, n = np.unique(code, return_counts=True)
            yield batch(schema, (keys // BUCKETS).astype(np.int32), (keys % BUCKETS).astype(np.int32), n, np.zeros(len(n), np.int64))
            kinds, n = np.unique(k[a:b], return_counts=True)
            yield batch(schema, kinds.astype(np.int32), np.full(len(kinds), -1, np.int32), np.zeros(len(n), np.int64), n)


def train(docs: DataFrame, labelled: DataFrame, names: list[str], bound: int = SAMPLE) -> Classifier:
    """A classifier of the named domains from labelled (doc_id, domain); other domains and null ids are left out.

    The sample takes the smallest hashes of the ids. Nine tenths are counted, one tenth chooses the temperature. With
    no labelled document the posterior is the same for every document.
    """
    k = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("domain")) - 1
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", k.cast("int").alias("k"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # as many rows as the bound at most
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10))
    rows = sample.where(fold != 0).select("text", "k").mapInArrow(_bucket_counts, "k int, bucket int, n long, docs long")
    counts, n_docs = np.zeros((len(names), BUCKETS)), np.zeros(len(names))
    found = rows.groupBy("k", "bucket").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toPandas()
    word = found.bucket.to_numpy() >= 0
    counts[found.k[word], found.bucket[word]] = found.n[word]
    n_docs[found.k[~word]] = found.docs[~word]
    pooled = (counts.sum(axis=0) + 1) / (counts.sum() + BUCKETS)
    table = np.log((counts + BUCKETS * pooled) / (counts.sum(axis=1, keepdims=True) + BUCKETS))
    model = Classifier(names, np.log((n_docs + 1) / (n_docs.sum() + len(names))), table.astype(np.float32))

    def held_out(batches):
        for rb in bounded(batches):
            _, sums = model.evidence(rb.column(0))
            yield pa.RecordBatch.from_arrays([rb.column(1), pa.array(list(sums), pa.list_(pa.float64()))], names=["k", "sums"])

    rest = sample.where(fold == 0).select("text", "k").mapInArrow(held_out, "k int, sums array<double>").toPandas()
    if len(rest):
        sums, truth = np.stack(rest["sums"]), rest.k.to_numpy()
        best = None
        for t in TEMPERATURES:
            model.temperature = t
            loss = -np.log(np.maximum(model.posterior(sums)[np.arange(len(truth)), truth], 1e-12)).mean()
            if best is None or loss < best[0]:
                best = (loss, t)
        model.temperature = best[1]
    return model


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of docs with _mix_tokens (words and an end) and _mix_posterior; no shuffle."""
    def run(batches):
        for rb in bounded(batches):
            n, sums = model.evidence(rb.column(rb.schema.get_field_index("text")))
            post = pa.array(list(model.posterior(sums)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(n + 1), post], names=[*rb.schema.names, "_mix_tokens", "_mix_posterior"])

    added = [T.StructField("_mix_tokens", T.LongType()), T.StructField("_mix_posterior", T.ArrayType(T.DoubleType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def _dot(numbers: np.ndarray) -> Column:
    """Inner product of the posterior with numbers."""
    parts = [F.get("_mix_posterior", F.lit(k)) * float(x) for k, x in enumerate(numbers)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def rate(steps: list[np.ndarray]) -> Column:
    """A document's rate after the given gradient steps: each is projected on the rates >= 0."""
    r = F.lit(1.0)
    for g in steps:
        r = F.greatest(F.lit(0.0), r - _dot(g))
    return r


def fit_rates(features: DataFrame, model: Classifier, targets: dict[str, float], budget: float = BUDGET) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(gradient steps, expected tokens by domain, target tokens by domain).

    Stops when no domain is further from its target than TOLERANCE of all tokens, or after STEPS steps. Targets need
    not add up to one. A domain that no document can belong to keeps its mismatch.
    """
    names, n = model.names, len(model.names)
    token = F.col("_mix_tokens").cast("double")
    post = [F.get("_mix_posterior", F.lit(k)) for k in range(n)]
    weight = np.array([targets.get(x, 0.0) for x in names])
    steps: list[np.ndarray] = []
    while True:
        # The Gram matrix is that of the documents whose rates can still move both ways.
        moving = F.when(F.col("_mix_rate") > 0, token).otherwise(F.lit(0.0))
        row = features.withColumn("_mix_rate", rate(steps)).agg(
            F.sum(token).alias("all"),
            *[F.sum(token * post[k] * F.col("_mix_rate")).alias(f"s{k}") for k in range(n)],
            *[F.sum(moving * post[i] * post[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)],
        ).first()
        total = row["all"] or 0.0
        want = weight / max(weight.sum(), 1e-300) * budget * total
        have = np.array([row[f"s{k}"] or 0.0 for k in range(n)])
        if len(steps) >= STEPS or np.abs(have - want).max() <= TOLERANCE * max(total, 1.0):
            return steps, have, want
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
        steps.append(np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (have - want))


def scaled_shares(features: DataFrame, model: Classifier, factors: dict[str, float]) -> dict[str, float]:
    """Targets: the expected tokens of each domain as they are, times a factor. Posteriors are soft, so a share far
    below what documents of other domains bring along could only be met by dropping most of these."""
    post = [F.sum(F.col("_mix_tokens") * F.get("_mix_posterior", F.lit(k))).alias(f"s{k}") for k in range(len(model.names))]
    row = features.agg(*post).first()
    return {name: (row[f"s{k}"] or 0.0) * factors.get(name, 1.0) for k, name in enumerate(model.names)}


def copies(rate_column: Column) -> Column:
    """A whole number of copies whose expectation is the rate; the id's hash decides, so it is the same in every run."""
    u = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 53)) / float(1 << 53)
    return F.floor(rate_column + u).cast("long")


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic before clean and poor; rows without labels are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior (array in the order of the names), rate, copies and gap.

    gap is the same on every row: by how much of all tokens the domain that is furthest from its target misses it. It is
    at most TOLERANCE where the targets can be met. Where they cannot, as when no document may belong to a wanted domain,
    the rates are those of the last step, the nearest that the descent found, and gap says how near.

    A row for each row of docs. A null or empty text has one token, its end, and the prior as posterior; equal texts
    get equal posteriors and rates, repeated rows get equal copies. Null ids get copies like an id of their own. Other
    columns are ignored.
    """
    targets = dict(TARGETS if targets is None else targets)
    model = train(docs, labelled, sorted(targets))
    features = stored(with_posteriors(docs.select("doc_id", "text"), model).drop("text"), "mixing")
    steps, have, want = fit_rates(features, model, targets, budget)
    gap = float(np.abs(have - want).max() / max(want.sum(), 1.0))
    out = features.withColumn("rate", rate(steps))
    names = F.array(*[F.lit(x) for x in model.names])
    domain = F.get(names, F.array_position("_mix_posterior", F.array_max("_mix_posterior")).cast("int") - 1)
    return out.select("doc_id", F.col("_mix_tokens").alias("n_tokens"), domain.alias("domain"), F.col("_mix_posterior").alias("posterior"), "rate", copies(F.col("rate")).alias("copies"), F.lit(gap).alias("gap"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), domains_of(labels))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as its number of copies says."""
    labelled = domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = train(docs, labelled, sorted(STAGE_FACTORS))
    features = stored(with_posteriors(docs.select("doc_id", "text"), model).drop("text"), "mixing")
    steps, _, _ = fit_rates(features, model, scaled_shares(features, model, STAGE_FACTORS), STAGE_BUDGET)
    mixed = with_posteriors(docs, model).withColumn("_mix_copies", copies(rate(steps)))
    repeated = mixed.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return repeated.select(*docs.columns)
