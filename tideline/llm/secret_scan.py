"""Secret scan with an incremental blob ledger, in DataFrame functions alone.

Every version of every path is named by the SHA-256 of its text, its blob. A ledger (a Parquet table in a folder for
each rule version) holds the findings of each blob that was ever scanned under these rules, also of those without any.
A run scans the blobs that the ledger lacks, once each whatever the number of paths that hold them, appends their
findings and joins the ledger back to all paths.

Places come from two passes of one pattern: the matches, and the pieces that they leave when the text is split by them.
Running sums of both lengths, a window over one blob's matches, give starts and ends in code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import scratch, spread_join, stored

#: Missing blobs up to this number are broadcast to find their texts; beyond it all texts are grouped.
FEW = 200_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and without overlap, whose group has `least` characters or more.
    hints are strings of which a text with a match holds one; they only save work."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
#: The kinds that every scan has, in the order in which equal starts are listed. A run of hexadecimal digits shorter
#: than 24 cannot hide a longer one, nor can a short access key, so their length stands in the pattern; an assignment
#: can hide another inside its value, so its length is asked afterwards.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hints=("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the method adds: published forms of service tokens and keys.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", hints=("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyJ",)),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", hints=("k_live_",)),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:[^\s/:@]{3,80}@", hints=("://",)),
)
RULES = BASE + ADDED

_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
_LEDGER = f"blob string, findings {_SPAN}"


def rule_version(rules: tuple[Rule, ...]) -> str:
    """A digest of what decides the findings; hints do not."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:32]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """(rank, at, gap, width, ok) of each match of the rule: its number, the length before it since the last, its own."""
    none = F.array().cast("array<struct<rank:int,at:int,gap:int,width:int,ok:boolean>>")
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    size = F.length if not rule.group else (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)))
    each = lambda g, i: F.struct(F.lit(rank).alias("rank"), i.alias("at"), F.length(g["0"]).alias("gap"), F.length(g["1"]).alias("width"), (size(g["1"]) >= rule.least).alias("ok"))
    all_of = lambda m: F.when(F.size(m) > 0, F.transform(F.slice(F.arrays_zip(gaps.alias("0"), m.alias("1")), 1, F.size(m)), each)).otherwise(none)
    full = F.transform(F.array(found), all_of)[0]
    hint = None
    for h in rule.hints:
        hint = F.contains(text, F.lit(h)) if hint is None else hint | F.contains(text, F.lit(h))
    return full if hint is None else F.when(hint, full).otherwise(none)


def findings(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, findings) of rows (blob, text) with a row for each blob: all places, by start and then by rule."""
    hits = texts.select("blob", F.explode_outer(F.concat(*[_matches(F.col("text"), r, i) for i, r in enumerate(rules)])).alias("m")).select("blob", "m.*")
    order = Window.partitionBy("blob", "rank").orderBy("at")
    end = F.sum((F.col("gap") + F.col("width")).cast("long")).over(order)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.col("width")).alias("start"), F.col("rank"), kind.alias("kind"), "end")
    return hits.withColumn("end", end).groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("ok"), span))).cast(_SPAN).alias("findings"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame | None:
    """(blob, findings) of the blobs scanned under these rules, None if there are none; two runs at once may have added
    a blob twice."""
    folder = f"{ledger}/rules={rule_version(rules)}"
    return spark.read.schema(_LEDGER).parquet(folder) if _exists(spark, folder) else None


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the blobs of versions (column text) that the ledger lacks under these rules, and appends their findings.

    A text moves once, after copies in one task became one row. When the ledger lacks few blobs, only their texts move.
    """
    spark = versions.sparkSession
    rows = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    seen = read_ledger(spark, ledger, rules)
    if seen is not None:
        unseen = stored(rows.select("blob").distinct().join(seen.select("blob"), "blob", "left_anti"), "unseen-blobs")
        n = unseen.count()
        if not n:
            return
        if n <= FEW:
            rows = rows.join(F.broadcast(unseen), "blob", "left_semi")
    texts = rows.groupBy("blob").agg(F.first("text").alias("text"))
    if seen is not None and n > FEW:
        texts = texts.join(unseen, "blob", "left_semi")
    findings(texts, rules).write.mode("append").parquet(f"{ledger}/rules={rule_version(rules)}")


def secret_scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The path columns, blob and findings (start, rank of the rule, kind, end; code points, end exclusive), a row for
    each row of versions, after the ledger has got what it lacked.

    A null text counts as empty and has no findings. Path columns may be null or repeated and of any type; equal texts
    are scanned once and found under each of their paths. Other columns are ignored, whatever their names. An empty
    table gives an empty result and leaves the ledger as it is. Texts are scanned whole at any length. A blob of the
    ledger is never scanned again under the same rules; other rules have a folder of their own.
    """
    spark, names = versions.sparkSession, [f"_p{i}" for i in range(len(path))]
    paths = stored(versions.select(*[F.col(c).alias(n) for c, n in zip(path, names, strict=True)], blob_of(F.col("text")).alias("blob")), "blob-paths")
    scan_unseen(versions, ledger, rules)
    held = read_ledger(spark, ledger, rules)
    if held is None:
        held = spark.createDataFrame([], _LEDGER)
    with_any = held.where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))
    found = spread_join(paths, with_any, ["blob"])
    return found.select(*[F.col(n).alias(c) for c, n in zip(path, names, strict=True)], "blob", F.coalesce("findings", F.array().cast(_SPAN)).alias("findings"))


def listed(spans: Column) -> Column:
    """kind:start:end of each place, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """The secrets of all documents; without a ledger of its own, the run starts an empty one in the scratch folder."""
    rows = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ledger or scratch(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda s: s["rank"] < len(BASE))
    return rows.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def _sql_hits(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    size = f"length(regexp_extract(m, '{pattern}', {rule.group}))" if rule.group else "length(m)"
    return f"""SELECT doc_id, row_no, {rank} AS rank, '{rule.kind}' AS kind, i, m, {size} >= {rule.least} AS ok,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, row_no, gaps, found, unnest(found) AS m, generate_subscripts(found, 1) AS i FROM (
    SELECT doc_id, row_no, regexp_extract_all(text, '{pattern}', 0) AS found, regexp_split_to_array(text, '{pattern}') AS gaps FROM docs))"""


#: Every rule's matches and the pieces between them, with lengths added up in lists.
SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(_sql_hits(i, r) for i, r in enumerate(RULES))}),
spans AS (SELECT row_no, rank, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT) AS span FROM hits WHERE ok),
per_doc AS (SELECT row_no, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY row_no)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per_doc USING (row_no)
"""
