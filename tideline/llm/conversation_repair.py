"""Conversation structure repair: the cheapest edits that make the roles follow `(s?(ua)+)?`.

A row is kept, given the role that the grammar asks for, or deleted; turns with an empty text may be inserted. The
grammar is a small automaton, so the cost from a turn on depends on its state alone. One pass over a conversation's rows
from the last to the first computes the four costs to go and notes for each state the ASCII-least edit among those that
reach the cheapest cost; a pass from the first to the last then walks along the notes. Both passes read sorted rows as a
stream: what they hold of a conversation is four numbers, or its state and the letters of its edits, never its texts.

All rows of a conversation lie in one partition from one shuffle on; both passes and the search for repeated turns sort
within it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._crc_sql import crc32_sql

#: States of the grammar: nothing yet, after s, after u, after a. STEPS: where a role leads; FILL: the role that a state
#: asks for, and where it leads.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FILL = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ENDS = (0, 3)
#: The edits in ASCII order and their costs; CUT is added for a truncated row that stays.
EDITS = "DIKR"
COST = {"D": 2, "I": 5, "K": 0, "R": 1}
CUT = 5
INITIALS = "sua"
#: Kind of a row: the place of its role's initial in INITIALS or 3, 4 more if its text is truncated; or that it must go.
MUST_GO = 8

_BLANKS = " \t\n\x0b\x0c\r"
_NONE = float("inf")


def costs_at_end() -> tuple[float, ...]:
    return _filled([0.0 if q in ENDS else _NONE for q in FILL])


def _filled(cost: list[float]) -> tuple[float, ...]:
    """The costs with insertions: no cheapest way inserts more turns in a row than there are states."""
    for _ in FILL:
        cost = [min(c, COST["I"] + cost[FILL[q][1]]) for q, c in enumerate(cost)]
    return tuple(cost)


def _options(ahead: tuple[float, ...], q: int, kind: int) -> dict[str, float]:
    """The cost of each edit that consumes a row of this kind in state q."""
    out = {"D": COST["D"] + ahead[q]}
    if kind != MUST_GO:
        cut = CUT * (kind // 4)
        out["R"] = COST["R"] + cut + ahead[FILL[q][1]]
        after = STEPS.get((q, (*INITIALS, "")[kind % 4]))
        if after is not None:
            out["K"] = COST["K"] + cut + ahead[after]
    return out


def turn_back(ahead: tuple[float, ...], kind: int) -> tuple[tuple[float, ...], int]:
    """The costs to go before a row from those after it, and for each state the edit to make, two bits each."""
    by_state = [_options(ahead, q, kind) for q in FILL]
    cost = _filled([min(o.values()) for o in by_state])
    plan = 0
    for q, options in enumerate(by_state):
        tight = [e for e in EDITS if (options[e] if e in options else COST["I"] + cost[FILL[q][1]] if e == "I" else _NONE) == cost[q]]
        plan |= EDITS.index(tight[0]) << 2 * q
    return cost, plan


_ROWS = "conv_id {0}, turn {1}, role string, text string, fault string, kind int"


def judged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, kind): a row's first fault of blank, duplicate and truncated, or null. The rows
    of a conversation lie in one partition."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy(F.asc_nulls_first("turn"))
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = F.when(trimmed == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", place + 4).otherwise(place)
    return rows.withColumn("_nth", F.row_number().over(same)).withColumn("fault", fault).withColumn("kind", kind).drop("_nth")


def planned(rows: DataFrame) -> DataFrame:
    """rows of judged() with `plan`, in order within each conversation: by turn, null first, then by role and text."""

    def back(batches):
        memo: dict = {}
        names: dict[tuple[float, ...], int] = {}
        known: list[tuple[float, ...]] = []

        def number(cost):
            # Only the differences of the four costs decide, and of these there are few.
            cost = tuple(c - min(cost) for c in cost)
            if cost not in names:
                names[cost] = len(known)
                known.append(cost)
            return names[cost]

        at, state, end = (), 0, number(costs_at_end())
        for rb in batches:
            plans = []
            for conv, kind in zip(rb.column(0).to_pylist(), rb.column(5).to_pylist(), strict=True):
                if at != (conv,):
                    at, state = (conv,), end
                if (state, kind) not in memo:
                    cost, plan = turn_back(known[state], kind)
                    memo[state, kind] = number(cost), plan
                state, plan = memo[state, kind]
                plans.append(plan)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(plans, pa.int32())], names=[*rb.schema.names, "plan"])

    kinds = dict(rows.dtypes)
    # A repeated row is equal to the one before it but for its fault, and comes after it.
    last = rows.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc(F.col("fault") == "duplicate"))
    noted = last.select("conv_id", "turn", "role", "text", "fault", "kind").mapInArrow(back, _ROWS.format(kinds["conv_id"], kinds["turn"]) + ", plan int")
    return noted.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False)))


def _walk(batches):
    """(conv, edit, role, text, row) of each edit; row is (turn, role, fault) or None for an insertion. A conversation
    ends with an edit that is None."""
    at, state = (), 0

    def ending():
        q = state
        while q not in ENDS:
            yield at[0], "I", FILL[q][0], "", None
            q = FILL[q][1]
        yield at[0], None, None, None, None

    for rb in batches:
        for conv, turn, role, text, fault, plan in zip(*(rb.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6)), strict=True):
            if at != (conv,):
                if at:
                    yield from ending()
                at, state = (conv,), 0
            while (edit := EDITS[plan >> 2 * state & 3]) == "I":
                yield conv, "I", FILL[state][0], "", None
                state = FILL[state][1]
            row = turn, role, fault
            if edit == "D":
                yield conv, "D", None, None, row
            elif edit == "K":
                state = STEPS[state, role[:1]]
                yield conv, "K", role, text, row
            else:
                role, state = FILL[state]
                yield conv, "R", role, text, row
    if at:
        yield from ending()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, role, text: the repaired turns of each conversation in the order of place, from 1.

    Edits are K (kept), R (given another role) and I (inserted, without a turn); deleted rows are left out. A null role or
    text counts as one space, so a null text is blank and goes. Rows are ordered by turn, null first, and those of one
    turn by role and text; a row whose role and text came before goes. A null conv_id is a conversation like any other.
    A conversation of which nothing is left has no rows, and an empty table none at all. Other columns are ignored.
    """
    conv, turn = (dict(conversations.dtypes)[c] for c in ("conv_id", "turn"))

    def turns(batches):
        held, place = [], 0
        for found, edit, role, text, row in _walk(batches):
            place = 0 if edit is None else place + (edit != "D")
            if edit not in (None, "D"):
                held.append((found, place, edit, row and row[0], role, text))
            if len(held) >= 2000:
                yield _batch(held, kinds)
                held = []
        if held:
            yield _batch(held, kinds)

    rows = planned(judged(conversations))
    schema = f"conv_id {conv}, place long, edit string, turn {turn}, role string, text string"
    kinds = _arrow(rows.sparkSession, schema)
    return rows.mapInArrow(turns, schema)


_COUNTS = ("blank", "duplicate", "truncated")
_SUMMARY = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of the table: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the
    letters of all edits in order) and repaired_sha256 (of the lines `role:text` of what repair() returns)."""

    def report(batches):
        held, now = [], None
        for conv, edit, role, text, row in _walk(batches):
            if now is None:
                now = {"turns": [None, None, 0], "faults": dict.fromkeys(_COUNTS, 0), "illegal": 0, "cost": 0, "before": None, "audit": bytearray(), "sha": hashlib.sha256(), "any": False}
            if edit is None:
                low, high, n = now["turns"]
                gaps = 0 if low is None else high - low + 1 - n
                held.append((conv, gaps, *now["faults"].values(), now["illegal"], now["cost"], now["audit"].decode(), now["sha"].hexdigest()))
                now = None
                if len(held) >= 2000:
                    yield _batch(held, kinds)
                    held = []
                continue
            now["audit"] += edit.encode()
            now["cost"] += COST[edit]
            if row is not None:
                turn, old, fault = row
                low, high, n = now["turns"]
                if turn is not None and turn != high:
                    now["turns"] = [turn if low is None else low, turn, n + 1]
                if fault is not None:
                    now["faults"][fault] += 1
                    now["cost"] += CUT * (fault == "truncated" and edit != "D")
                now["illegal"] += now["before"] is not None and now["before"] + old[:1] not in ("su", "ua", "au")
                now["before"] = old[:1]
            if edit != "D":
                now["sha"].update(f"{'\n' if now['any'] else ''}{role}:{text}".encode())
                now["any"] = True
        if held:
            yield _batch(held, kinds)

    rows = planned(judged(conversations))
    schema = _SUMMARY.format(dict(conversations.dtypes)["conv_id"])
    kinds = _arrow(rows.sparkSession, schema)
    return rows.mapInArrow(report, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults made by the digits of crc32(`conv_id:turn`): some dropped, emptied, cut, repeated, given away."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), fault.alias("_fault")).where("_fault <> 0")
    changed = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("_copy")).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report = repair_report(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "illegal", "cost")]
    return ids.join(report, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )


def _sql_costs(ahead: str) -> str:
    """The four costs before a row (kind) from those after it, without insertions."""
    steps = {q: {i: after for (p, i), after in STEPS.items() if p == q} for q in FILL}
    out = []
    for q in FILL:
        keep = " ".join(f"WHEN r.initial = '{i}' AND NOT r.must_go THEN r.cut + {ahead}[{after + 1}]" for i, after in steps[q].items())
        out.append(f"least(2 + {ahead}[{q + 1}], CASE WHEN r.must_go THEN 999999999 ELSE 1 + r.cut + {ahead}[{FILL[q][1] + 1}] END, CASE {keep} ELSE 999999999 END)")
    return f"[{', '.join(out)}]"


_SQL_FILLED = "[least(w[1], 5 + w[3], 10 + w[4]), least(w[2], 5 + w[3], 10 + w[4]), least(w[3], 5 + w[4]), least(w[4], 5 + w[3])]"
_SQL_NEXT = "CASE q WHEN 2 THEN 3 ELSE 2 END"
_SQL_KEEP = "CASE WHEN q IN (0, 1, 3) AND r.initial = 'u' THEN 2 WHEN q = 0 AND r.initial = 's' THEN 1 WHEN q = 2 AND r.initial = 'a' THEN 3 END"

#: The same costs and the same walk as two recursive queries over the turns of all conversations at once.
SQL = f"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS damage
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, (SELECT unnest([1, 2]) AS copy) WHERE damage <> 0 AND (copy = 1 OR damage = 3)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged)),
rows_ AS (
  SELECT *, left(role, 1) AS initial, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM ordered)),
lengths AS (SELECT conv_id, max(pos) AS n FROM rows_ GROUP BY conv_id),
back AS (
  SELECT conv_id, n + 1 AS pos, [0, 10, 5, 0] AS v FROM lengths
  UNION ALL SELECT conv_id, pos, {_SQL_FILLED} AS v FROM (
    SELECT r.conv_id, r.pos, {_sql_costs("b.v")} AS w FROM back b JOIN rows_ r ON r.conv_id = b.conv_id AND r.pos = b.pos - 1)),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS pos, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines, 0 AS cost FROM lengths
  UNION ALL SELECT conv_id, CASE e WHEN 'I' THEN pos ELSE pos + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kept ELSE filled END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, fill || ':' || text) ELSE list_append(lines, fill || ':') END,
    cost + CASE e WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'K' THEN cut ELSE 1 + cut END
  FROM (
    SELECT w.*, r.role, r.text, coalesce(r.cut, 0) AS cut, {_SQL_KEEP} AS kept, {_SQL_NEXT} AS filled, CASE q WHEN 2 THEN 'assistant' ELSE 'user' END AS fill,
      CASE WHEN r.pos IS NOT NULL AND b.v[q + 1] = 2 + a.v[q + 1] THEN 'D' WHEN b.v[q + 1] = 5 + b.v[{_SQL_NEXT} + 1] THEN 'I'
        WHEN NOT r.must_go AND b.v[q + 1] = r.cut + a.v[{_SQL_KEEP} + 1] THEN 'K' ELSE 'R' END AS e
    FROM walk w JOIN back b ON b.conv_id = w.conv_id AND b.pos = w.pos LEFT JOIN back a ON a.conv_id = w.conv_id AND a.pos = w.pos + 1 LEFT JOIN rows_ r ON r.conv_id = w.conv_id AND r.pos = w.pos
    WHERE r.pos IS NOT NULL OR q IN (1, 2))),
done AS (SELECT w.* FROM walk w JOIN lengths USING (conv_id) WHERE w.pos = n + 1 AND q IN (0, 3)),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM rows_) GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN facts USING (conv_id) LEFT JOIN done USING (conv_id)
"""
