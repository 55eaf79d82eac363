"""Conversation structure repair by a dynamic program over retained turns.

A conversation is mended when the initials of its roles read `(s?(ua)+)?`. The program chooses
which rows are retained, as they are or with a new role. Between two retained rows all others
are deleted: sums of deletion costs up to a row price any such gap as a difference, so per role
only the least price so far is kept (running minima), and each row costs a few comparisons. Two
roles that meet determine what is inserted between them. Of equally cheap repairs the one whose
audit (the initials of its edits in order) comes first in ASCII order is read off.

Spark joins, sorts and groups the rows; the program sees one letter pair a row, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendloom.llm import tables

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: The role that must follow each; ^ is the beginning.
NEXT = {"^": "u", "s": "u", "u": "a", "a": "u"}
#: What is missing between two roles, or before the end ($).
MISSING = {
    "^": {"s": "", "u": "", "a": "u", "$": ""},
    "s": {"u": "", "a": "u", "$": "ua"},
    "u": {"a": "", "u": "a", "$": "a"},
    "a": {"u": "", "a": "u", "$": ""},
}
SEEN = r"[^\x20\x09-\x0D]"
OPEN_END = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
#: Rows that are written at a time.
BLOCK = 10_000

# crc32 of the short key, bit by bit; then the program as a recursion that carries the best
# (cost, audit, text) of each state from row to row.
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
crc AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) % 20 AS fate FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE fate <> 0)),
ordered AS (
  SELECT *, row_number() OVER w AS pos, lag(role[1]) OVER w AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault,
    before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM ordered),
none AS (SELECT struct_pack(c := 1000000000::BIGINT, a := '', t := '') AS x),
walk(conv_id, pos, p, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, struct_pack(c := 0::BIGINT, a := '', t := ''), x, x, x FROM (SELECT DISTINCT conv_id FROM conversations), none
  UNION ALL
  SELECT conv_id, pos,
    struct_pack(c := p0.c + 2, a := p0.a || 'D', t := p0.t),
    list_min([struct_pack(c := s0.c + 2, a := s0.a || 'D', t := s0.t), struct_pack(c := p0.c + never + extra + CASE ini WHEN 's' THEN 0 ELSE 1000000 END, a := p0.a || 'K', t := p0.t || chr(10) || role || ':' || text)]),
    list_min([struct_pack(c := u1.c + 2, a := u1.a || 'D', t := u1.t), struct_pack(c := to_u.c + never + extra + CASE ini WHEN 'u' THEN 0 ELSE 1000000 END, a := to_u.a || 'K', t := to_u.t || chr(10) || role || ':' || text),
      struct_pack(c := to_u.c + never + extra + 1, a := to_u.a || 'R', t := to_u.t || chr(10) || 'user:' || text)]),
    list_min([struct_pack(c := a1.c + 2, a := a1.a || 'D', t := a1.t), struct_pack(c := u1.c + never + extra + CASE ini WHEN 'a' THEN 0 ELSE 1000000 END, a := u1.a || 'K', t := u1.t || chr(10) || role || ':' || text),
      struct_pack(c := u1.c + never + extra + 1, a := u1.a || 'R', t := u1.t || chr(10) || 'assistant:' || text)])
  FROM (
    SELECT *, list_min([p0, s0, a1]) AS to_u FROM (
      SELECT *, list_min([a0, struct_pack(c := u1.c + 5, a := u1.a || 'I', t := u1.t || chr(10) || 'assistant:')]) AS a1 FROM (
        SELECT w.conv_id, f.pos, p AS p0, s AS s0, a AS a0, role, text, role[1] AS ini, CASE WHEN fault IN ('b', 'd') THEN 1000000 ELSE 0 END AS never, CASE fault WHEN 't' THEN 5 ELSE 0 END AS extra,
          list_min([u, list_min([struct_pack(c := x.c + 5, a := x.a || 'I', t := x.t || chr(10) || 'user:') for x in [p, s, a]])]) AS u1
        FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1)))),
done AS (
  SELECT conv_id, list_min([p, a, struct_pack(c := u.c + 5, a := u.a || 'I', t := u.t || chr(10) || 'assistant:'), struct_pack(c := s.c + 10, a := s.a || 'II', t := s.t || chr(10) || 'user:' || chr(10) || 'assistant:')]) AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(best.t[2:]) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations after the damage that their keys' crc32 deals out; nulls of role and text read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where("fate <> 0").withColumn("copy", F.explode(twice))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows with their place `at` in the conversation, first fault (b, d, t or -), and whether role or turn departs from the row before."""
    initial = F.substring("role", 1, 1)
    # One shuffle serves both windows.
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "nth")
    fault = F.when(~F.col("text").rlike(SEEN), "b").when(F.col("nth") > 1, "d").when(F.col("text").rlike(OPEN_END), "t").otherwise("-")
    pair = F.concat(F.lag(initial).over(order), initial)
    return rows.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("at"), "turn", "role", "text", fault.alias("fault"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), F.coalesce(F.col("turn") != F.lag("turn").over(order), F.col("turn").isNotNull()).alias("new_turn"),
    )


def mend(codes: str) -> tuple[int, str]:
    """Least cost and its audit for rows given as pairs of a role's initial and a fault."""
    roles, faults = codes[::2], codes[1::2]
    n = len(roles)
    gone = [DELETE * i for i in range(n + 1)]
    low = dict.fromkeys("sua", 1 << 60)
    #: rest[i]: what rows from i on cost after each role that was retained last.
    rest = [{q: INSERT * len(missing["$"]) for q, missing in MISSING.items()}] * (n + 1)
    for i in reversed(range(n)):
        if faults[i] not in "bd":
            extra = TRUNCATED if faults[i] == "t" else 0
            for r in "sua":
                if roles[i] == r or r != "s":
                    low[r] = min(low[r], gone[i] + extra + (KEEP if roles[i] == r else REROLE) + rest[i + 1][r])
        rest[i] = {
            q: min(gone[n] - gone[i] + INSERT * len(missing["$"]), *(low[r] - gone[i] + INSERT * len(between) for r, between in missing.items() if r != "$")) for q, missing in MISSING.items()
        }
    audit, i, q = [], 0, "^"
    while i < n or q not in "^a":
        r, due = NEXT[q], rest[i][q]
        if i < n and DELETE + rest[i + 1][q] == due:
            audit.append("D")
            i += 1
        elif INSERT + rest[i][r] == due:
            audit.append("I")
            q = r
        else:
            extra = TRUNCATED if faults[i] == "t" else 0
            kept = roles[i] if roles[i] == r or (roles[i], q) == ("s", "^") else None
            keep = kept is not None and KEEP + extra + rest[i + 1][kept] == due
            audit.append("K" if keep else "R")
            q, i = kept if keep else r, i + 1
    return rest[0]["^"], "".join(audit)


def edits(codes: str, audit: str) -> Iterator[tuple[int, int | None, str, str | None]]:
    """(place in the repaired conversation, row or None, edit, new role or None) of all that is not deleted."""
    place, at, q = 0, 0, "^"
    for letter in audit:
        if letter != "D":
            new = None if letter == "K" else ROLES[NEXT[q]]
            q = NEXT[q] if new else codes[2 * at]
            yield place, None if letter == "I" else at, letter, new
            place += 1
        at += letter != "I"


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A report (a row per conversation) and the repaired rows (conv_id, place, turn, edit, role, text).

    rows: conv_id, turn, role, text; conversations: all conv_ids that are to be reported, by
    default those of rows. Null roles and texts read as one space; rows stand by turn (null
    first), then role, then text; a null conv_id is a conversation of its own. A role of another
    or no initial can only be given a new role or deleted. Texts of any length stay whole: the
    program reads letters. A conversation without rows has zeros and an empty audit. Extra
    columns are not read; empty tables give empty results. A conversation's letters, like its
    audit, are one value, so they lie in one task; its texts pass through one as a stream.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = tables.stage(placed(rows.select("conv_id", "turn", space("role"), space("text"))), "turns")
    wide = lambda c: c.cast("decimal(38,0)")
    initial = F.substring("role", 1, 1)
    letter = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), "fault")
    count = lambda c: F.count(F.when(c, 1))
    per = rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", letter.alias("code")))), lambda x: x["code"]), "").alias("codes"),
        F.try_subtract(wide(F.max("turn")) + 1, wide(F.min("turn")) + count(F.col("new_turn"))).cast("long").alias("gaps"),
        *(count(F.col("fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))), count(F.col("illegal")).alias("illegal"),
    )

    def solve(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mend(c) for c in codes], columns=["cost", "audit"])

    plan = tables.stage(per.withColumn("plan", F.pandas_udf(solve, "cost long, audit string")("codes")), "plan")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        names = ["conv_id", "place", "at", "edit", "new"]
        frame = lambda: pd.DataFrame(out, columns=names).astype({"conv_id": object, "at": "Int64"})
        for batch in batches:
            for conv, codes, audit in zip(batch.conv_id, batch.codes, batch.audit, strict=True):
                for edit in edits(codes, audit):
                    out.append((conv, *edit))
                    if len(out) == BLOCK:
                        yield frame()
                        out.clear()
        yield frame()

    # As text the id passes pandas unchanged, null or not.
    written = plan.select(F.col("conv_id").cast("string").alias("conv_id"), "codes", "plan.audit").mapInPandas(write, "conv_id string, place long, at long, edit string, new string")
    written = written.withColumn("conv_id", F.col("conv_id").cast(kind))
    texts = rows.select(F.col("conv_id").alias("of"), F.col("at").alias("row"), "turn", "role", "text")
    written = written.join(texts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("row")), "left")
    written = written.select("conv_id", "place", "turn", "edit", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    named = conversations.select(F.col("conv_id").alias("of")).distinct() if conversations is not None else plan.select(F.col("conv_id").alias("of"))
    report = named.join(plan, F.col("of").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("of").alias("conv_id"), *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c.removeprefix("plan.")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "plan.cost")),
        F.coalesce("plan.audit", F.lit("")).alias("audit"),
    )
    return report, written


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of a conversation's lines `role:text`, in order, read as a stream."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator) -> Iterator:
        key, state, out = None, None, []
        for batch in batches:
            for conv, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if place == 0:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield from frame(out)
            out = []
        if state is not None:
            yield from frame([(key, state.hexdigest())])

    def frame(rows: list) -> Iterator:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["conv_id", "repaired_sha256"])

    lines = repaired.select(F.col("conv_id").cast("string").alias("conv_id"), "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return lines.mapInArrow(read, "conv_id string, repaired_sha256 string").withColumn("conv_id", F.col("conv_id").cast(kind))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = tables.read(spark, sf_dir, "conversations")
    report, repaired = repair(damaged(conversations), conversations)
    found = digests(repaired).withColumnRenamed("conv_id", "of")
    return report.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
