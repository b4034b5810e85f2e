"""Chat formatting by multi-party perspective rotation.

Each participant of a conversation gets a rendering in which that speaker is the assistant, the other speakers are
users with names, and system turns stay system turns. The mask marks the characters to learn: the assistant's texts
with their end marks. Everything is DataFrame functions.

A rendering is a row for each SEGMENT turn numbers of a conversation, so one of millions of turns is many short rows; a
dialogue of fewer turns is one row. Where turn numbers repeat, or are null, so often that such a range has more than
SEGMENT turns, its turns are numbered in order and cut into parts of SEGMENT; segments and parts in order give the whole
dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turn numbers of one segment, and turns of one part at most.
SEGMENT = 512
START, END = "<|im_start|>", "<|im_end|>\n"


def _header(role: Column, perspective: Column) -> Column:
    shown = F.when(role == "system", F.lit("system")).when(role.eqNullSafe(perspective), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), shown, F.lit("\n"))


def _parts(turns: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``turns`` with the number of the part that each belongs to, for segments of more than ``most`` turns.

    A range partitioning sorts the rows by segment and order, equal rows too, so no segment and no repeated row is one
    task's. A row's place among all is its place in its partition and the rows of the partitions before; that less the
    first place of its segment is its place there. The sorted rows are written, as a second sort might cut elsewhere.
    """
    order = [*keys, "turn", "role", "text", "_m"]
    rows = turns.withColumn("_m", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.drop("_m").withColumn("_at", F.monotonically_increasing_id()), "turns")
    block, within = F.shiftright("_at", 33).alias("_block"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_within")
    rows = rows.select("*", block, within)
    # One row a partition.
    sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_block", (F.sum("n").over(Window.orderBy("_block")) - F.col("n")).alias("_before"))
    rows = rows.join(before, "_block").withColumn("_place", F.col("_within") + F.col("_before"))
    first = rows.groupBy(*keys).agg(F.min("_place").alias("_first"))
    # The second key lets adaptive execution split a segment that has very many rows.
    lead = F.pmod(F.col("segment"), F.lit(2)).alias("_k")
    return rows.select("*", lead).join(first.select("*", lead), [*keys, "_k"]).select(*turns.columns, F.expr(f"(_place - _first) div {most}").alias("part"))


def perspectives(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, perspective, segment, part, n_turns, text, mask): every dialogue from every participant's side.

    conversations: (conv_id, turn, role, text); other columns are not used.

    * A null role is the speaker ``unknown``; a null text is empty; null turns stand before the numbered ones (segment
      null); a null conv_id is a conversation of its own.
    * Turns of equal number follow in order of role, then text; equal rows are all shown.
    * part counts from 0 and is 0 but in segments of more than ``segment`` turns.
    * A conversation of system turns alone has no participant: it comes once, with perspective null and no mask.
    * mask is an array of (start, end) in characters of ``text``, end exclusive.

    The wide turns are shuffled once, by (conversation, segment, part). Which speakers a conversation has, and which
    segments have too many turns, is known from all its turns through narrow aggregates.
    """
    c = conversations
    none = F.lit(-(1 << 62))
    turns = c.select(
        F.coalesce("conv_id", F.lit(0)).alias("_id"), F.col("conv_id").isNull().alias("_none"),
        F.coalesce(F.expr(f"(turn - pmod(turn, {segment})) div {segment}").cast("long"), none).alias("segment"),
        "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    conv, seg, part = ["_id", "_none"], ["_id", "_none", "segment"], ["_id", "_none", "segment", "part"]
    speakers = turns.where("role <> 'system'").groupBy(*conv).agg(F.sort_array(F.collect_set("role")).alias("speakers"))
    full = written(turns.groupBy(*seg).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment).select(*seg), "full-segments")
    if full.isEmpty():
        # A constant is no key: it would part the join's keys from those of the grouping.
        part = seg
    else:
        # Written, so its size decides whether it is broadcast.
        marked = turns.withColumn("_k", F.pmod("turn", F.lit(2)))
        keyed = full.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(None))))
        same = [marked[k] == keyed[k] for k in seg] + [marked["_k"].eqNullSafe(keyed["_k"])]
        plain, crowded = marked.join(keyed, same, "left_anti").drop("_k"), marked.join(keyed, same, "left_semi").drop("_k")
        turns = plain.withColumn("part", F.lit(0).cast("long")).unionByName(_parts(crowded, seg, segment))
    dialogue = turns.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # Speakers come by the keys of the parts, so the wide dialogues need no other exchange.
    sides = turns.select(*part).distinct().join(speakers, conv, "left")
    each = dialogue.join(sides, part).select(*part, "turns", F.explode_outer("speakers").alias("perspective"))
    pieces = F.transform("turns", lambda t: F.struct(_header(t["role"], F.col("perspective")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), t["role"].eqNullSafe(F.col("perspective")).alias("own")))
    number = F.col("part") if "part" in part else F.lit(0).cast("long").alias("part")
    each = each.select(*seg, number, "perspective", pieces.alias("p"))
    # Ends of the pieces: running sums over at most a segment's turns.
    ends = F.aggregate("p", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x["head"]) + F.length(x["body"]))))
    each = each.withColumn("e", ends)
    spans = F.transform("p", lambda x, i: F.struct(x["own"].alias("own"), (F.get("e", i + 1) - F.length(x["body"])).alias("start"), F.get("e", i + 1).alias("end")))
    mask = F.transform(F.filter(spans, lambda x: x["own"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return each.select(
        F.when(~F.col("_none"), F.col("_id")).alias("conv_id"), "perspective", F.when(F.col("segment") != none, F.col("segment")).alias("segment"), "part", F.size("p").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), mask.alias("mask"),
    )


def mask_text(mask: Column) -> Column:
    """The spans as text, such as ``12-40,61-90``."""
    return F.array_join(F.transform(mask, lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")


PERSPECTIVES_SQL = f"""
WITH t AS (
  SELECT coalesce(conv_id, 0) AS id, conv_id IS NULL AS none, (turn - ((turn % {SEGMENT}) + {SEGMENT}) % {SEGMENT}) // {SEGMENT} AS segment,
         turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
n AS (
  SELECT *, row_number() OVER (PARTITION BY id, none, segment ORDER BY turn NULLS FIRST, role, text) AS nth FROM t),
s AS (SELECT DISTINCT id, none, role AS perspective FROM t WHERE role <> 'system'),
c AS (SELECT DISTINCT id, none FROM t),
p AS (SELECT c.id, c.none, s.perspective FROM c LEFT JOIN s ON c.id = s.id AND c.none = s.none),
r AS (
  SELECT n.*, (n.nth - 1) // {SEGMENT} AS part, p.perspective, n.role IS NOT DISTINCT FROM p.perspective AS own,
    '{START}' || CASE WHEN n.role = 'system' THEN 'system' WHEN n.role IS NOT DISTINCT FROM p.perspective THEN 'assistant'
                      ELSE 'user name=' || n.role END || chr(10) AS head,
    n.text || '<|im_end|>' || chr(10) AS body
  FROM n JOIN p ON n.id = p.id AND n.none = p.none),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY id, none, segment, part, perspective
            ORDER BY nth ROWS UNBOUNDED PRECEDING) AS e FROM r)
SELECT CASE WHEN NOT none THEN id END AS conv_id, perspective, segment, part, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg(head || body, '' ORDER BY nth) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(e - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(e AS BIGINT) AS VARCHAR) END, ','
           ORDER BY nth), '') AS mask
FROM o GROUP BY id, none, segment, part, perspective
"""
