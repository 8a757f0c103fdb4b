"""Chat formatting: multi-party perspective rotation.

For every participant of a dialogue the whole dialogue is rendered with that
speaker as ``assistant``, the other speakers as named users and system turns
as ``system``; the mask covers what the assistant says (text and end marker).
Column expressions only.

A dialogue is rendered in parts of ``PART_TURNS`` turns, each with its
character offset in the whole rendering, so a dialogue of any length - one
that holds a third of all rows, say - is spread over many rows and tasks; an
ordinary one is a single part.  Positions and offsets are prefix sums.

Defined results: a null speaker is the participant with the empty name; a null
text is empty; a null turn number comes first; turns of equal number come in
the order of speaker and text; repeated rows are turns of their own; rows with
a null ``conv_id`` form one dialogue; a dialogue of system turns only has no
participant and no rendering; extra columns are ignored; blanks and control
characters in a name become ``_``; control strings in a text are left as they
are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import prefix_sums

PART_TURNS = 64
SYSTEM = ("system",)

RENDERED = """aggregate(segs, named_struct('at', 0L, 'starts', cast(array() AS array<bigint>), 'ends', cast(array() AS array<bigint>)),
  (a, s) -> named_struct(
    'at', a.at + char_length(s.head) + char_length(s.body) + 1L,
    'starts', if(s.own, array_append(a.starts, a.at + char_length(s.head)), a.starts),
    'ends', if(s.own, array_append(a.ends, a.at + char_length(s.head) + char_length(s.body)), a.ends)))"""


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role",
                 text: str = "text", system=SYSTEM, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, perspective, part, n_turns, start, rendered, mask_starts,
    mask_ends): one row per participant and part; ``start`` is the part's
    offset, the mask ranges are offsets within the part."""
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        F.coalesce(F.col(f"`{speaker}`").cast("string"), F.lit("")).alias("who"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    people = (rows.filter(~F.col("who").isin(*system)).select(F.col("conv_id").alias("_conv"), F.col("who").alias("perspective"))
              .distinct())
    placed = prefix_sums(rows, ["conv_id"], "turn", ["who", "text"], {"pos": F.lit(1)})
    parts = (placed.groupBy("conv_id", F.floor(F.col("pos") / part_turns).alias("part"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "who", "text"))).alias("turns")))
    views = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    names = ", ".join(f"'{s}'" for s in system)
    seg = (f"transform(turns, t -> named_struct('own', t.who = perspective AND t.who NOT IN ({names}), 'head', "
           f"concat('<|im_start|>', CASE WHEN t.who IN ({names}) THEN 'system' WHEN t.who = perspective THEN 'assistant' "
           r"ELSE concat('user name=', regexp_replace(t.who, '[\\x00-\\x20\\x7F]', '_')) END, '\n'), "
           "'body', concat(t.text, '<|im_end|>')))")
    views = views.withColumn("segs", F.expr(seg)).withColumns({
        "mask": F.expr(RENDERED),
        "rendered": F.expr(r"array_join(transform(segs, s -> concat(s.head, s.body, '\n')), '')")})
    views = views.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), "rendered",
                         F.col("mask.starts").alias("mask_starts"), F.col("mask.ends").alias("mask_ends"))
    return prefix_sums(views, ["conv_id", "perspective"], "part", [], {"start": F.char_length("rendered").cast("long")})


def op1_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select(*COLUMNS)


COLUMNS = "conv_id perspective part n_turns start rendered mask_starts mask_ends".split()

SQL = rf"""WITH t AS (
  SELECT conv_id, coalesce(role, '') AS who, coalesce(text, '') AS tx,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
s AS (
  SELECT t.conv_id, perspective, pos, pos // {PART_TURNS} AS part, who = perspective AS own,
         '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = perspective THEN 'assistant'
                           ELSE 'user name=' || regexp_replace(who, '[\x00-\x20\x7F]', '_', 'g') END || chr(10) AS head,
         tx || '<|im_end|>' AS body
  FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS beg FROM s),
r AS (
  SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
         string_agg(head || body || chr(10), '' ORDER BY pos) AS rendered,
         coalesce(list(CAST(beg AS BIGINT) ORDER BY pos) FILTER (own), []) AS mask_starts,
         coalesce(list(CAST(beg + length(body) AS BIGINT) ORDER BY pos) FILTER (own), []) AS mask_ends
  FROM o GROUP BY 1, 2, 3)
SELECT conv_id, perspective, part, n_turns, rendered, mask_starts, mask_ends,
       CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY part
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM r"""
