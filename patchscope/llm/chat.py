"""Chat formatting with rotated perspectives, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as
assistant and the others as named users. Loss falls on the assistant's turns only; the mask
is given as character spans. Long conversations come in parts, so that no group grows with
the length of a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_TURNS = 256
START, END = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, context_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per conversation, participant and part.

    Columns: conv_id, speaker (the participant in the assistant's place), part (turn number
    div ``part_turns``), part_start (characters of all parts before), rendered, spans
    ("start-end" of each piece with loss, in characters of ``rendered``, comma-separated, empty
    if none), n_turns, n_loss (characters with loss). The parts in order are the whole
    dialogue, and a span moved by part_start is a span of the whole; context turns stand
    where they were said, so as a rule in the first part only.
    Participants are the roles of the whole conversation but for ``context_roles``, which
    stay what they are. The loss covers the assistant's text and its end mark.
    A turn is a row: NULL text is empty, a NULL role is the participant "unknown", a NULL
    turn number counts as 0, a NULL conv_id is a conversation of its own. Turns with equal
    numbers go by role and text; repeated rows are repeated turns. An empty table gives none.
    """
    role = F.coalesce("role", F.lit("unknown"))
    rows = turns.select(
        "conv_id", F.coalesce("turn", F.lit(0)).alias("__turn"), role.alias("__role"), F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.withColumn("part", F.floor(F.col("__turn") / part_turns))
    speakers = rows.where(~F.col("__role").isin(*context_roles)).select(F.col("conv_id").alias("__conv"), F.col("__role").alias("speaker")).distinct()
    views = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv")))
    mine = F.col("__role") == F.col("speaker")
    head = (
        F.when(mine, F.lit(f"{START}assistant\n"))
        .when(F.col("__role").isin(*context_roles), F.concat(F.lit(START), "__role", F.lit("\n")))
        .otherwise(F.concat(F.lit(f"{START}user name="), "__role", F.lit("\n"))))
    views = views.withColumn("__mine", mine).withColumn("__head", head).withColumn("__piece", F.concat("__head", "__text", F.lit(END)))
    group = ["conv_id", "speaker", "part"]
    order = W.partitionBy(*group).orderBy("__turn", "__role", "__text").rowsBetween(W.unboundedPreceding, W.currentRow)
    views = views.withColumn("__stop", F.sum(F.length("__piece")).over(order)).withColumn("__no", F.count("*").over(order))
    begin = F.col("__stop") - F.length("__piece") + F.length("__head")
    span = F.when(F.col("__mine"), F.concat_ws("-", begin.cast("string"), F.col("__stop").cast("string")))
    out = views.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("__no", "__piece", span.alias("__span")))).alias("__all"),
        F.count("*").alias("n_turns"), F.sum(F.when(F.col("__mine"), F.col("__stop") - begin).otherwise(0)).alias("n_loss"))
    # lengths alone are summed over parts: one small row a part, whatever the dialogue holds
    sizes = views.groupBy(*group).agg(F.sum(F.length("__piece")).alias("__size"))
    before = W.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("part_start", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    sizes = sizes.select(F.col("conv_id").alias("__c"), F.col("speaker").alias("__s"), F.col("part").alias("__p"), "part_start")
    out = out.join(sizes, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("speaker") == F.col("__s")) & (F.col("part") == F.col("__p")))
    return out.select(
        *group, "part_start", F.array_join("__all.__piece", "").alias("rendered"), F.array_join("__all.__span", ",").alias("spans"), "n_turns", "n_loss")


SQL = f"""WITH r AS (SELECT conv_id, coalesce(turn, 0) AS t, coalesce(role, 'unknown') AS role, coalesce(text, '') AS x FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM r WHERE role <> 'system'),
v AS (SELECT conv_id, speaker, CAST(floor(t / {PART_TURNS}) AS BIGINT) AS part, t, role, x, role = speaker AS mine,
  '{START}' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.c),
p AS (SELECT *, head || x || '<|im_end|>' || chr(10) AS piece FROM v),
o AS (SELECT *, row_number() OVER w AS k, sum(length(piece)) OVER (PARTITION BY conv_id, speaker, part ORDER BY t, role, x ROWS UNBOUNDED PRECEDING) AS e
  FROM p WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY t, role, x))
SELECT conv_id, speaker, part, CAST(coalesce(sum(sum(length(piece))) OVER (PARTITION BY conv_id, speaker ORDER BY part
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part_start, string_agg(piece, '' ORDER BY k) AS rendered,
  coalesce(string_agg(CASE WHEN mine THEN CAST(e - length(piece) + length(head) AS VARCHAR) || '-' || CAST(e AS VARCHAR) END, ',' ORDER BY k), '') AS spans,
  count(*) AS n_turns, CAST(sum(CASE WHEN mine THEN length(piece) - length(head) ELSE 0 END) AS BIGINT) AS n_loss
FROM o GROUP BY conv_id, speaker, part"""
