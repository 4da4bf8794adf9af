"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold the same conversation several times: each request logs all turns so far, so a
shorter log is a prefix of a longer one.  Every turn gets a rolling hash of the turns up to it; a
conversation whose last rolling hash occurs before the end of another one is a prefix of it and is
left out by an anti-join.  Of conversations with equal turns, the one with the smallest id stays.
The maximal conversations are rendered with a chat template.

Texts are shuffled once, to their conversation, which is written as one row with its rendered text and turn
hashes; rolling hashes and the anti-join then work on hashes alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_ids, materialise, read_table

#: Two independent 64-bit turn hashes; their running XOR identifies a prefix with 128 bits.
_SEEDS = (11, 29)


def chatml_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def gather_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Callable[[Column, Column], Column] = chatml_turn
) -> DataFrame:
    """``_row, conv_id, n_turns, rendered, _hashes``, one row for each conversation, written to the shared folder.

    Turns are ordered by turn number, then role, then text.  Rows that repeat a turn of the same
    conversation with the same role and text count once.  A null turn number sorts first; a null
    role or text differs from an empty one.  Each row without a conversation id is a conversation of its own.
    """
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    found = turns.groupBy(F.col(conv).alias("conv_id"), F.when(F.col(conv).isNull(), one).alias("_lone")).agg(F.array_sort(F.collect_set(one)).alias("_turns"))
    hashed = [lambda t, i, seed=seed: F.xxhash64(F.lit(seed), i, t["role"].isNull(), t["role"], t["text"].isNull(), t["text"]) for seed in _SEEDS]
    piece = lambda t: template(F.coalesce(t["role"], F.lit("unknown")), F.coalesce(t["text"], F.lit("")))
    return materialise(
        found.select(
            F.monotonically_increasing_id().alias("_row"),
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("_turns", piece), "").alias("rendered"),
            F.transform("_turns", lambda t, i: F.struct(*[h(t, i).alias(f"h{k}") for k, h in enumerate(hashed)])).alias("_hashes"),
        ),
        "conversations",
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """``_row`` of the conversations that are neither a proper prefix of another nor a copy of one with a smaller id; ids come before null."""
    points = conversations.select("_row", "conv_id", "n_turns", F.posexplode("_hashes").alias("pos", "h"))
    so_far = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = [F.bit_xor(F.col("h")[f"h{k}"]).over(so_far).alias(f"h{k}") for k in range(len(_SEEDS))]
    points = materialise(points.select("_row", "conv_id", "n_turns", (F.col("pos") + 1).cast("long").alias("at"), *rolling), "prefix-hashes")
    first = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "_row")).alias("first")
    whole = points.where("at = n_turns").groupBy("h0", "h1", "at").agg(first)
    prefixes = points.where("at < n_turns").select("h0", "h1", "at").distinct()
    return whole.join(prefixes, ["h0", "h1", "at"], "left_anti").select("first._row")


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Callable[[Column, Column], Column] = chatml_turn,
) -> DataFrame:
    """Render maximal conversations: ``conv_id, n_turns, n_chars, rendered``.

    A null role is rendered as ``unknown`` and a null text as an empty one.  Rows without a
    conversation id are conversations of one turn, that collapse like others.  An empty table gives an empty result.
    """
    conversations = gather_conversations(turns, conv, turn, role, text, template)
    kept = by_ids(conversations, maximal_conversations(conversations), "left_semi", "_row")
    return kept.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), "rendered")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN {'n': turn, 'r': role, 't': text} END AS lone FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS turns, count(*) AS n_turns,
        row_number() OVER (ORDER BY conv_id NULLS LAST, lone) AS k,
        string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
            ORDER BY turn, role, text) AS rendered
      FROM t GROUP BY conv_id, lone)
SELECT conv_id, n_turns, rendered, length(rendered) AS n_chars FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND b.k <> a.k
    AND b.turns[1:a.n_turns] = a.turns AND (b.n_turns > a.n_turns OR b.k < a.k))
"""
