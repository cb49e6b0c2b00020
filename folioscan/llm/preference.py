"""Preference formatting with DataFrame functions only.

A pair is a chosen and a rejected conversation, each an ordered list of turns. The longest common
prefix of turns (equal role and equal text) is rendered once as the prompt; what follows it on
either side is rendered as that side's completion. A completion's mask marks the characters that
train: text and end mark of assistant turns, not their headers and no other role. When one side's
turns are a prefix of the other's, or both are equal, its completion is empty.

A mask is given as half-open character ranges of the completion, ``begin-end`` joined by commas,
and as the number of characters that train.

Defined cases: turns are ordered by turn, then role and text; a null turn comes first, a null role
is rendered as ``unknown`` and a null text as an empty one; repeated rows are turns of their own;
a conversation may have any number of turns, and a turn a text of any length; rows with a null conv_id
take no part; an empty table gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Fixed marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
#: Turns whose places are summed up together.
BLOCK = 64


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> in order."""
    one = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(one))
    plain = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.filter("conv_id is not null").groupBy("conv_id").agg(plain.alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns two lists share: the first place where they differ."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))  # a missing turn equals none
    place = F.array_position(same, False)
    return F.when(place > 0, place - 1).otherwise(F.size(same)).cast("int")


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often a lambda inside reads it."""
    return F.get(F.transform(F.array(value), use), 0)


RANGES = "array<struct<begin:int,end:int>>"


def _block_ranges(sizes: Column) -> Column:
    """Of a few turns: struct<at, ranges>, the characters that they take and the ranges that train."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(RANGES).alias("ranges"))

    def add(done, s):
        begin = done["at"] + s["head"]
        end = begin + s["body"]
        own = F.when(s["trains"], F.array(F.struct(begin.alias("begin"), end.alias("end")))).otherwise(F.array().cast(RANGES))
        return F.struct(end.alias("at"), F.concat(done["ranges"], own).alias("ranges"))

    return F.aggregate(sizes, empty, add)


def trained_ranges(turns: Column) -> Column:
    """array<struct<begin, end>> of the rendered turns' characters that train.

    Turns go in blocks of ``BLOCK``, whose places are summed up apart, so that a long conversation
    does not copy its whole list at each turn.
    """
    sizes = F.transform(turns, lambda t: F.struct((t["role"] == TRAINED).alias("trains"), F.length(_header(t)).alias("head"), F.length(_body(t)).alias("body")))

    def blocks(sizes):
        last = F.floor((F.size(sizes) - 1) / BLOCK).cast("int")
        return F.when(F.size(sizes) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: _block_ranges(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))))

    def placed(done):
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(done, none, lambda s, d: F.struct((s["at"] + d["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        shifted = F.zip_with(done, starts, lambda d, at: F.transform(d["ranges"], lambda r: F.struct((r["begin"] + at).alias("begin"), (r["end"] + at).alias("end"))))
        return F.coalesce(F.flatten(shifted), F.array().cast(RANGES))

    return _bound(_bound(sizes, blocks), placed)


def format_pairs(pairs: DataFrame) -> DataFrame:
    """The columns of ``pairs`` without chosen and rejected (arrays of turns), with prompt, completions and masks.

    A column of ``pairs`` that is named as an output is replaced.
    """
    outputs = ["n_shared", "prompt", *(f"{side}_{what}" for side in ("chosen", "rejected") for what in ("completion", "mask", "trained"))]
    own = [c for c in pairs.columns if c not in ("chosen", "rejected", *outputs)]
    shared, *rests = fresh(pairs.columns, "shared", "chosen_rest", "rejected_rest")
    ranges = fresh([*pairs.columns, shared, *rests], "chosen_ranges", "rejected_ranges")
    parts = pairs.withColumn(shared, common_prefix(F.col("chosen"), F.col("rejected")))
    parts = parts.select(*own, shared, render(F.slice("chosen", F.lit(1), F.col(shared))).alias("prompt"), *(F.slice(side, F.col(shared) + 1, F.size(side)).alias(rest) for side, rest in zip(("chosen", "rejected"), rests, strict=True)))
    parts = parts.withColumns({name: trained_ranges(F.col(rest)) for name, rest in zip(ranges, rests, strict=True)})
    out = [*own, F.col(shared).alias("n_shared"), "prompt"]
    for side, rest, name in zip(("chosen", "rejected"), rests, ranges, strict=True):
        out += [
            render(F.col(rest)).alias(f"{side}_completion"),
            F.array_join(F.transform(name, lambda r: F.concat_ws("-", r["begin"].cast("string"), r["end"].cast("string"))), ",").alias(f"{side}_mask"),
            F.aggregate(name, F.lit(0), lambda n, r: n + r["end"] - r["begin"]).alias(f"{side}_trained"),
        ]
    return parts.select(out)


def swapped_replies(turns: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: each conversation against itself with another one's last reply.

    The other is the neighbour 2k + 1 of conversation 2k, and the other way round. The last
    assistant turn is replaced and the turns behind it are dropped; without a reply of its own,
    or without a neighbour that has one, the conversation stops before its reply.
    """
    talks = conversations_of(turns)
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull())
    talks = talks.withColumn("last", F.array_max(places))
    reply = F.get("turns", F.col("last"))
    other = talks.filter("last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.array(reply).alias("reply"))
    both = talks.join(other, "conv_id", "left")
    before = F.slice("turns", F.lit(1), F.coalesce("last", F.size("turns")))
    kind = "array<struct<role:string,text:string>>"
    rejected = F.when(F.col("last").isNotNull() & F.col("reply").isNotNull(), F.concat(before, "reply")).otherwise(before)
    return both.select("conv_id", F.col("turns").cast(kind).alias("chosen"), rejected.cast(kind).alias("rejected"))


def op6_preference_pairs(turns: DataFrame) -> DataFrame:
    return format_pairs(swapped_replies(turns))


ORACLE = r"""
WITH talks AS (
  SELECT conv_id, list({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), lasts AS (
  SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last FROM talks
), sides AS (
  SELECT a.conv_id, a.turns AS chosen,
         CASE WHEN a.last IS NOT NULL AND b.last IS NOT NULL THEN list_concat(a.turns[1:a.last - 1], [b.turns[b.last]])
              WHEN a.last IS NOT NULL THEN a.turns[1:a.last - 1] ELSE a.turns END AS rejected
  FROM lasts a LEFT JOIN lasts b ON b.conv_id = xor(a.conv_id, 1)
), shared AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] <> rejected[i])) - 1, least(len(chosen), len(rejected))) AS n FROM sides
), parts AS (
  SELECT conv_id, n, chosen[1:n] AS p, chosen[n + 1:len(chosen)] AS c, rejected[n + 1:len(rejected)] AS r FROM shared
), turns AS (
  SELECT conv_id, side, i, t.role AS role, '<|im_start|>' || t.role || chr(10) AS head, t.text || '<|im_end|>' || chr(10) AS body
  FROM (
    SELECT conv_id, 'p' AS side, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM parts
    UNION ALL SELECT conv_id, 'c', unnest(c), generate_subscripts(c, 1) FROM parts
    UNION ALL SELECT conv_id, 'r', unnest(r), generate_subscripts(r, 1) FROM parts)
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side ORDER BY i) - length(body) AS begin_ FROM turns
), rendered AS (
  SELECT conv_id, side, string_agg(head || body, '' ORDER BY i) AS body,
         coalesce(string_agg(begin_::BIGINT || '-' || (begin_ + length(body))::BIGINT, ',' ORDER BY i) FILTER (role = 'assistant'), '') AS mask,
         coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::INTEGER AS trained
  FROM placed GROUP BY conv_id, side
)
SELECT s.conv_id, s.n::INTEGER AS n_shared, coalesce(p.body, '') AS prompt,
       coalesce(c.body, '') AS chosen_completion, coalesce(c.mask, '') AS chosen_mask, coalesce(c.trained, 0) AS chosen_trained,
       coalesce(r.body, '') AS rejected_completion, coalesce(r.mask, '') AS rejected_mask, coalesce(r.trained, 0) AS rejected_trained
FROM parts s
LEFT JOIN rendered p ON p.conv_id = s.conv_id AND p.side = 'p'
LEFT JOIN rendered c ON c.conv_id = s.conv_id AND c.side = 'c'
LEFT JOIN rendered r ON r.conv_id = s.conv_id AND r.side = 'r'
"""
