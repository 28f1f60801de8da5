"""Preference formatting of chat conversations, in DataFrame operations only.

A pair of conversations, chosen and rejected, shares the longest common prefix of equal turns (role and text). That
prefix is rendered once, as the prompt; what follows it in either conversation is rendered as a completion with its
loss mask: the character spans of the assistants' texts and end marks, which are the only ones to be learned.

A table of conversations has no preferences, so `stale_pairs` makes them: chosen is a conversation, rejected the same conversation in which, from some answer on, every
answer is the one before it over again. Both keep all turns, those behind the last answer too.

Nulls: a turn with a null role is rendered as role "unknown", a null text as an empty one; turns are ordered by number,
then role and text, with null numbers first, and repeated turns are kept. A conversation without a partner, here one of fewer than two answers, gives a row
of status "unpaired" whose other completion is null, whole and unshared. Equal conversations give empty completions and status
"equal". Every turn with a null conversation id is a conversation of its own. Very long texts are rendered whole. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"


TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, in order."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    return whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(a, i) != F.get(b, i)))
    return F.coalesce(F.get(differ, F.lit(0)), F.lit(0))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE))), "")


def loss_spans(turns: Column) -> Column:
    """[first, past) character spans, within the rendered turns, of what is learned: the assistants' texts with their end marks."""
    step = lambda a, t: F.struct(
        (a["at"] + _length(t)).alias("at"),
        F.when(
            t["role"] == "assistant",
            F.concat(a["spans"], F.array(F.struct((a["at"] + _head(t)).alias("first"), (a["at"] + _length(t) - 1).alias("past")))),
        ).otherwise(a["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,past:int>>").alias("spans"))
    return F.aggregate(turns, zero, step)["spans"]


def _head(turn: Column) -> Column:
    return F.char_length(turn["role"]) + len(OPEN) + len(BETWEEN)


def _length(turn: Column) -> Column:
    return _head(turn) + F.char_length(turn["text"]) + len(CLOSE)


def _learned(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["past"] - s["first"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """For pairs (pair_id, chosen and rejected: array<struct<role, text>>, either null): the prompt, both masked
    completions and figures of them."""
    both = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    rest = lambda c: F.when(F.col(c).isNotNull(), F.slice(F.col(c), F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0))))
    cut = pairs.withColumn("n_prefix", F.when(both, common_turns(F.col("chosen"), F.col("rejected"))).otherwise(0))
    cut = cut.withColumns({"prefix": F.slice(F.coalesce("chosen", "rejected"), 1, F.col("n_prefix")), "chosen_rest": rest("chosen"), "rejected_rest": rest("rejected")})
    status = F.when(~both, "unpaired").when((F.size("chosen_rest") == 0) & (F.size("rejected_rest") == 0), "equal").otherwise("pair")
    return cut.select(
        "pair_id", status.alias("status"), F.col("n_prefix").cast("long").alias("n_prefix"), rendered(F.col("prefix")).alias("prompt"),
        *(c for side in ("chosen", "rejected") for c in (rendered(F.col(f"{side}_rest")).alias(side), loss_spans(F.col(f"{side}_rest")).alias(f"{side}_spans"))),
    )


def stale_pairs(talks: DataFrame) -> DataFrame:
    """pair_id, chosen and rejected of conversations (conv_id, turns). The answer at which the two part is dealt by the id, any but the first."""
    is_answer = lambda t: t["role"] == "assistant"
    rows = talks.withColumns({
        "places": F.filter(F.transform("turns", lambda t, i: F.when(is_answer(t), i)), lambda i: i.isNotNull()),
        "answers": F.filter("turns", is_answer),
    })
    # of every turn, the number of answers before and at it: each answer's number, as often as turns stand from it to the next one
    until = F.transform("places", lambda p, k: F.coalesce(F.get("places", k + 1), F.size("turns")) - p)
    rows = rows.withColumn("count", F.concat(F.array_repeat(F.lit(0), F.coalesce(F.get("places", F.lit(0)), F.lit(0))), F.flatten(F.transform(until, lambda n, k: F.array_repeat(k + 1, n)))))
    more = F.size("answers") - 1
    rows = rows.withColumn("parts", F.when(more > 0, F.get("places", (1 + F.pmod(F.coalesce("conv_id", F.lit(0)), F.greatest(more, F.lit(1)))).cast("int"))))
    stale = F.transform("turns", lambda t, i: F.when(is_answer(t) & (i >= F.col("parts")), F.get("answers", F.get("count", i) - 2)).otherwise(t))
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("parts").isNotNull(), stale).alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_pairs(stale_pairs(conversations(C.table(spark, sf_dir, "conversations"))))
    return made.select(
        "pair_id", "status", "n_prefix", "prompt", "chosen", "rejected",
        *(_learned(F.col(f"{s}_spans")).cast("long").alias(f"{s}_learned") for s in ("chosen", "rejected")),
    )


#: The same rows in DuckDB's SQL: the prefix ends before the first turn in which the two conversations differ.
ORACLE = """
WITH t AS (
  SELECT conv_id, k, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE CAST(conv_id AS VARCHAR) END AS k FROM conversations)),
answers AS (
  SELECT k, n, row_number() OVER w AS r, lag(text) OVER w AS before, count(*) OVER (PARTITION BY k) AS m, conv_id
  FROM t WHERE role = 'assistant' WINDOW w AS (PARTITION BY k ORDER BY n)),
parts AS (SELECT k, n AS parts FROM answers WHERE m > 1 AND r = 2 + ((conv_id % (m - 1)) + (m - 1)) % (m - 1)),
both_ AS (
  SELECT t.conv_id, t.k, t.n, t.role, t.text AS chosen, p.parts IS NOT NULL AS paired, CASE WHEN t.n >= p.parts AND t.role = 'assistant' THEN a.before ELSE t.text END AS rejected
  FROM t LEFT JOIN parts p USING (k) LEFT JOIN answers a USING (k, n)),
prefix AS (SELECT k, CASE WHEN bool_or(paired) THEN coalesce(min(n) FILTER (WHERE chosen != rejected) - 1, count(*)) ELSE 0 END AS n_prefix FROM both_ GROUP BY k),
piece AS (
  SELECT b.*, n_prefix, '<|' || role || '|>' || chr(10) || chosen || '<|end|>' || chr(10) AS c, '<|' || role || '|>' || chr(10) || rejected || '<|end|>' || chr(10) AS r
  FROM both_ b JOIN prefix USING (k)),
told AS (
  SELECT any_value(conv_id) AS pair_id, any_value(n_prefix) AS n_prefix, bool_or(paired) AS paired, count(*) AS turns,
         coalesce(string_agg(c, '' ORDER BY n) FILTER (WHERE n <= n_prefix), '') AS prompt,
         coalesce(string_agg(c, '' ORDER BY n) FILTER (WHERE n > n_prefix), '') AS chosen, coalesce(string_agg(r, '' ORDER BY n) FILTER (WHERE n > n_prefix), '') AS rejected,
         CAST(coalesce(sum(length(chosen) + 7) FILTER (WHERE role = 'assistant' AND n > n_prefix), 0) AS BIGINT) AS chosen_learned,
         CAST(coalesce(sum(length(rejected) + 7) FILTER (WHERE role = 'assistant' AND n > n_prefix), 0) AS BIGINT) AS rejected_learned
  FROM piece GROUP BY k)
SELECT pair_id, CASE WHEN NOT paired THEN 'unpaired' WHEN n_prefix = turns THEN 'equal' ELSE 'pair' END AS status, n_prefix, prompt, chosen,
       CASE WHEN paired THEN rejected END AS rejected, chosen_learned, CASE WHEN paired THEN rejected_learned END AS rejected_learned
FROM told
"""
