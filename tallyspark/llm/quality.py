"""Quality rules as a bitmask ledger.

Each rule is evaluated once over every whole text; the ledger keeps the measurements and one failure bit a rule.
Policies are versioned masks over those bits, so that a verdict, another policy's verdict and every ablation follow
from the ledger by bitwise operations, without the texts.

Nulls: a null text has no words, so it fails the rule for few words. Very long texts are measured whole, each in one piece. Repeated rows
are judged each. An empty table gives an empty ledger. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_letter_words")
LEDGER_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

SYMBOLS = C.byte_table(b"#*$%&|<>")
MARKS = C.byte_table(b"!")
NOT_NEWLINE = ~C.byte_table(b"\n")

#: (name, failure as a condition on the measurements); a rule's place is its bit, so rules are only ever appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "2 * n_marks > n_words"),
    ("few_letter_words", "10 * n_letter_words < 7 * n_words"),
)
#: Versioned policies: the rules that each applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
}


def mask_of(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of each text."""
    data, offsets = C.utf8(texts)
    found = C.words(data, offsets, C.NOT_SPACE)
    starts, ends, of_doc, mask = found
    codes, distinct = C.coded(C.word_array(data, found))
    n_words = np.diff(of_doc)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    repeats = np.zeros(len(codes), bool)
    if len(codes) >= 3:
        u = len(distinct)
        key = codes[:-2] * u + codes[1:-1]
        if u**3 >= 2**63:
            key = np.unique(key, return_inverse=True)[1]
        key = key * u + codes[2:]
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        order, same = C.repeated(key[whole], doc[whole])
        twice = same.copy()
        twice[:-1] |= same[1:]
        window = np.zeros(len(codes), bool)
        window[whole[order[twice]]] = True
        repeats |= window
        repeats[1:] |= window[:-1]
        repeats[2:] |= window[:-2]
    lines = C.words(data, offsets, NOT_NEWLINE)
    line_codes, _ = C.coded(C.word_array(data, lines))
    line_doc = np.repeat(np.arange(len(n_words)), np.diff(lines[2]))
    filled = np.searchsorted(starts, lines[0]) < np.searchsorted(starts, lines[1])
    order, same = C.repeated(line_codes, line_doc)
    again = np.zeros(len(line_codes), bool)
    again[order[same]] = True
    lettered = np.asarray(pc.match_substring_regex(distinct.cast(pa.large_string()), r"\p{L}")).astype(bool) if len(distinct) else np.zeros(0, bool)
    letters = lettered[codes]
    return {
        "n_words": n_words,
        "word_chars": C.count_true(mask & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": C.count_true(SYMBOLS[data], offsets),
        "n_dup_lines": C.count_true(again & filled, lines[2]),
        "n_repeat_words": C.count_true(repeats, of_doc),
        "n_lines": C.count_true(filled, lines[2]),
        "n_marks": C.count_true(MARKS[data], offsets),
        "n_letter_words": C.count_true(letters, of_doc),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`, the failure bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in C.pieces(batch, "text"):
                got = measure(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LEDGER_SCHEMA)
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def passes(policy: str) -> Column:
    """Verdict of a policy on a ledger's row."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0


def patterns(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger folded to the distinct failure patterns under a policy, at most 2 to the number of rules, with their counts."""
    return rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask_of(policy))).alias("bits")).agg(F.count("*").alias("n"))


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_only (rows that fail this rule alone) and n_kept_without (rows kept when it is taken out of the policy)."""
    mask = mask_of(policy)
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    total = [
        F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(f"{name}:{what}")
        for name, bit in rules
        for what, condition in (("failed", F.col("bits").bitwiseAND(F.lit(bit)) != 0), ("only", F.col("bits") == bit), ("without", F.col("bits").bitwiseAND(F.lit(mask & ~bit)) == 0))
    ]
    wide = patterns(rows, policy).agg(*total)
    parts = [F.struct(F.lit(name).alias("rule"), *(F.coalesce(F.col(f"`{name}:{w}`"), F.lit(0)).alias(c) for w, c in (("failed", "n_failed"), ("only", "n_only"), ("without", "n_kept_without")))) for name, _ in rules]
    return wide.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from the stored ledger. `rescued_by` is the rule without which the row would be kept, and n_rescued how many rows the
    ablation of that rule keeps; the ablation has a row a rule, so it is broadcast."""
    rows = C.staged(ledger(C.table(spark, sf_dir, "documents")), "ledger")
    mask = mask_of("v1")
    rescued = F
    for i, (name, _) in enumerate(RULES):
        rescued = rescued.when(F.col("failed").bitwiseAND(F.lit(mask)) == 1 << i, F.lit(name))
    gains = ablation(rows, "v1").select(F.col("rule").alias("rescued_by"), F.col("n_only").alias("n_rescued"))
    return rows.withColumn("rescued_by", rescued).join(F.broadcast(gains), "rescued_by", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), (passes("base") & passes("v1")).alias("kept"), "failed", "rescued_by", "n_rescued"
    )


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM d)),
windows AS (SELECT *, count(*) OVER (PARTITION BY id, w, w2, w3) AS n FROM (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY id ORDER BY pos))),
flagged AS (SELECT *, n > 1 AND w3 IS NOT NULL AS f FROM windows),
spread AS (SELECT *, f OR coalesce(lag(f, 1) OVER o, false) OR coalesce(lag(f, 2) OVER o, false) AS twice FROM flagged WINDOW o AS (PARTITION BY id ORDER BY pos)),
by_word AS (SELECT id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, count(*) FILTER (WHERE twice) AS n_repeat_words, count(*) FILTER (WHERE regexp_matches(w, '\p{L}')) AS n_letter_words FROM spread GROUP BY id),
lines AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT id, string_split(text, chr(10)) AS l FROM d)),
by_line AS (SELECT id, count(*) AS n_lines, count(*) FILTER (WHERE k > 1) AS n_dup_lines FROM (SELECT *, row_number() OVER (PARTITION BY id, line ORDER BY pos) AS k FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')) GROUP BY id),
m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks, coalesce(n_letter_words, 0) AS n_letter_words
  FROM d LEFT JOIN by_word USING (id) LEFT JOIN by_line USING (id)),
told AS (
  SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines, word_chars < 2 * n_words, word_chars > 20 * n_words, 2 * n_marks > n_words, 10 * n_letter_words < 7 * n_words] AS fails FROM m),
bits AS (
  SELECT *, CAST(list_sum(list_transform(generate_series(1, 8), lambda i: CASE WHEN fails[i] THEN 1 << (i - 1) ELSE 0 END)) AS INTEGER) AS failed,
         CASE WHEN len(list_filter(fails, lambda x: x)) = 1 THEN ['few_words', 'repeated_words', 'many_symbols', 'repeated_lines', 'short_words', 'long_words', 'shouting', 'few_letter_words'][list_position(fails, true)] END AS rescued_by FROM told)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] OR fails[2] AS base_failed, failed = 0 AS kept, failed, rescued_by, CASE WHEN rescued_by IS NOT NULL THEN count(*) OVER (PARTITION BY rescued_by) END AS n_rescued FROM bits
"""
