"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document: its measurements are stored and its verdict becomes one bit of
``failed``. Policies are versions of a set of rules; applying one is a bitwise and, and ablations (what would a policy
keep without this rule, what does this rule alone remove) are sums over the few distinct masks, counted before any
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, batch, text_bytes, words_of

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
#: ASCII that is neither a letter nor white space.
_OTHER = bytes(b for b in range(128) if not chr(b).isalpha() and b not in _SPACE)

#: Measurements of a text, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_alpha_words")

#: Rule by bit: name and SQL condition of a failure over the measurements, in whole numbers.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols_per_word", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines"),
    ("mean_word_short", "10 * word_chars < 25 * n_words"),
    ("mean_word_long", "word_chars > 15 * n_words"),
    ("bullet_lines", "n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "n_lines >= 4 AND 10 * n_ellipsis_lines > 3 * n_lines"),
    ("few_alpha_words", "10 * n_alpha_words < 6 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
V1 = Policy("v1", tuple(BIT))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measure(data: bytes) -> tuple[int, ...]:
    words = words_of(data)
    inside = data.translate(None, _SPACE)
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    alpha = len(words_of(data.translate(None, _OTHER)))
    return (
        len(words),
        len(inside) if inside.isascii() else len(inside.decode("utf-8", "replace")),
        len(inside) - len(inside.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        sum(x.lstrip(_SPACE)[:1] in (b"-", b"*") or x.lstrip(_SPACE).startswith("•".encode()) for x in lines),
        sum(x.rstrip(_SPACE).endswith((b"...", "…".encode())) for x in lines),
        alpha,
    )


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])


def _measured(batches: Batches) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        own = [measure(t) for t in text_bytes(rows)]
        columns = list(zip(*own)) if own else [[] for _ in MEASURES]
        yield batch(_SCHEMA, [rows.column(0), *map(list, columns)])


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: a bit for each rule of RULES that the document fails.

    A null text is an empty one and fails too_few_words; a null id stays null; repeated rows are measured again; other
    columns are neither read nor returned; an empty table gives an empty ledger. Narrow: no shuffle.
    """
    slim = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    found = slim.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"CASE WHEN {rule} THEN {BIT[name]}L ELSE 0L END" for name, rule in RULES)
    return found.withColumn("failed", F.expr(bits))


def apply_policy(found: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    return found.withColumn(column, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(found: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    The ledger is first counted by mask (at most 2^rules rows, combined before the shuffle)."""
    masks = found.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules)))
    each = masks.select("mask", "n", rules.alias("r"))
    hit = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("mask").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return each.groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g, i
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM
        (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
             CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines,
             CAST(len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS BIGINT) AS n_alpha_words
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
f AS (SELECT *, @FAILED@ AS failed FROM m)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept FROM f
""".replace("@FAILED@", " + ".join(f"CASE WHEN {rule} THEN CAST({BIT[name]} AS BIGINT) ELSE CAST(0 AS BIGINT) END" for name, rule in RULES))
