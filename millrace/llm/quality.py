"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, its measurements are stored.

A policy is a versioned set of bits. Applying one, comparing two or leaving one rule out needs only the stored mask: bit
operations and a count per mask, at most 2^rules rows, whatever the number of documents.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.common import fresh, map_texts, prepare, slices
from millrace.llm.scan import windows, words_of

#: Symbols that n_symbols counts.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MEASUREMENTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks",
    "longest_word",
)

#: Rules in the order of their bits; each is true where a document fails. New rules go to the end, bits are never reused.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "capitals": "n_letters >= 20 AND 100 * n_capitals > 30 * n_letters",
    "exclamation": "n_marks >= 3 AND 100 * n_marks > 10 * n_words",
    "word_length": "n_words >= 10 AND (word_chars > 14 * n_words OR word_chars < 2 * n_words)",
    "endless_word": "longest_word > 1000",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE_RULES = ("few_words", "repeated_windows")

#: Versioned policies: the rules that reject. A policy is never changed, a new version is added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE_RULES,
    "standard-1": (*BASE_RULES, "symbols", "duplicate_lines", "capitals", "exclamation", "endless_word"),
    "strict-1": tuple(RULES),
}
DEFAULT_POLICY = "standard-1"


def measured(texts) -> dict[str, np.ndarray]:
    """MEASUREMENTS of a slice of texts (an Arrow array; null: empty)."""
    words = words_of(texts)
    rows, data, offsets = len(texts), words.data, words.offsets

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    n_words = np.diff(words.first)
    starts_char = (data & 0xC0) != 0x80
    chars_before = np.concatenate([[0], np.cumsum(starts_char, dtype=np.int64)])
    length = chars_before[words.end] - chars_before[words.start]

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[words.first[1:]] - total[words.first[:-1]]

    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.row, length)

    # Words in windows of five that occur twice or more in their text: mark windows, then the words they cover.
    hashes, at = windows(words, 5)
    key = hashes ^ (words.row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words.start) + 6, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + 5, -1)
    covered = np.cumsum(cover)[: len(words.start)] > 0

    n_lines, n_dup_lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for row, text in enumerate(texts.to_pylist()):
        lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r")]
        n_lines[row] = len(lines)
        n_dup_lines[row] = len(lines) - len(set(lines))

    capital = (data >= ord("A")) & (data <= ord("Z"))
    letter = capital | ((data >= ord("a")) & (data <= ord("z")))
    return {
        "n_words": n_words, "word_chars": sums(length), "n_symbols": per_row(SYMBOLS[data]), "n_dup_lines": n_dup_lines,
        "n_repeat_words": sums(covered), "n_lines": n_lines, "n_capitals": per_row(capital), "n_letters": per_row(letter),
        "n_marks": per_row(data == ord("!")), "longest_word": longest,
    }


def failures(rules: Mapping[str, str] = RULES) -> Column:
    """The mask of failed rules, from the measurements."""
    mask = F.lit(0).cast("long")
    for k, condition in enumerate(rules.values()):
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return mask


def ledger(docs: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """doc_id, the measurements and the mask of failed rules for every row, without a shuffle.

    A null or empty text has no words and fails few_words; rows repeat as they come; other columns are left out.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{name} long" for name in MEASUREMENTS)
    found = map_texts(docs, lambda part: {"doc_id": part.column("doc_id"), **measured(part.column("text"))}, schema)
    return found.withColumn("failed", failures(rules))


def bits(names: Sequence[str]) -> int:
    """The mask of a policy given by the names of its rules."""
    return sum(BIT[name] for name in set(names))


def applied(book: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with base_failed and kept (no rule of the policy failed); a base failure is never kept."""
    reject = bits(POLICIES[policy]) | bits(BASE_RULES)
    return book.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(bits(BASE_RULES))) != 0).withColumn(
        "kept", F.col("failed").bitwiseAND(F.lit(reject)) == 0
    )


def ablation(book: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """policy, rule, failed, only_this, kept, kept_without: what each rule of each policy does, from counts per mask.

    failed: documents that fail the rule; only_this: those that no other rule of the policy rejects, which is what
    leaving it out would bring back; kept and kept_without: documents kept with and without the rule.
    """
    spark = book.sparkSession
    pairs = [(p, r, BIT[r], bits(names)) for p, names in policies.items() for r in names]
    rules = spark.createDataFrame(pairs, "policy string, rule string, bit long, reject long")
    masks = book.groupBy("failed").agg(F.count("*").alias("n"))
    # Counts per mask are at most 2^len(RULES) rows, the rules a constant list.
    both = masks.join(F.broadcast(rules), F.lit(True))
    hit = F.col("failed").bitwiseAND(F.col("reject"))
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return both.groupBy("policy", "rule").agg(
        n(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        n(hit == F.col("bit")).alias("only_this"),
        n(hit == 0).alias("kept"),
        n(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )


def quality_stage(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The documents that the policy keeps, all columns as they are. Measured and filtered in one pass, without a join."""
    prepare(docs.sparkSession)
    stem = fresh(docs.columns, "measured_")
    names = {name: stem + name for name in MEASUREMENTS}

    def run(batches):
        for part in slices(batches):
            found = measured(part.column("text"))
            for name in MEASUREMENTS:
                part = part.append_column(names[name], pa.array(found[name], pa.int64()))
            yield part

    schema = StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in names.values())])
    rules = {rule: re.sub(r"\b[a-z_]+\b", lambda m: names.get(m.group(), m.group()), test) for rule, test in RULES.items()}
    reject = bits(POLICIES[policy]) | bits(BASE_RULES)
    book = docs.mapInArrow(run, schema)
    return book.where(failures(rules).bitwiseAND(F.lit(reject)) == 0).drop(*names.values())


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return applied(ledger(table(spark, sf_dir, "documents")))


# n_dup_lines by lines with a word, windows of five words by position: what the scan counts, said in SQL.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
  SELECT doc_id, i, [word, w2, w3, w4, w5] AS w FROM (
    SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4,
           lead(word, 4) OVER o AS w5
    FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE w5 IS NOT NULL
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) AS t(k) GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, max(length(word)) AS longest_word FROM words GROUP BY doc_id
), facts AS (
  SELECT d.doc_id, coalesce(c.n_words, 0)::BIGINT AS n_words, coalesce(c.word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(l.n_lines, 0)::BIGINT AS n_lines,
    length(regexp_replace(coalesce(d.text, ''), '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
    length(regexp_replace(coalesce(d.text, ''), '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
    length(regexp_replace(coalesce(d.text, ''), '[^!]', '', 'g'))::BIGINT AS n_marks,
    coalesce(c.longest_word, 0)::BIGINT AS longest_word
  FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), ledger AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_letters >= 20 AND 100 * n_capitals > 30 * n_letters THEN 16 ELSE 0 END
    + CASE WHEN n_marks >= 3 AND 100 * n_marks > 10 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words >= 10 AND (word_chars > 14 * n_words OR word_chars < 2 * n_words) THEN 64 ELSE 0 END
    + CASE WHEN longest_word > 1000 THEN 128 ELSE 0 END)::BIGINT AS failed FROM facts
)
SELECT *, (failed & 3) <> 0 AS base_failed, (failed & 191) = 0 AS kept FROM ledger
"""
