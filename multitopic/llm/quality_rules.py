"""Quality rules combined by weak supervision instead of all-must-pass.

Every rule reads a few counts of a whole text and votes good, votes bad or
abstains; a rule about one defect votes bad where it sees it and abstains
elsewhere, since texts without this defect can have others. No rule is trusted
as such: expectation-maximisation over the votes of all documents estimates how
often each rule's votes are right, and a document is kept where its posterior
probability of being good reaches ``keep``.

The documents enter the estimation through their vote patterns only: Spark
counts the rows of each pattern (partially aggregated; at most 3^rules rows
whatever the input, all of them used), and the rounds run over these counts.
The posterior is then a sum of one log ratio per vote, computed in the plan.
Accuracies start at ``START`` and carry ``PRIOR`` pseudo-votes, so a rule that
hardly votes stays near its start, and never fall under one half, so good and
bad cannot change places. The share of good texts before any vote is a
parameter (``share``): were it estimated along, documents that one rule alone
speaks against would follow the majority.

The counts are those of the text as it is (no lower-casing): words are
``[^\\x20\\x09-\\x0D]+``, lines are split at \\n. A document fails outright
(``base_failed``) with under 20 words, or when over 30 % of its words stand in
8-word windows found twice or more in it.

Defined results: null, empty and wordless texts have zero counts, all rules
abstain and base_failed holds; rows are worked off one by one, so repeated and
null ids and equal rows each give a row; an empty table gives an empty result;
further columns are ignored (``keep_quality`` returns them as they were,
whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .text import CASED, NON_SPACE, Slice, slices, words

WINDOW = 8
ROUNDS = 25
START = 0.8
PRIOR = 10.0
SHARE = 0.5
KEEP = 0.5


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the counts; a rule whose conditions both fail abstains."""

    name: str
    bad: str
    good: str = "FALSE"


#: Thresholds are plain ratios of the counts, as web-text filters use them.
RULES = (
    Rule("plain_words", bad="10 * n_plain_words < 6 * n_words", good="10 * n_plain_words >= 9 * n_words"),
    Rule("marks", bad="10 * n_marks >= 8 * n_words", good="100 * n_marks >= 3 * n_words AND 10 * n_marks <= 3 * n_words"),
    Rule("word_length", bad="word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("symbols", bad="10 * n_symbols >= n_words"),
    Rule("letters", bad="10 * n_letter_words < 8 * n_words"),
    Rule("capitals", bad="n_letters >= 50 AND 100 * n_capitals > 30 * n_letters"),
    Rule("line_copies", bad="n_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", bad="10 * n_repeat_words > 2 * n_words"),
)

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_letter_words", "n_plain_words", "n_letters", "n_capitals", "n_marks", "n_lines",
)


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL = _bytes("#*$%&|<>")
_CAPITAL = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ASCII = _CAPITAL | _bytes("abcdefghijklmnopqrstuvwxyz")
_LETTER = _ASCII.copy()
_LETTER[0x80:] = True
_MARK = _bytes("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN = _LETTER | _bytes("'-")
_STOP = _bytes(".,;:!?")


def _upto(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def _repeated(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For every element the number of elements of its row with its key."""
    order = np.lexsort((key, row))
    new = np.append(True, (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    out = np.empty(len(row), dtype=np.int64)
    size = np.diff(first, append=len(row))
    out[order] = np.repeat(size, size)
    return out


def text_counts(s: Slice) -> list[np.ndarray]:
    """``COUNTS`` of every row of a slice."""
    w = words(s, NON_SPACE, CASED)
    data, offs, n = s.data, s.offs, len(s.offs) - 1
    per = lambda total: total[offs[1:]] - total[offs[:-1]]
    inside = NON_SPACE[data]
    n_words = np.diff(w.rows)
    word_row = np.repeat(np.arange(n), n_words)
    letters = _upto(_LETTER[data])
    letter_words = np.bincount(word_row[letters[w.end] > letters[w.start]], minlength=n)
    plain = _upto(_PLAIN[data])
    stop = _STOP[data[w.end - 1]] & (w.end - w.start > 1)
    plain_words = np.bincount(word_row[plain[w.end - stop] - plain[w.start] == w.end - stop - w.start], minlength=n)

    # windows of WINDOW words within a row, and the words that repeated ones cover
    at = np.flatnonzero(np.arange(len(w.hash)) + WINDOW <= w.rows[1:][word_row]) if len(w.hash) else np.zeros(0, np.int64)
    key = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + k]
    again = at[_repeated(word_row[at], key) >= 2]
    edge = np.bincount(again, minlength=len(w.hash) + 1) - np.bincount(again + WINDOW, minlength=len(w.hash) + 1)
    covered = np.cumsum(edge)[: len(w.hash)] > 0

    # lines with a word
    newline = np.flatnonzero(data == 10)
    cut = np.sort(np.concatenate([newline, offs[1:]]), kind="stable")
    start = np.sort(np.concatenate([newline + 1, offs[:-1]]), kind="stable")
    kind_row = np.sort(np.concatenate([np.searchsorted(offs, newline, "right") - 1, np.arange(n)]), kind="stable")
    held = _upto(inside)
    full = held[cut] > held[start]
    start, cut, line_row = start[full], cut[full], kind_row[full]
    copies = _repeated(line_row, w.span_hash(start, cut) + (cut - start).astype(np.uint64)) if len(start) else np.zeros(0, np.int64)
    distinct = np.bincount(line_row, weights=1 / copies, minlength=n).round().astype(np.int64) if len(start) else np.zeros(n, np.int64)
    lines = np.bincount(line_row, minlength=n)

    return [
        n_words, per(_upto(inside & ((data & 0xC0) != 0x80))), per(_upto(_SYMBOL[data])), lines - distinct,
        np.bincount(word_row[covered], minlength=n), letter_words, plain_words, per(_upto(_ASCII[data])), per(_upto(_CAPITAL[data])),
        per(_upto(_MARK[data])), lines,
    ]


def count_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``COUNTS`` of its texts."""
    rest = [c for c in docs.columns if c != text]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [text_counts(s) for s in slices(b.column(len(rest)))]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array(c, pa.int64()) for c in columns)], names=[*rest, *COUNTS])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    return docs.select(*rest, text).mapInArrow(counts, ", ".join([*schema, *(f"{c} bigint" for c in COUNTS)]))


def vote(rule: Rule) -> str:
    """SQL of a rule's vote: 1 good, -1 bad, 0 abstains (always under 20 words)."""
    return f"CASE WHEN n_words < 20 THEN 0 WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END"


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts before any vote, and each rule's accuracy."""

    share: float
    accuracy: tuple[float, ...]

    def weights(self) -> list[float]:
        return [math.log(a / (1 - a)) for a in self.accuracy]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(votes @ np.array(self.weights())) - math.log(self.share / (1 - self.share))))

    def column(self, rules: tuple[Rule, ...]):
        """The posterior of a row of counts as a column."""
        odds = F.lit(math.log(self.share / (1 - self.share)))
        for rule, w in zip(rules, self.weights(), strict=True):
            odds = odds + F.expr(vote(rule)) * F.lit(w)
        return 1 / (1 + F.exp(-odds))


def estimate(votes: np.ndarray, rows: np.ndarray, share: float = SHARE, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns (patterns x rules) and the
    number of rows of each."""
    cast = (rows[:, None] * (votes != 0)).sum(0)
    model = LabelModel(share, (START,) * votes.shape[1])
    for _ in range(rounds):
        good = (rows * model.posterior(votes))[:, None]
        right = np.where(votes > 0, good, np.where(votes < 0, rows[:, None] - good, 0)).sum(0)
        model = LabelModel(share, tuple(np.maximum(0.5, (right + START * PRIOR) / (cast + PRIOR)).tolist()))
    return model


def fit(counts: DataFrame, rules: tuple[Rule, ...] = RULES, share: float = SHARE, rounds: int = ROUNDS) -> LabelModel:
    """The label model of all rows of ``counts``."""
    names = [f"v{k}" for k in range(len(rules))]
    voted = counts.select(*(F.expr(vote(r)).alias(c) for r, c in zip(rules, names, strict=True)))
    table = voted.groupBy(*names).count().toArrow()  # at most 3^rules rows
    if not table.num_rows:
        return LabelModel(share, (START,) * len(rules))
    votes = np.stack([table.column(c).to_numpy() for c in names], axis=1)
    order = np.lexsort(votes.T)  # sums in one order whatever the order of the rows
    return estimate(votes[order], table.column("count").to_numpy().astype(float)[order], share, rounds)


def score_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: float = KEEP) -> DataFrame:
    """The other columns of ``docs`` plus ``COUNTS``, ``base_failed``,
    ``p_good`` (posterior, to 6 places) and ``kept``."""
    counts = materialize(count_rows(docs, text), "quality")
    model = fit(counts, rules)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    scored = counts.withColumn("base_failed", failed).withColumn("p_good", F.round(model.column(rules), 6))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))


def keep_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: float = KEEP) -> DataFrame:
    """The kept rows of ``docs`` with their own columns."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return score_quality(rows, "_text", rules, keep).where("kept").select("_row.*")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_quality(docs.select("doc_id", "text"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "p_good")


def _oracle() -> str:
    k = range(len(RULES))
    odds = lambda p: f"ln({SHARE} / (1 - {SHARE})) + " + " + ".join(f"{p}v{j} * ln(a{j} / (1 - a{j}))" for j in k)
    rounds = [f"m0 AS (SELECT {', '.join(f'{START}::DOUBLE AS a{j}' for j in k)})"]
    for t in range(1, ROUNDS + 1):
        new = ", ".join(
            f"greatest(0.5, (coalesce(sum(CASE v{j} WHEN 1 THEN g ELSE n - g END) FILTER (v{j} <> 0), 0) + {START * PRIOR}) / (coalesce(sum(n) FILTER (v{j} <> 0), 0) + {PRIOR})) AS a{j}"
            for j in k
        )
        rounds.append(f"m{t} AS MATERIALIZED (SELECT {new} FROM (SELECT p.*, n / (1 + exp(-({odds('p.')}))) AS g FROM p, m{t - 1}))")
    space = r"[\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS li FROM documents),
win AS (SELECT id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, x) AS c FROM win) WHERE c >= 2),
cov AS (SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(i, i + {WINDOW})) AS place FROM rep) GROUP BY id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(li) - len(list_distinct(li)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_letter_words,
        len(list_filter(w, lambda x: regexp_matches(x, '^[^\x00-\x26\x28-\x2C\x2E-\x40\x5B-\x60\x7B-\x7F]+[.,;:!?]?$'))) AS n_plain_words,
        length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
        length(text) - length(regexp_replace(text, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_marks, len(li) AS n_lines
      FROM d LEFT JOIN cov ON cov.id = d.id),
v AS MATERIALIZED (SELECT *, {', '.join(f'{vote(r)} AS v{j}' for j, r in enumerate(RULES))} FROM c),
p AS MATERIALIZED (SELECT {', '.join(f'v{j}' for j in k)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
{', '.join(rounds)},
s AS (SELECT v.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, round(1 / (1 + exp(-({odds('v.')}))), 6) AS p_good FROM v, m{ROUNDS})
SELECT doc_id, {', '.join(COUNTS[:5])}, base_failed, NOT base_failed AND p_good >= {KEEP} AS kept, p_good FROM s
"""


ORACLE = _oracle()
