"""Quality rules by weak supervision.

Each rule looks at one side of a text and votes good, bad, or abstains. Nobody knows how reliable the rules are:
expectation-maximisation estimates each rule's accuracy and the share of good documents from how the votes of all
documents agree, and a document is judged by its posterior probability of being good, instead of having to pass every rule.

The votes of all documents enter as counts of vote patterns (at most 3 to the number of rules, whatever the input), so
the estimation itself runs on the driver over a table of bounded size. Features are computed row by row in Arrow batches, once, and written;
nothing but the pattern counts is shuffled, combined on the map side.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.llm.shared import SLICE, name, numbered, place, written

#: Frequent short words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with his they at be this have from or had by "
    "le la les de des et un une du en que qui dans pour pas sur est au avec "
    "der die das und ist von den mit ein eine zu im nicht auf sich dem des für "
    "el los las del y por con una para se no es al lo como más"
).split()

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_SPACE = " \t\n\v\f\r"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_plain_words")


def features(text: str) -> tuple[int, ...]:
    """The counts in FEATURES of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(distinct := Counter(windows)) < len(windows):
        reach = 0
        for i, window in enumerate(windows):
            if distinct[window] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return (
        n,
        len(text) - sum(map(text.count, _SPACE)),
        len(_SYMBOLS.findall(text)),
        len(lines) - len({*lines}),
        repeated,
        len(lines),
        sum(map(_STOPS.__contains__, data.lower().split())),
        sum(1 for w in words if w.strip(b".,;:!?'\"()-").isalpha() or not w.isascii() and not _SYMBOLS.search(w.decode("utf-8", "surrogatepass"))),
    )


@F.arrow_udf(T.StructType([T.StructField(f, T.LongType(), False) for f in FEATURES]))
def _features(texts: pa.Array) -> pa.Array:
    rows = [features(t or "") for i in range(0, len(texts), SLICE) for t in texts.slice(i, SLICE).to_pylist()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in FEATURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(FEATURES))


@dataclass(frozen=True)
class Rule:
    """A rule by label: bad and good are SQL conditions on the features; where neither holds, it abstains."""

    label: str
    bad: str
    good: str


#: The rules in production.
RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("word length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars between 3.5 * n_words and 8 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("repeated lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    Rule("repeated words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words and n_words > 2"),
    Rule("stop words", "50 * n_stop_words < n_words", "12 * n_stop_words >= n_words"),
    Rule("plain words", "10 * n_plain_words < 8 * n_words", "100 * n_plain_words >= 95 * n_words"),
)

#: The estimation's prior, as votes of so many imagined documents: shares of bad, abstaining and good votes by class, and the share of good documents.
PRIOR_DOCS, PRIOR_BAD, PRIOR_GOOD, PRIOR_SHARE = 20.0, (0.4, 0.2, 0.4), (0.03, 0.12, 0.85), 0.8
ROUNDS = 200


@dataclass(frozen=True)
class VoteModel:
    """The share of good documents, and for each rule the chance of a bad, abstaining and good vote on bad and on good documents."""

    share: float
    bad: tuple[tuple[float, float, float], ...]
    good: tuple[tuple[float, float, float], ...]

    def weight(self, rule: int, vote: int) -> float:
        return math.log(self.good[rule][vote + 1] / self.bad[rule][vote + 1])

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.share / (1 - self.share)) + sum(self.weight(k, v) for k, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def estimate(patterns: dict[tuple[int, ...], int], rules: int) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts. With no documents the prior stands."""
    model = VoteModel(PRIOR_SHARE, (PRIOR_BAD,) * rules, (PRIOR_GOOD,) * rules)
    ordered = sorted(patterns.items())
    for _ in range(ROUNDS):
        good, weight = PRIOR_DOCS * PRIOR_SHARE, PRIOR_DOCS
        table = {c: [[p * PRIOR_DOCS for p in prior] for _ in range(rules)] for c, prior in ((0, PRIOR_BAD), (1, PRIOR_GOOD))}
        for votes, n in ordered:
            q = model.posterior(votes)
            good, weight = good + n * q, weight + n
            for k, v in enumerate(votes):
                table[1][k][v + 1] += n * q
                table[0][k][v + 1] += n * (1 - q)
        rates = {c: tuple(tuple(x / sum(row) for x in row) for row in rows) for c, rows in table.items()}
        new = VoteModel(good / weight, rates[0], rates[1])
        moved = max(abs(a - b) for x, y in ((model.bad, new.bad), (model.good, new.good)) for r, s in zip(x, y, strict=True) for a, b in zip(r, s, strict=True))
        model = new
        if moved < 1e-9:
            break
    return model


def _votes(rules: tuple[Rule, ...]) -> list[Column]:
    return [F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END") for r in rules]


def fit(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> VoteModel:
    """The model of the votes on all rows of docs."""
    return _fitted(docs.select(_features(name(text_column).cast("string")).alias("f")).select("f.*"), rules)


def _fitted(counted: DataFrame, rules: tuple[Rule, ...]) -> VoteModel:
    """The model of the votes on rows of features."""
    counts = counted.groupBy(*[v.alias(f"v{k}") for k, v in enumerate(_votes(rules))]).count()
    return estimate({tuple(r[:-1]): r[-1] for r in counts.collect()}, len(rules))


def _posterior(model: VoteModel, rules: tuple[Rule, ...]) -> Column:
    odds = F.lit(math.log(model.share / (1 - model.share)))
    for k, r in enumerate(rules):
        odds += F.expr(f"CASE WHEN {r.bad} THEN {model.weight(k, -1)!r}D WHEN {r.good} THEN {model.weight(k, 1)!r}D ELSE {model.weight(k, 0)!r}D END")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


_BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: doc_id, the features, base_failed, p_good and kept.

    kept is false where the base rules fail, else whether the posterior is at least one half. Null and empty texts have no
    words and fail. Texts of any length are read whole; rows that repeat are judged alike; other columns are not read; an empty
    table gives no rows.
    """
    rows = docs.select(name(id_column).alias("doc_id"), _features(name(text_column).cast("string")).alias("f")).select("doc_id", "f.*")
    rows = written(rows, "quality")
    rows = rows.withColumns({"base_failed": F.expr(_BASE_FAILED), "p_good": _posterior(_fitted(rows, rules), rules)})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def drop_bad(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that `judge` keeps: null, empty and short texts go, repeated rows are judged alike.

    Columns of any name are kept as they are; texts of any length are read whole; an empty table stays empty. Documents are written once
    beside their features, so that texts are judged in one pass, before the model is known.
    """
    plain = numbered(docs)
    rows = written(plain.withColumn("f", _features(place(docs, text_column).cast("string"))).select(*plain.columns, "f.*"), "judged")
    return rows.where(~F.expr(_BASE_FAILED) & (_posterior(_fitted(rows, rules), rules) >= 0.5)).select(*plain.columns).toDF(*docs.columns)
