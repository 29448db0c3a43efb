"""Quality rules as weak supervision: each rule votes good, bad or abstains; expectation-maximisation over the counts of
vote patterns estimates how often each rule is right on good and on bad documents, and the posterior probability of
being good decides.

Patterns are at most 3^rules, whatever the number of documents: their counts are what the driver sees and what is sent
back. Words are runs of anything but U+0020 and U+0009-000D. Null text has no words; it fails the base rule. Repeated
rows are judged each for itself; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_LETTERS = _UPPER + _LOWER + bytes(range(128, 256))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts", "n_stops", "n_marks", "n_plain")


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """How many words lie in a window of words that occurs twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    if len(place) == len(words):
        return 0
    key = ids[:n]
    for i in range(1, window):  # renumbered each time, so the product can't overflow
        key = np.unique(key, return_inverse=True)[1] * np.int64(len(place)) + ids[i : n + i] if i > 1 else key * np.int64(len(place)) + ids[i : n + i]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[again + i] = True
    return int(covered.sum())


_PLAIN = re.compile(rb"[A-Za-z\x80-\xff]+[.,;:?!]?").fullmatch


class _Plain(dict):
    """Whether a word is letters with at most one mark at its end, and not in capitals; kept by word, up to a bound."""

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = bool(_PLAIN(word)) and not (len(word) > 3 and word.isupper())
        return found


_plain = _Plain()


def measures(raw: bytes) -> tuple[int, ...]:
    """The FEATURES of a text."""
    words = raw.split()
    solid = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(solid.decode())
    return (
        len(words), chars, sum(map(raw.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        len(solid) - len(solid.translate(None, _UPPER)), len(solid) - len(solid.translate(None, _LOWER)), raw.count(b"!"), raw.count(b".") + raw.count(b",") + raw.count(b"?"),
        len(solid.translate(None, _LETTERS)), sum(map(_plain.__getitem__, words)),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1):
        columns = zip(*map(measures, common.byte_values(batch.column(1))), strict=True)
        yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in columns)], ["id", *FEATURES])


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, FEATURES) of each row."""
    kind = common.ddl(docs.schema[key].dataType)
    return docs.select(F.col(key), F.col(text)).transform(common.in_arrow, _measured, f"id {kind}, " + ", ".join(f"{x} long" for x in FEATURES)).withColumnRenamed("id", key)


@dataclass(frozen=True)
class Rule:
    """Votes bad where a measure lies outside [bad_below, bad_above], good where it lies within ``good``; else it abstains,
    also where the measure is null. A rule without ``good`` only ever votes bad: it detects one fault, and its absence
    says nothing."""

    name: str
    measure: Column
    bad_below: float
    bad_above: float
    good: tuple[float, float] | None = None

    def vote(self) -> Column:
        bad = F.when((self.measure < self.bad_below) | (self.measure > self.bad_above), -1)
        return (bad.when(self.measure.between(*self.good), 1) if self.good else bad).otherwise(0)


def _share(part: str, of: Column) -> Column:
    return F.try_divide(F.col(part).cast("double"), of.cast("double"))


def default_rules() -> list[Rule]:
    words, most = F.col("n_words"), float("inf")
    return [
        Rule("symbols", _share("n_symbols", words), 0, 0.1, (0, 0.02)),
        Rule("plain_words", _share("n_plain", words), 0.7, 1, (0.9, 1)),
        Rule("marks", _share("n_marks", F.col("word_chars")), 0, 0.12, (0, 0.06)),
        Rule("word_length", _share("word_chars", words), 2.5, 12),
        Rule("capitals", _share("n_upper", F.col("n_upper") + F.col("n_lower")), 0, 0.3),
        Rule("shouts", _share("n_shouts", words), 0, 0.15),
        Rule("repeated_lines", F.when(F.col("n_lines") >= 3, _share("n_dup_lines", F.col("n_lines"))), 0, 0.3),
        Rule("repeated_words", F.when(words >= 20, _share("n_repeat_words", words)), 0, 0.3),
        Rule("stops", F.when(words >= 20, _share("n_stops", words)), 0.03, most, (0.06, most)),
    ]


@dataclass
class Estimate:
    """P(good), and for each rule how often it is right on good and on bad documents where it votes."""

    prior: float
    right: np.ndarray  # rules x (bad, good)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) of vote patterns (patterns x rules of 1, -1, 0)."""
        bad, good = np.log(self.right[:, 0]), np.log(self.right[:, 1])
        wrong_bad, wrong_good = np.log1p(-self.right[:, 0]), np.log1p(-self.right[:, 1])
        yes, no = votes == 1, votes == -1
        odds = np.log(self.prior) - np.log1p(-self.prior) + yes @ (good - wrong_bad) + no @ (wrong_good - bad)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def expectation_maximisation(votes: np.ndarray, times: np.ndarray, rounds: int = 200, start: float = 0.8, smoothing: float = 1.0) -> Estimate:
    """Over distinct vote patterns and how often each occurs. Rules start as right with probability ``start``; counts are
    smoothed by ``smoothing`` at that rate, and a rule is right at least half the time, so good and bad can't swap."""
    now = Estimate(start, np.full((votes.shape[1], 2), start))
    for _ in range(rounds if len(times) else 0):
        good = now.posterior(votes) * times
        bad = times - good
        right = np.empty_like(now.right)
        for side, weight, vote in ((0, bad, -1), (1, good, 1)):
            agree, cast = weight @ (votes == vote), weight @ (votes != 0)
            right[:, side] = np.clip((agree + start * smoothing) / (cast + smoothing), 0.5, 1 - 1e-6)
        then = Estimate(float(np.clip(good.sum() / times.sum(), 1e-6, 1 - 1e-6)), right)
        moved = np.abs(then.right - now.right).max()
        now = then
        if moved < 1e-9:
            break
    return now


def estimated(measured: DataFrame, rules: list[Rule]) -> tuple[DataFrame, Estimate]:
    """measured plus ``quality`` (posterior probability of being good), and the estimate."""
    spark = measured.sparkSession
    votes = F.array(*(r.vote().cast("int") for r in rules))
    patterns = measured.groupBy(votes.alias("votes")).count().orderBy("votes").collect()  # 3^rules rows at most
    table = np.array([r.votes for r in patterns], np.int64).reshape(len(patterns), len(rules))
    found = expectation_maximisation(table, np.array([r["count"] for r in patterns], np.float64))
    rows = [(p.votes, float(q)) for p, q in zip(patterns, found.posterior(table), strict=True)]
    posterior = spark.createDataFrame(rows, "pattern array<int>, quality double")
    return measured.join(F.broadcast(posterior), votes == F.col("pattern"), "left").drop("pattern"), found


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """(key, FEATURES, base_failed, quality, kept) of each row."""
    measured = common.stored(features(docs, key, text), "features")
    scored, _ = estimated(measured, rules or default_rules())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least))
