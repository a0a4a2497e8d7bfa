"""Quality rules with risk-controlled cutoffs (operator 9).

Each rule measures one share of a text and has a fixed grid of cutoffs, lenient to strict.  In every stratum (language)
labelled documents of good quality are the holdout.  All rules walk their grids together along one path of joint cutoffs,
which the labelled bad documents alone lay down: a rule moves on where that rejects bad ones that the cutoffs so far let
pass.  A step of the path is certified while the exact binomial test still refutes that its rules together reject more
than ``risk`` of good documents, at level ``alpha / strata``.  The path rejects more at each step and is walked to the
first failure, so no further correction is due along it, and over all strata the family-wise error is at most ``alpha``; a
stratum loses at most ``risk`` of its good documents.  The certified step that rejects most labelled bad documents is
taken; rules that haven't moved there are off.

A stratum needs ln(alpha / strata) / ln(1 - risk) good labels past the base rule for cutoffs that reject none of them (437
of 4 strata at the defaults), more if they do reject some; below that all its rules are off and only the base rule rejects.

Defined cases: a null text has no words and fails the base rule; a null language is a stratum of its own; a label that
is null or not 0/1 is ignored, and of contradicting labels for one id the good one counts; without enough labels only the
base rule rejects; repeated rows are judged alike; an empty table gives no rows; further columns are
ignored or kept, whatever their names; a text is measured whole, however long.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, release, slices, unused

# fixed values of the base rule
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED = 50, 50


@dataclass(frozen=True)
class Rule:
    """Rejects where ``sign * measure > sign * cutoff``; ``grid`` goes from lenient to strict."""

    name: str
    over: str
    under: str
    sign: int
    grid: tuple[float, ...]


RULES = (
    Rule("long_words", "word_chars", "n_words", 1, (40.0, 30.0, 24.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0)),
    Rule("short_words", "word_chars", "n_words", -1, (1.2, 1.5, 1.8, 2.0, 2.2, 2.4, 2.6, 2.8, 3.0, 3.2, 3.4, 3.6)),
    Rule("symbols", "n_symbols", "word_chars", 1, (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("repeated_words", "n_repeat_words", "n_words", 1, (0.48, 0.45, 0.42, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rows of cutoffs up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_STRATA = 10_000


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """FEATURES of one text; n_lines counts lines that have a word."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0  # positions below it are counted already
        for i, x in enumerate(windows):
            if times[x] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text_col: str = "text") -> DataFrame:
    """``keep`` columns and FEATURES of every whole text."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            got = zip(*map(measure, b.column(text_col).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in got)], [*keep, *FEATURES])

    return arrow(docs.select(*keep, text_col), kernel, f"{kinds}, {', '.join(f'{c} long' for c in FEATURES)}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def share(rule: Rule) -> Column:
    """The rule's measure; 0 / 0 counts as 0."""
    return F.when(F.col(rule.under) > 0, F.col(rule.over) / F.col(rule.under)).otherwise(F.lit(0.0))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exact up to rounding; k at or below the mean sums downwards from its largest term."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0 - binomial_cdf(n - k - 1, n, 1.0 - p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / (n - i + 1) * (1.0 - p) / p
        i -= 1
    return min(1.0, total)


def certify(good: list[int], bad: list[int], risk: float, level: float) -> int:
    """Index of the cutoff to use, or -1.  good[j], bad[j]: labelled rows that cutoff j rejects and no more lenient one does; the last entry: rows that none rejects."""
    n, k, caught, best, most = sum(good), 0, 0, -1, 0
    for j in range(len(good) - 1):
        k, caught = k + good[j], caught + bad[j]
        if n == 0 or binomial_cdf(k, n, risk) > level:
            break
        if caught > most:
            best, most = j, caught
    return best


def joint_path(bad: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, ...]]:
    """Joint cutoffs, lenient to strict: per step and rule an index of its grid, -1 for off.  bad: (how many cutoffs of each rule's grid let a row pass, rows)."""
    at, left, path = [-1] * len(RULES), list(bad), []
    for j in range(max(len(r.grid) for r in RULES)):
        for i, r in enumerate(RULES):
            if j < len(r.grid) and any(steps[i] <= j for steps, _ in left):
                at[i] = j
                left = [x for x in left if x[0][i] > j]
                path.append(tuple(at))
    return path


def certified(good: list[tuple[tuple[int, ...], int]], bad: list[tuple[tuple[int, ...], int]], risk: float, level: float) -> tuple[int, ...]:
    """Index of the cutoff to use for each rule, or -1."""
    path = joint_path(bad)
    split = [[0] * (len(path) + 1), [0] * (len(path) + 1)]
    for k, rows in enumerate((good, bad)):
        for steps, n in rows:
            split[k][next((j for j, at in enumerate(path) if any(x <= y for x, y in zip(steps, at))), len(path))] += n
    j = certify(*split, risk, level)
    return path[j] if j >= 0 else (-1,) * len(RULES)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.01, alpha: float = 0.05, stratum: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(stratum, one cutoff per rule or null), from all labelled rows of ``measured``."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").cast("int").alias("_good"))
    seen = measured.filter(~base_failed()).join(known, F.col(id_col) == F.col("_id"))
    names = [r.name for r in RULES]
    # how many cutoffs of the grid let the row pass, lenient ones first
    steps = [sum((F.when(r.sign * share(r) > r.sign * F.lit(c), 0).otherwise(1) for c in r.grid), F.lit(0)).alias(f"_step_{r.name}") for r in RULES]
    counts = cut(seen.select(stratum, "_good", *steps).groupBy(stratum, "_good", *(f"_step_{n}" for n in names)).agg(F.count("*").alias("n")), "label_counts")
    strata = max(1, counts.select(stratum).distinct().count())
    kind = measured.schema[stratum].dataType.simpleString()

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        rows: tuple[list, list] = ([], [])
        for good, *at, n in own[["_good", *(f"_step_{x}" for x in names), "n"]].itertuples(index=False):
            rows[int(good)].append((tuple(map(int, at)), int(n)))
        found = certified(rows[1], rows[0], risk, alpha / strata)
        row = {stratum: own[stratum].iloc[0]} | {r.name: r.grid[j] if j >= 0 else None for r, j in zip(RULES, found)}
        return pd.DataFrame([row], columns=[stratum, *names]).astype(dict.fromkeys(names, "float64"))

    # a group has two rows at most for each combination of the grids' steps, whatever the input
    return counts.groupBy(stratum).applyInPandas(choose, f"`{stratum}` {kind}, {', '.join(f'{n} double' for n in names)}")


def with_cutoffs(rows: DataFrame, chosen: DataFrame, stratum: str = "lang", named: str | None = None) -> tuple[DataFrame, list[str]]:
    """``rows`` with the cutoffs of their stratum (``named`` in ``chosen``), and the names of those columns in the order of RULES."""
    of, *cuts = unused(rows, "_stratum", *(f"_cut_{r.name}" for r in RULES))
    held = chosen.select(F.col(named or stratum).alias(of), *(F.col(r.name).alias(c) for r, c in zip(RULES, cuts)))
    if held.count() <= BROADCAST_STRATA:
        held = F.broadcast(held)
    return rows.join(held, F.col(stratum).eqNullSafe(F.col(of)), "left").drop(of), cuts


def passes(cuts: list[str]) -> Column:
    """The verdict where FEATURES and the cutoffs are at hand; a null cutoff rejects nothing."""
    ok = ~base_failed()
    for r, name in zip(RULES, cuts):
        # a share that is a float in one engine and here is compared with NaN-free doubles only
        c = F.col(name)
        ok = ok & ~F.coalesce((r.sign * share(r) > r.sign * c) & ~F.isnan(c), F.lit(False))
    return ok


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.01, alpha: float = 0.05, id_col: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """Per document: base counts, base_failed and kept."""
    measured = cut(features(docs, (id_col, stratum)), "features")
    chosen = cut(cutoffs(measured, labels, risk, alpha, stratum, id_col), "cutoffs")
    rows, cuts = with_cutoffs(measured, chosen, stratum)
    return rows.select(id_col, *FEATURES[:5], base_failed().alias("base_failed"), passes(cuts).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, risk: float = 0.01, alpha: float = 0.05, id_col: str = "doc_id", stratum: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are.  Texts aren't shuffled: a second pass measures them again."""
    measured = cut(features(docs, (id_col, stratum)), "features")
    chosen = cut(cutoffs(measured, labels, risk, alpha, stratum, id_col), "cutoffs")
    release(measured)
    # columns go to Python by number: their names may have dots or backticks
    names = [f"_{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    rows, cuts = with_cutoffs(plain, chosen.withColumnRenamed(stratum, "_of"), names[docs.columns.index(stratum)], "_of")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)

    def rejected(m: dict[str, int], limits: tuple) -> bool:
        if m["n_words"] < LEAST_WORDS or 100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"]:
            return True
        for r, c in zip(RULES, limits):
            if c is not None and c == c and r.sign * (m[r.over] / m[r.under] if m[r.under] else 0.0) > r.sign * c:
                return True
        return False

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            limits = zip(*(b.column(c).to_pylist() for c in cuts))
            mask = [not rejected(dict(zip(FEATURES, measure(t))), x) for t, x in zip(b.column(text).to_pylist(), limits)]
            yield b.select(names).filter(pa.array(mask, pa.bool_()))

    return arrow(rows, kernel, schema).toDF(*docs.columns)
