"""Quality rules: an ordered decision list learned by sequential covering.

Statistics of each text are threshold-tested by rules. A rule is grown on two
thirds of the labelled rows, test by test, for the greatest gain of information
about low-quality rows, and pruned on the rest while that does not hurt; the
rows it covers leave, and the next rule is learned from what remains. The list
becomes one Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetloom.session import spread

#: Labelled rows that the list is fitted on, at most: those with the least hash of doc_id.
SAMPLE_ROWS = 12_000
MAX_RULES, MAX_TESTS = 12, 4
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_lines", "n_upper", "n_digits", "n_ends", "n_distinct")
#: What rules test: counts, and ratios of counts.
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "ends_per_word": ("n_ends", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
TESTED = ("n_words", "n_symbols", "n_dup_lines", "n_repeat_words", *RATIOS)
_ENDS = ".!?"


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one text; all 0 for null."""
    if not text:
        return (0,) * 11
    raw = text.encode()
    ws = raw.split()
    n = len(ws)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, n)
    repeat = 0
    if n >= 3 and len(number) < n:
        size = len(number)
        w3 = (ids[:-2] * size + ids[1:-1]) * size + ids[2:] if size < 2_000_000 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
        order = np.argsort(w3, kind="stable")
        same = w3[order][1:] == w3[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeat = int(covered.sum())
    blanks = sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    dup, seen = 0, set()
    lines = raw.split(b"\n")
    for line in lines:
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return (n, len(text) - blanks, sum(map(text.count, SYMBOLS)), dup, repeat, len(text), len(lines), upper, digits, sum(map(text.count, _ENDS)), len(number))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document; a null text has none of anything, other columns are ignored."""
    names = [*COUNTS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = np.array([text_counts(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in data.T)], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def value(name: str) -> Column:
    """A tested value as a column; a ratio to nothing is 0."""
    if name not in RATIOS:
        return F.col(name).cast("double")
    a, b = RATIOS[name]
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    limit: float

    def on(self, x: np.ndarray) -> np.ndarray:
        v = x[:, TESTED.index(self.name)]
        return v > self.limit if self.above else v <= self.limit

    def column(self) -> Column:
        return value(self.name) > self.limit if self.above else value(self.name) <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:g}"


def _covers(rule: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.on(x)
    return out


def _best_test(x: np.ndarray, y: np.ndarray) -> Test | None:
    """The test with the greatest gain: low rows kept times the rise of the log share of low rows."""
    p, n = y.sum(), len(y)
    best, gain = None, 1e-9
    before = np.log2(p / n)
    for j, name in enumerate(TESTED):
        order = np.argsort(x[:, j], kind="stable")
        v, low = x[order, j], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        below_p, below_n = low[cuts], cuts + 1
        for above, pp, nn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(pp > 0, pp * (np.log2(pp / nn) - before), -1.0)
            i = int(np.argmax(g))
            if g[i] > gain:
                best, gain = Test(name, above, float((v[cuts[i]] + v[cuts[i] + 1]) / 2)), g[i]
    return best


def learn(x: np.ndarray, low: np.ndarray) -> list[tuple[Test, ...]]:
    """Rules for low-quality rows, in order; rows must come in an order that is free of meaning."""
    rules: list[tuple[Test, ...]] = []
    grow = np.arange(len(x)) % 3 > 0
    x, low = x.astype(float), low.astype(bool)
    while len(rules) < MAX_RULES and low[grow].sum() >= 3:
        rule: tuple[Test, ...] = ()
        gx, gy = x[grow], low[grow]
        while len(rule) < MAX_TESTS and not gy.all():
            test = _best_test(gx, gy)
            if test is None:
                break
            rule += (test,)
            on = test.on(gx)
            gx, gy = gx[on], gy[on]
        px, py = x[~grow], low[~grow]

        def worth(r: tuple[Test, ...]) -> float:
            on = _covers(r, px)
            p, n = py[on].sum(), (~py[on]).sum()
            return (p - n) / (p + n + 1)

        while len(rule) > 1:
            scores = [worth(rule[:k]) for k in range(1, len(rule) + 1)]
            k = int(np.argmax(scores)) + 1
            if k == len(rule):
                break
            rule = rule[:k]
        on = _covers(rule, x)
        if not rule or low[on].mean() < 0.75 or low[on].sum() < 3:
            break
        rules.append(rule)
        x, low, grow = x[~on], low[~on], grow[~on]
    return rules


def verdict(rules: list[tuple[Test, ...]]) -> Column:
    """True for documents that no rule rejects, as one ordered conditional."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Test, ...]]:
    """Rules from at most ``sample_rows`` labelled rows.

    Contradicting labels of one document count as low; labels without a document
    and null labels play no part; without labels there are no rules.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL AND doc_id IS NOT NULL")
    some = some.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    rows = statistics(known).join(F.broadcast(some), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", *(value(n).alias(n) for n in TESTED), "quality")
    data = sorted(tuple(r) for r in rows.toLocalIterator())
    if not data:
        return []
    return learn(np.array([r[2:-1] for r in data]), np.array([r[-1] <= 0 for r in data]))


def judged(docs: DataFrame, rules: list[tuple[Test, ...]]) -> DataFrame:
    """The counts of every document with base_failed and kept.

    A null or empty text has no words and fails the base; repeated rows are judged
    alike; an empty table gives an empty result.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judged(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", *COUNTS, "base_failed", "kept")
