"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the classes of a clause's words. Insult and threat
mark their words and add the weights of their arcs, target remembers that
someone is spoken of, negation and reported speech weaken what follows them.
Their product is one automaton whose output is the kind of each matched clause.
A clause is worth the weights of its arcs times the factor of its kind, and a
document's score is a logistic function of what its matched clauses are worth:
words outside a matched clause, and how many there are, don't count, and a
clause that is repeated counts once. The insult
transducer's words and word beginnings, the weights of the threat arcs, the
factors and the logistic function are learned from labelled rows; the function
words and the threat words themselves are given.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetloom.llm.common import materialised
from octetloom.session import spread

#: Labelled rows that the model is fitted on, at most: those with the least hash of doc_id.
SAMPLE_ROWS = 12_000
#: Log-likelihood ratio that a word must reach, about one false word in a million.
LEAST_RATIO, LEAST_PRECISION = 25.0, 0.5
LEAST_GROUPS = 3
BEGINNINGS = (3, 4, 5, 6, 7, 8)
SIGNATURE = 16
#: Weight of an arc at most, and how many groups of rows a threat arc's given weight counts for beside what the labels say.
MOST_WEIGHT = 6.0
THREAT_WEIGHT, THREAT_GROUPS = 6.0, 20

# Function words and verbs of the given transducers, by language (en, fr, de, es).
TARGET = """you your yours yourself yourselves he him his himself she her hers herself they them their theirs themselves this these those who
tu toi te ton ta tes vous votre vos lui elle eux leur leurs ceux
du dich dir dein deine deinen ihr euch euer eure er ihn ihm sie ihnen
tú ti te tus usted ustedes vosotros vuestro vuestra él ella ellos ellas""".split()
NEGATION = """not no never nor neither none nobody nothing without cannot can't isn't aren't wasn't weren't don't doesn't didn't won't wouldn't shouldn't hardly
ne pas jamais non ni aucun aucune rien sans
nicht kein keine keinen keiner nie niemals nichts ohne weder
nunca jamás tampoco ningún ninguna nadie nada sin""".split()
REPORT = """said says say saying quoted quotes quote called calls wrote writes told tells claimed claims reported reports alleged alleges according heard
dit disait disent écrit raconte selon prétend cite
sagte sagt sagten schrieb schreibt behauptet behauptete zitiert laut
dijo dice dicen escribió escribe afirmó según cita""".split()
THREAT = """kill killing murder hurt harm destroy stab shoot strangle beat punch punish burn crush break hunt bury smash slaughter attack
tuer tuerai frapper frapperai égorger détruire brûler écraser massacrer
töten umbringen schlagen erschießen verbrennen vernichten verletzen
matar mataré golpear golpearé destruir quemar aplastar apuñalar""".split()

OTHER, INSULT, THREATEN, SPOKEN, NEGATE, SAY = range(6)
KINDS = ("plain", "aimed", "negated", "reported", "threat")
#: What a clause of each kind may be worth beside a plain one: the first is given, the others may be learned. Whatever is learned, aimed is above plain and plain above negated and reported.
FACTORS = ((1.0,), (1.5, 1.25, 2.0), (0.25, 0.0, 0.5), (0.25, 0.0, 0.5), (1.5, 1.25, 2.0))
#: Training rows that must show a kind before its factor is learned.
LEAST_SHOWN = 20


@dataclass
class Transducer:
    """States numbered from 0; ``step[state][word class]`` is the next state and ``out[state]`` what it says of the clause."""

    step: list[list[int]]
    out: list[tuple]

    def compose(self, other: Transducer) -> Transducer:
        """Both at once, over the pairs of states that can be reached together."""
        at, todo, step, out = {(0, 0): 0}, [(0, 0)], [], []
        for a, b in todo:
            row = []
            for c in range(6):
                pair = (self.step[a][c], other.step[b][c])
                if pair not in at:
                    at[pair] = len(at)
                    todo.append(pair)
                row.append(at[pair])
            step.append(row)
            out.append(self.out[a] + other.out[b])
        return Transducer(step, out)


def _seen(*classes: int) -> Transducer:
    """Whether a word of these classes has come."""
    return Transducer([[int(c in classes) for c in range(6)], [1] * 6], [(False,), (True,)])


def _before(first: int, within: int, then: tuple[int, ...]) -> Transducer:
    """Whether a word of ``then`` came within ``within`` words after one of class ``first``, and none outside that reach."""
    idle, hit, bare = 0, within + 1, within + 2
    step = [[1 if c == first else bare if c in then else 0 for c in range(6)]]
    for left in range(1, within + 1):
        step.append([1 if c == first else hit if c in then else (left + 1 if left < within else idle) for c in range(6)])
    step += [[hit] * 6, [bare] * 6]
    return Transducer(step, [(False,)] * (within + 1) + [(True,), (False,)])


GRAMMAR = _seen(INSULT).compose(_seen(THREATEN)).compose(_seen(SPOKEN)).compose(_before(NEGATE, 3, (INSULT, THREATEN))).compose(_before(SAY, 8, (INSULT, THREATEN)))


def _kind(insult: bool, threat: bool, target: bool, negated: bool, reported: bool) -> int:
    if not insult and not (threat and target):
        return -1
    if reported:
        return 3
    if negated:
        return 2
    return (1 if target else 0) if insult else 4


_KIND_OF = [_kind(*o) for o in GRAMMAR.out]
_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_END = re.compile(r"[.!?;\n]")


@dataclass
class Model:
    """Weights of the insult words, of word beginnings and of threat words, factors of the kinds, and bias and slope of the score."""

    whole: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREAT, THREAT_WEIGHT))
    factors: tuple[float, ...] = tuple(f[0] for f in FACTORS)
    bias: float = -20.0
    slope: float = 0.0
    _classes: dict[str, int] = field(default_factory=dict, repr=False, compare=False)

    def read(self, word: str) -> tuple[int, float]:
        """The class of a word and the weight of its arc: of the insult entries that fit, the heaviest."""
        if not self._classes:
            for c, ws in ((SPOKEN, TARGET), (NEGATE, NEGATION), (SAY, REPORT)):
                self._classes.update(dict.fromkeys(ws, c))
        w = max(self.whole.get(word, 0.0), *(self.starts.get(word[:k], 0.0) for k in BEGINNINGS if k < len(word)), 0.0)
        if w:
            return INSULT, w
        if word in self.threats:
            return THREATEN, self.threats[word]
        return self._classes.get(word, OTHER), 0.0

    def automaton(self):
        """Finds where an insult or threat may begin."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in {*self.whole, *self.starts, *self.threats}:
            a.add_word(w, len(w))
        a.make_automaton()
        return a

    def held(self, text: str | None, automaton) -> list[float]:
        """The arc weights of a document's matched clauses, summed by kind; a clause that comes again word for word counts once."""
        held, before = [0.0] * len(KINDS), set()
        low = (text or "").lower()
        spots = [end - n + 1 for end, n in automaton.iter(low)] if len(automaton) else []
        spots = [s for s in spots if not s or not low[s - 1].isalpha()]
        if spots:
            ends, last = [m.start() for m in _END.finditer(low)], -1
            for s in sorted(spots):
                clause = bisect_right(ends, s)
                if clause == last:
                    continue
                last, state, weight = clause, 0, 0.0
                words = tuple(_WORD.findall(low, ends[clause - 1] + 1 if clause else 0, ends[clause] if clause < len(ends) else len(low)))
                for w in words:
                    c, arc = self.read(w)
                    state, weight = GRAMMAR.step[state][c], weight + arc
                if _KIND_OF[state] >= 0 and words not in before:
                    before.add(words)
                    held[_KIND_OF[state]] += weight
        return held

    def score(self, text: str | None, automaton) -> float:
        worth = sum(f * h for f, h in zip(self.factors, self.held(text, automaton)))
        z = self.bias + self.slope * math.log1p(worth)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _features(text: str | None) -> set[str]:
    """The words and word beginnings of a text, marked apart."""
    ws = set(_WORD.findall((text or "").lower()))
    return {*ws, *(f"{w[:k]}*" for w in ws for k in BEGINNINGS if len(w) > k)}


def _signature(text: str | None) -> np.ndarray:
    """Min-hashes of five-word shingles."""
    ws = (text or "").encode().split()
    h = np.array([xxhash.xxh64_intdigest(b" ".join(ws[i : i + 5])) for i in range(max(1, len(ws) - 4))], np.uint64)
    odd = (np.arange(SIGNATURE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.full(SIGNATURE, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 10_000):
        x = h[i : i + 10_000, None] * odd
        out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0))
    return out


def _clusters(signatures: np.ndarray) -> list[int]:
    """A number per row, equal for rows that agree in half of their signature, by chains. Two such rows agree in one of the first nine."""
    root = list(range(len(signatures)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    met: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(signatures):
        near = {j for k in range(SIGNATURE // 2 + 1) for j in met.get((k, int(s[k])), ())}
        if near:
            at = np.array(sorted(near))
            for j in at[(signatures[at] == s).sum(axis=1) * 2 >= SIGNATURE].tolist():
                root[find(j)] = find(i)
        for k in range(SIGNATURE // 2 + 1):
            met.setdefault((k, int(s[k])), []).append(i)
    return [find(i) for i in range(len(signatures))]


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((held != 0) & F.col("toxic").isNotNull())
    train = train.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialised(texts.join(F.broadcast(train), "doc_id").select("text", "toxic").repartition(docs.sparkSession.sparkContext.defaultParallelism))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled rows whose crc32(doc_id) mod 5 is not 0.

    Words and word beginnings count once per group of near copies; those are kept
    whose lean towards toxic rows chance does not explain. A threat word has its
    given weight as so many groups' worth of evidence, to which the labels' own
    are added. Contradicting labels of one document count as toxic; labels without
    a document and documents without a label play no part; null texts have no
    words. Without toxic rows nothing scores over one half. The driver holds the
    signatures of the toxic rows, the words kept and six numbers a row.
    """
    sample = _sample(docs, labels, sample_rows)
    positive, negative = sample.where("toxic > 0").select("text"), sample.where("toxic <= 0").select("text")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_signature(t.as_py()).tobytes() for t in b.column(0)], pa.binary())], ["sig"])

    seen = sorted({bytes(r.sig) for r in positive.mapInArrow(signed, "sig binary").toLocalIterator()})
    n_neg = negative.count()
    if not seen:
        return Model()
    group = dict(zip(seen, _clusters(np.frombuffer(b"".join(seen), np.uint64).reshape(len(seen), SIGNATURE))))
    n_pos = len(set(group.values()))

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                f = list(_features(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array([group[_signature(t.as_py()).tobytes()]] * len(f), pa.int64())], ["name", "grp"])

    def clean_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["name", "n"])

        for b in batches:
            for t in b.column(0):
                counts.update(_features(t.as_py()))
                if len(counts) > 500_000:
                    yield out()
                    counts.clear()
        yield out()

    pos = positive.mapInArrow(toxic_features, "name string, grp long").distinct().groupBy("name").agg(F.count("*").alias("pos"))
    pos = pos.where((F.col("pos") >= LEAST_GROUPS) | F.col("name").isin(THREAT))
    neg = negative.mapInArrow(clean_features, "name string, n long").groupBy("name").agg(F.sum("n").alias("neg"))
    # Log-likelihood ratio of the word's own share of toxic groups against the share overall.
    base = n_pos / max(1, n_pos + n_neg)
    p, n = F.col("pos"), F.col("neg")
    counted = pos.join(neg, "name", "full").select("name", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    share = p / (p + n)
    ratio = 2 * (p * F.log(share / base) + F.when(n > 0, n * F.log((1 - share) / (1 - base))).otherwise(0.0))
    odds = F.log((p + 0.5) / (n + 0.5)) - math.log((n_pos + 0.5) / (n_neg + 0.5))
    counted = counted.withColumn("odds", odds).withColumn("kept", (p >= LEAST_GROUPS) & (share >= LEAST_PRECISION) & (ratio >= LEAST_RATIO) & (F.col("odds") > 0))
    found = counted.where(F.col("kept") | F.col("name").isin(THREAT)).collect()
    threats = dict.fromkeys(THREAT, THREAT_WEIGHT)
    for r in found:
        if r.name in threats:
            there = r.pos + r.neg
            threats[r.name] = max(0.0, (there * r.odds + THREAT_GROUPS * THREAT_WEIGHT) / (there + THREAT_GROUPS))
    weight = {r.name: min(r.odds, MOST_WEIGHT) for r in found if r.kept and r.name not in threats}
    starts = {w for w in weight if w[-1] == "*"}

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0):
                for w in _features(t.as_py()):
                    if w[-1] != "*":
                        rows += [(f, w) for k in BEGINNINGS if len(w) > k and (f := f"{w[:k]}*") in starts]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["name", "word"])

    if starts:
        # A beginning that stands mostly for one word says nothing about others.
        used = positive.mapInArrow(words_of, "name string, word string").groupBy("name", "word").count().groupBy("name").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
        starts = {r.name for r in used.where("2 * most <= all").collect()}
    model = Model({w: x for w, x in weight.items() if w[-1] != "*"}, {w[:-1]: weight[w] for w in starts}, threats)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.held(t.as_py(), automaton) for t in b.column(0)], pa.list_(pa.float64())), b.column(1)], ["held", "toxic"])

    table = sorted((list(r.held), int(r.toxic > 0)) for r in sample.mapInArrow(read, "held array<double>, toxic int").toLocalIterator())
    x, y = np.array([h for h, _ in table]), np.array([t for _, t in table], float)
    model.factors, model.bias, model.slope = weighed(x, y)
    return model


def weighed(held: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float, float]:
    """Factors of the kinds, bias and slope, of the greatest penalised likelihood. Kinds that few rows show keep their given factor."""
    choices = [f if (held[:, k] > 0).sum() >= LEAST_SHOWN else f[:1] for k, f in enumerate(FACTORS)]
    best = None
    for factors in product(*choices):
        loss, bias, slope = _logistic(np.log1p(held @ np.array(factors)), y)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, factors, bias, slope)
    return best[1:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Loss, bias and slope (0 at least, held back a little) of a logistic regression, by damped Newton steps over the distinct inputs."""
    values, at = np.unique(x, return_inverse=True)
    n, yes = np.bincount(at).astype(float), np.bincount(at, weights=y)
    w = np.zeros(2)
    design = np.stack([np.ones(len(values)), values], axis=1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (n * p - yes) + np.array([1e-6, ridge]) * w
        hess = (design.T * (n * np.maximum(p * (1 - p), 1e-6))) @ design + np.diag([1e-6, ridge])
        step = np.linalg.solve(hess, grad)
        new = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        new[1] = max(0.0, new[1])
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -40, 40))), 1e-12, 1 - 1e-12)
    loss = -(yes * np.log(p) + (n - yes) * np.log(1 - p)).sum() + ridge * w[1] ** 2 / 2
    return float(loss), float(w[0]), float(w[1])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every document; null and empty texts have no clauses. Repeated rows score alike; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            s = [model.score(t.as_py(), automaton) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, with all their columns.

    Null and empty texts have no clauses and stay as long as the bias is below the
    limit; null and repeated ids make no difference, each row is judged by its own
    text; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py(), automaton) < limit for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document, learned without the held-out fifth."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return scores(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
