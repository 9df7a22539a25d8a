"""Toxicity by a weighted finite-state pattern grammar.

The words of a clause are read as symbols: a word of the lexicon, a listed
threat, one that is both, a person aimed at, a negation, a word of reported
speech, or anything else.  Five transducers rewrite and weigh them: one tags
words of the lexicon as insults, at their log-odds, one tags listed words that
are no insults as threats, at a fixed weight, one gives an insult its full weight only near a
person, half of it elsewhere, and lets threats count only there, one lowers what a negation governs, and one lowers what follows a word
of reported speech.  As a person can stand on either side ("you I will kill",
"kill you"), a pass from the end of the clause first marks what a person
follows; the rest reads from its start.  Each pass is a composition, one table
of states, and the score of a clause is the weight of its accepting path.
Only clauses that hold an
insult or a threat are read; a text's clause scores, not its words, are what a
small logistic model turns into a probability.

The insult lexicon is learned: words and word beginnings with their log-odds
in the labelled texts, less one standard error.  The logistic model is fitted
on each half of the sample read with the lexicon of the other half, so it sees
words as they meet in new texts; the lexicon then used is that of both halves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.kernel import Words, mix, runs, span_hash, words
from tessella.llm.workspace import Workspace

FIT_ROWS = 24_000  # labelled rows that the model is fitted on, at most
LEAST_TEXTS = 3  # toxic texts that must hold a lexicon entry
LEAST_WEIGHT = 1.5
PREFIXES = (4, 5, 6)  # lengths in bytes of the word beginnings that are learned
THREAT_WEIGHT = 4.0
REACH = 4  # words over which a negation or a person has effect

# Closed word classes of the grammar (English, German, French, Spanish).
THREATS = ("kill", "hurt", "destroy", "burn", "shoot", "stab", "murder", "umbringen", "töten", "schlagen", "tuer", "frapper", "matar", "golpear")
PERSONS = ("you", "your", "you're", "yourself", "him", "them", "their", "du", "dich", "dir", "euch", "tu", "toi", "vous", "ustedes", "usted", "ti")
NEGATIONS = ("not", "never", "isn", "aren", "wasn", "don", "doesn", "nicht", "kein", "keine", "niemals", "jamais", "nunca", "ningún")
REPORTS = ("said", "says", "wrote", "called", "quoted", "claimed", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")

OTHER, INSULT, THREAT, PERSON, NEGATION, REPORT = range(6)
AIMED_INSULT, AIMED_THREAT = 6, 7  # with a person among the next REACH words; written by the pass from the end
LEXICAL, LISTED, BOTH = 8, 9, 10  # what a word was found in, not yet tagged: the lexicon, the list of threats, both
SYMBOLS = 11
_U = np.uint64


# ---------------------------------------------------------------- the grammar


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, symbol written, factor); state 0 starts and every state accepts.

    A factor scales the weight of the word just read; the weights of a clause add up.
    """

    arcs: tuple[tuple[tuple[int, int, float], ...], ...]

    def compose(self, other: Transducer) -> Transducer:
        """Reads like this one and hands what it writes on to ``other``."""
        number = {(0, 0): 0}
        todo, arcs = [(0, 0)], []
        while len(arcs) < len(todo):
            a, b = todo[len(arcs)]
            row = []
            for nxt, written, factor in self.arcs[a]:
                to, out, more = other.arcs[b][written]
                if (nxt, to) not in number:
                    number[nxt, to] = len(todo)
                    todo.append((nxt, to))
                row.append((number[nxt, to], out, factor * more))
            arcs.append(tuple(row))
        return Transducer(tuple(arcs))

    @cached_property
    def table(self) -> np.ndarray:
        return np.array(self.arcs, dtype=np.float64)

    def read(self, symbols: Iterable[int]) -> Iterator[tuple[int, float]]:
        """(symbol written, factor) of each symbol."""
        state = 0
        for symbol in symbols:
            state, out, factor = self.arcs[state][symbol]
            yield out, factor


@dataclass(frozen=True)
class Grammar:
    """A pass from the end of a clause and one from its start, which reads what the first wrote."""

    from_end: Transducer
    from_start: Transducer

    def score(self, symbols: list[int], weights: list[float]) -> tuple[float, int]:
        """Weight of a clause and the number of words that count in it."""
        marked = list(self.from_end.read(reversed(symbols)))[::-1]
        total, count = 0.0, 0
        for weight, (_, first), (out, factor) in zip(weights, marked, self.from_start.read(x for x, _ in marked), strict=True):
            if out in (INSULT, THREAT) and first * factor > 0:
                total += weight * first * factor
                count += 1
        return total, count

    def scores(self, symbols: np.ndarray, weights: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 256) -> np.ndarray:
        """Weights of many clauses, each the symbols from begin to end; clauses do not overlap.

        All clauses of at most ``most`` words are read in step; longer ones one by one.
        """
        out = np.zeros(len(begin))
        for k in np.flatnonzero(end - begin > most):
            out[k] = self.score(symbols[begin[k] : end[k]].tolist(), weights[begin[k] : end[k]].tolist())[0]
        short = np.flatnonzero(end - begin <= most)
        short = short[np.argsort(begin[short] - end[short], kind="stable")]
        a, b = begin[short], end[short]
        symbols, factor = symbols.copy(), np.ones(len(symbols))
        for machine, first, step in ((self.from_end, b - 1, -1), (self.from_start, a, 1)):
            state = np.zeros(len(a), dtype=np.int64)
            left = b - a
            for k in range(int(left[0]) if len(left) else 0):
                n = int(np.searchsorted(-left, -k, side="left"))  # clauses of more than k words
                at = first[:n] + step * k
                arc = machine.table[state[:n], symbols[at]]
                state[:n], symbols[at] = arc[:, 0].astype(np.int64), arc[:, 1].astype(np.int64)
                factor[at] *= arc[:, 2]
        value = np.where((symbols == INSULT) | (symbols == THREAT), weights * factor, 0.0)
        sums = np.concatenate(([0.0], np.cumsum(value)))
        out[short] = sums[b] - sums[a]
        return np.where(out > 1e-9, out, 0.0)


def _machine(states: int, rule) -> Transducer:
    return Transducer(tuple(tuple(rule(state, symbol) for symbol in range(SYMBOLS)) for state in range(states)))


def grammar(reach: int = REACH, *, aimed: float = 1.0, lone: float = 0.5, stray: float = 0.0, negated: float = 0.6, reported: float = 0.7) -> Grammar:
    """The composition of the five transducers; that of persons has a half in each pass."""
    insult = _machine(1, lambda s, x: (0, INSULT if x in (LEXICAL, BOTH) else x, 1.0))
    threat = _machine(1, lambda s, x: (0, THREAT, THREAT_WEIGHT) if x == LISTED else (0, x, 1.0))

    def person_after(s, x):
        near = reach if x == PERSON else max(0, s - 1)
        return near, {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}.get(x, x) if s else x, 1.0

    def person(s, x):
        near = reach if x == PERSON else max(0, s - 1)
        factor = {INSULT: aimed if s else lone, THREAT: 1.0 if s else stray, AIMED_INSULT: aimed}.get(x, 1.0)
        return near, {AIMED_INSULT: INSULT, AIMED_THREAT: THREAT}.get(x, x), factor

    def negation(s, x):
        return (reach if x == NEGATION else max(0, s - 1)), x, (negated if s and x in (INSULT, THREAT) else 1.0)

    def report(s, x):
        return (1 if s or x == REPORT else 0), x, (reported if s and x in (INSULT, THREAT) else 1.0)

    from_end = insult.compose(threat).compose(_machine(reach + 1, person_after))
    return Grammar(from_end, _machine(reach + 1, person).compose(_machine(reach + 1, negation)).compose(_machine(2, report)))


#: The same reader without the grammar: every listed or learned word counts in full, wherever it stands.
WORDS_ONLY = grammar(lone=1.0, stray=1.0, negated=1.0, reported=1.0)


# ---------------------------------------------------------------- words to symbols


def _word_hash(word: str) -> int:
    w = words(np.frombuffer(word.encode(), dtype=np.uint8), np.array([0, len(word.encode())]))
    return int(w.hash[0])


def _beginnings(w: Words, which: np.ndarray | slice = slice(None)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of PREFIXES: the longer words among ``which`` and the hash of their beginning."""
    start, end = w.start[which], w.end[which]
    for size in PREFIXES:
        long = np.flatnonzero(end - start > size)
        yield long, mix(span_hash(w.sums, start[long], start[long] + size) + _U(size))


class Lexicon:
    """Weights by hash, with a bit table in front."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.room = np.zeros(1 << self.BITS, dtype=bool)
        self.room[self._low(hashes)] = True

    def _low(self, h: np.ndarray) -> np.ndarray:
        return (h & _U((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, weights) of the entries found."""
        maybe = np.flatnonzero(self.room[self._low(h)])
        if not len(self.hashes) or not len(maybe):
            return maybe[:0], self.weights[:0]
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        return maybe[hit], self.weights[at[hit]]


_CLASSES = {LISTED: THREATS, PERSON: PERSONS, NEGATION: NEGATIONS, REPORT: REPORTS}
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".!?;\n"]] = True
FEATURES = 5


class Reader:
    """Turns texts into the features of their clauses."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, machine: Grammar | None = None):
        self.insults = Lexicon(hashes, weights)
        listed = [(_word_hash(x), kind) for kind, list_ in _CLASSES.items() for x in list_ if "'" not in x]
        self.classes = Lexicon(np.array([h for h, _ in listed], dtype=np.uint64), np.array([float(k) for _, k in listed]))
        self.machine = machine or grammar()

    def features(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text: largest and second clause score, log of all scores, log of clauses, log of different words."""
        w = words(buf, offsets)
        out = np.zeros((len(offsets) - 1, FEATURES))
        weight = np.zeros(len(w.hash))
        at, found = self.insults.find(w.hash)
        weight[at] = found
        for long, h in _beginnings(w):
            at, found = self.insults.find(h)
            np.maximum.at(weight, long[at], found)
        symbol = np.zeros(len(w.hash), dtype=np.int64)
        at, kind = self.classes.find(w.hash)
        symbol[at] = kind.astype(np.int64)
        symbol[weight > 0] = np.where(symbol[weight > 0] == LISTED, BOTH, LEXICAL)
        weight[symbol == LISTED] = 1.0
        marks = np.flatnonzero(symbol >= LEXICAL)
        if not len(marks):
            return out
        cuts = np.flatnonzero(_BREAK[buf])
        clause = np.searchsorted(cuts, w.start)
        text = np.searchsorted(w.first, marks, side="right") - 1
        # The clause of a mark, within its text.
        lo = np.maximum(np.searchsorted(clause, clause[marks], side="left"), w.first[text])
        hi = np.minimum(np.searchsorted(clause, clause[marks], side="right"), w.first[text + 1])
        clauses = np.unique(np.column_stack((lo, hi, text)), axis=0)
        totals = self.machine.scores(symbol, weight, clauses[:, 0], clauses[:, 1])
        clauses, totals = clauses[totals > 0, 2], totals[totals > 0]
        order = np.lexsort((-totals, clauses))
        t, totals = clauses[order], totals[order]
        head = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else t
        out[t[head], 0] = totals[head]
        second = head[np.diff(np.concatenate((head, [len(t)]))) > 1] + 1
        out[t[second], 1] = totals[second]
        out[:, 2] = np.log1p(np.bincount(t, totals, len(out)))
        out[:, 3] = np.log1p(np.bincount(t, minlength=len(out)))
        different = np.unique(np.column_stack((text.astype(np.uint64), w.hash[marks])), axis=0)[:, 0].astype(np.int64)
        out[:, 4] = np.log1p(np.bincount(different, minlength=len(out))) * (out[:, 3] > 0)
        return out


# ---------------------------------------------------------------- fitting


def held_out() -> Column:
    """Rows whose labels are never learned from; a row without an id is none."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token hash, half of the sample, toxic texts, other texts) of each batch."""
    for batch in batches:
        toxic, side = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        for a, b, buf, offs in runs(batch.column(0)):
            w = words(buf, offs)
            text = np.repeat(np.arange(b - a), np.diff(w.first))
            parts, owners = [w.hash], [text]
            for long, h in _beginnings(w):
                parts.append(h)
                owners.append(text[long])
            once = np.unique(np.column_stack((np.concatenate(parts), np.concatenate(owners).astype(np.uint64))), axis=0)
            owner = once[:, 1].astype(np.int64)
            for half in (0, 1):
                mine = side[a:b][owner] == half
                keys, at = np.unique(once[mine, 0], return_inverse=True)
                label = toxic[a:b][owner[mine]]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), half, dtype=np.int32)), pa.array(np.bincount(at, label == 1, len(keys)).astype(np.int64)), pa.array(np.bincount(at, label != 1, len(keys)).astype(np.int64))], names=["token", "side", "pos", "neg"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Newton's method, each step shortened until it lowers the loss; the first coefficient is the constant and is not shrunk.

    A full step can overshoot where few rows hold much weight, and the next one
    then leads away for good; the loss is convex, so shortened steps cannot.
    """
    x = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(x.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[0] = 1e-6

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * b * b).sum() / 2)

    now = loss(beta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * beta)
        size = 1.0
        while size > 1e-9 and not loss(beta + size * step) < now:
            size /= 2
        if size <= 1e-9:
            break
        beta, before = beta + size * step, now
        now = loss(beta)
        if before - now < 1e-10 * max(1.0, now):
            break
    return beta


@dataclass
class Model:
    """A fitted scorer; its lexicon has no more entries than FIT_ROWS texts have words."""

    hashes: np.ndarray
    weights: np.ndarray
    beta: np.ndarray
    machine: Grammar | None = None

    def reader(self) -> Reader:
        return Reader(self.hashes, self.weights, self.machine)

    def scores(self, reader: Reader, column: pa.Array) -> np.ndarray:
        parts = [reader.features(buf, offs) for _, _, buf, offs in runs(column)]
        x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -30, 30)))


def _features(model_hashes, model_weights, machine=None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model_hashes, model_weights, machine)
        for batch in batches:
            for a, b, buf, offs in runs(batch.column(0)):
                x = reader.features(buf, offs)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *(pa.array(x[:, k]) for k in range(FEATURES))], names=["toxic", *(f"x{k}" for k in range(FEATURES))])

    return rows


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, machine: Grammar | None = None) -> Model:
    """Learns from at most ``rows`` labelled rows, chosen by a hash of their id.

    Rows that ``held_out`` marks, null labels and null ids are left out, and
    equal texts count once.  Without a usable label the model scores every
    text alike, 0.5; with labels of one kind only, near that kind's share.
    ``machine``: another grammar, as for an ablation.
    """
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    side = F.pmod(F.shiftrightunsigned("h", 7), F.lit(2))
    work = Workspace(docs.sparkSession, "toxic")
    texts = work.keep(texts.select("text", "toxic", side.cast("int").alias("side")), "sample")
    counts = {(int(s), int(t)): n for s, t, n in texts.groupBy("side", "toxic").count().collect()}
    total, toxic = sum(counts.values()), counts.get((0, 1), 0) + counts.get((1, 1), 0)
    share = np.log((toxic + 0.5) / (total - toxic + 0.5)) if total else 0.0
    flat = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), np.array([share] + [0.0] * FEATURES))
    if not all(counts.get((s, t)) for s in (0, 1) for t in (0, 1)):
        return flat
    tokens = texts.select("text", "toxic", "side").mapInArrow(_tokens, "token long, side int, pos long, neg long")
    sums = [F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("pos", "neg")]
    tokens = work.keep(tokens.groupBy("token").agg(*sums).na.fill(0).where(F.col("pos0") + F.col("pos1") >= LEAST_TEXTS), "tokens")

    def lexicon(*sides: int) -> tuple[np.ndarray, np.ndarray]:
        pos, neg = (float(sum(counts[s, t] for s in sides)) for t in (1, 0))
        p, n = (sum((F.col(f"{c}{s}") for s in sides[1:]), F.col(f"{c}{sides[0]}")) for c in ("pos", "neg"))
        odds = F.log((p + 0.5) / (pos + 1)) - F.log((n + 0.5) / (neg + 1))
        error = F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        found = tokens.where(p >= LEAST_TEXTS).select("token", (odds - error).alias("w")).where(F.col("w") >= LEAST_WEIGHT).collect()
        return np.array([r[0] for r in found], dtype=np.int64).view(np.uint64), np.array([r[1] for r in found], dtype=np.float64)

    ddl = "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))
    seen = [texts.where(F.col("side") == 1 - s).select("text", "toxic").mapInArrow(_features(*lexicon(s), machine), ddl) for s in (0, 1)]
    seen = seen[0].unionByName(seen[1]).toPandas()
    beta = _logistic(seen[[f"x{k}" for k in range(FEATURES)]].to_numpy(), seen["toxic"].to_numpy(dtype=np.float64))
    return Model(*lexicon(0, 1), beta, machine)


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """doc_id and the score of its text, from 0 to 1; nothing is shuffled.

    Null counts as empty; a text without an insult or threat has the lowest
    score.  Equal texts (repeats, ties) have equal scores, and repeated rows
    each give a row; an empty table gives none.  Very long texts are read
    whole, in one row.  Only ``doc_id`` and the text are read, so further
    columns of any name do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = own.reader()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(reader, batch.column(1)))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col(text)).mapInArrow(rows, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see ``fit`` and ``score`` for nulls, ties, repeats, empty tables and long texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns as they were; nothing is shuffled.

    Nulls, ties, repeats, empty tables and long texts as in ``score``.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        reader = own.reader()
        for batch in batches:
            yield batch.filter(pa.array(own.scores(reader, batch.column(at)) < threshold))

    return docs.mapInArrow(rows, docs.schema)
