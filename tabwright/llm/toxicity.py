"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the word classes of a clause, each with states of its own: reported speech (up to
the end of the clause), negation (a short scope that a conjunction ends), target, insult (runs of insult
words are one phrase with one negation; also phrases of several words such as "piece of ...") and threat
(base forms of violent verbs, inflected ones within the scope of an intention).  Each reads the marks of
those before it, so their composition is one machine over product states; it is built whole, ahead of the
texts.  Arcs put out the kind of a hit, the state in which the clause ends says which pattern that is:
a plain, targeted, negated or reported insult, a threat or a withdrawn one.  A threat without a target is
no pattern.  Only clauses that hold a possible hit are run.

The insults are learned: words and word beginnings that mark toxic rows of a sample of labelled rows (at
most `sample_rows`, the first by a hash of their id, one of each family of copies), by a likelihood-ratio
test.  Every form that passes it is kept; as each needs several toxic rows of the sample, the sample bounds
the lexicon.  Log odds are the arc weights; a logistic regression on the same sample weighs the patterns.
The sample is written once, so learning reads the documents once.  Ids, language and source are never inputs.

Null and empty texts match nothing and get the score of a text without matches; rows are scored one by
one, so ties and repeated rows do not matter.  Labels with a null id, null or both values for one id are
not learned from; without labels of both kinds every score is the share of toxic labels (0.0 without
labels).  Columns other than the keys and the text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .words import ALPHANUMERIC, CACHED_WORDS, WordHashes, grams, hashed, passed_on, slices, words_of

SAMPLE_ROWS = 50_000
EVIDENCE = 12.0
LEAST_ODDS, MOST_ODDS = 3.0, 5.0
BEGINNINGS = (4, 5, 6)
NEGATION_SCOPE = 3

INTENT_SCOPE = 4
PHRASE_WEIGHT = 3.0

OTHER, INSULT, VIOLENCE, INFLECTED, INTENT, TARGET, NEGATION, REPORT, BREAK, HEAD, LINK, TAIL = range(12)
SYMBOLS = 12
HITS = {INSULT, VIOLENCE, INFLECTED, TAIL}
# The closed word classes of four languages.
CLOSED_CLASSES = {
    VIOLENCE: (
        "kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "murder", "punch", "hang", "strangle",
        "umbringen", "töten", "schlagen", "erschießen", "erstechen", "verprügeln",
        "tuer", "tuerai", "frapper", "frapperai", "poignarder", "étrangler", "matar", "matarte", "mataré", "golpear", "golpearé", "apuñalar",
    ),
    INFLECTED: (
        "kills", "killed", "killing", "hurts", "hurting", "destroys", "destroyed", "destroying", "beats", "beating", "beaten",
        "burns", "burned", "burning", "shoots", "shot", "shooting", "stabs", "stabbed", "stabbing", "murders", "murdered", "murdering",
        "punches", "punched", "punching", "hangs", "hanged", "hanging", "strangled", "strangling",
        "umbringe", "umgebracht", "töte", "getötet", "schlage", "geschlagen", "tue", "tué", "frappe", "frappé", "mato", "matado", "golpeo", "golpeado",
    ),
    INTENT: ("will", "ll", "shall", "gonna", "going", "want", "werde", "werden", "vais", "allons", "veux", "voy", "vamos", "quiero"),
    TARGET: (
        "you", "your", "yours", "yourself", "u", "he", "him", "she", "her", "they", "them", "these", "those",
        "du", "dich", "dir", "euch", "ihn", "ihnen", "tu", "te", "toi", "vous", "ti", "usted", "ustedes",
    ),
    NEGATION: ("not", "no", "never", "nobody", "isn", "aren", "wasn", "don", "doesn", "didn", "nicht", "kein", "nie", "ne", "pas", "jamais", "nunca"),
    REPORT: (
        "said", "says", "told", "wrote", "writes", "quoted", "quote", "claims", "claimed", "called", "reported", "allegedly",
        "sagte", "schrieb", "behauptet", "angeblich", "écrit", "affirme", "prétend", "dijo", "escribió", "afirma",
    ),
    BREAK: ("and", "but", "or", "und", "aber", "oder", "et", "mais", "ou", "y", "pero"),
    HEAD: ("piece", "sack", "son"),
    LINK: ("of", "a"),
    TAIL: ("shit", "crap", "bitch", "scum", "filth"),
}
CLAUSE_ENDS = re.compile(r"[.!?;:\n]+")
PATTERNS = ("insult", "targeted_insult", "negated_insult", "reported_insult", "threat", "withdrawn_threat")
QUOTED, DENIED, INSULTS, THREATENS = 1, 2, 4, 8


def report(state: int, word: int, marks: int) -> tuple[int, int]:
    """State 1: speech is being reported."""
    return (1, marks) if word == REPORT else (state, marks | QUOTED * state)


def negation(state: int, word: int, marks: int) -> tuple[int, int]:
    """State: words that a negation still covers."""
    if word in (NEGATION, BREAK):
        return (NEGATION_SCOPE if word == NEGATION else 0), marks
    return max(state - 1, 0), marks | (DENIED if state else 0)


def target(state: int, word: int, marks: int) -> tuple[int, int]:
    """State 1: the clause names a target, before or behind its hits."""
    return (1 if word == TARGET else state), marks


def insult(state: int, word: int, marks: int) -> tuple[int, int]:
    """States 1, 2: inside a phrase of insults, a denied one; 3, 4: head of a phrase of several words, and its link."""
    if word == INSULT or (word == TAIL and state == 4):
        marks |= INSULTS | (DENIED if state == 2 else 0)
        return (2 if marks & DENIED else 1), marks
    if word == HEAD:
        return 3, marks
    return (4 if word == LINK and state >= 3 else 0), marks


def threat(state: int, word: int, marks: int) -> tuple[int, int]:
    """State: words that an intention still covers."""
    if word == INTENT:
        return INTENT_SCOPE, marks
    return max(state - 1, 0), marks | (THREATENS if word == VIOLENCE or (word == INFLECTED and state) else 0)


TRANSDUCERS = (report, negation, target, insult, threat)
TARGET_AT = TRANSDUCERS.index(target)


def pattern(marks: int, aimed: int) -> int:
    """What a hit is in a clause that ends with or without a target; -1: nothing."""
    if marks & INSULTS:
        return 3 if marks & QUOTED else 2 if marks & DENIED else 1 if aimed else 0
    return -1 if not aimed else 5 if marks & (QUOTED | DENIED) else 4


class Grammar:
    """The composition: `arcs[state][word class]` is (next state, marks of a hit or 0), `final[state]` the pattern of marks."""

    def __init__(self):
        todo = [(0,) * len(TRANSDUCERS)]
        number = {todo[0]: 0}
        self.arcs: list[list[tuple[int, int]]] = []
        self.final: list[list[int]] = []
        for state in todo:  # grows while states are found
            row = []
            for word in range(SYMBOLS):
                after, marks = [], 0
                for transducer, own in zip(TRANSDUCERS, state):
                    own, marks = transducer(own, word, marks)
                    after.append(own)
                if (key := tuple(after)) not in number:
                    number[key] = len(todo)
                    todo.append(key)
                row.append((number[key], marks if marks & (INSULTS | THREATENS) else 0))
            self.arcs.append(row)
            self.final.append([pattern(marks, state[TARGET_AT]) for marks in range(16)])

    def clause(self, words: Sequence[tuple[int, float]], totals: list[float]) -> None:
        """Add the weights of the patterns of one clause (word class, weight)."""
        state, hits, arcs = 0, [], self.arcs
        for word, weight in words:
            state, marks = arcs[state][word]
            if marks:
                hits.append((marks, weight))
        final = self.final[state]
        for marks, weight in hits:
            if (at := final[marks]) >= 0:
                totals[at] += weight


class Classes(dict):
    """word -> (class, weight), from the learned lexicon and the closed classes."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon
        self.closed = {w.encode(): c for c, words in CLOSED_CLASSES.items() for w in words}

    def __missing__(self, word: bytes) -> tuple[int, float]:
        if len(self) > CACHED_WORDS:
            self.clear()
        weight = max((self.lexicon.get(f, 0.0) for f in forms(word)), default=0.0)
        kind = INSULT if weight > 0 else self.closed.get(word, OTHER)
        found = self[word] = (kind, weight if weight > 0 else PHRASE_WEIGHT if kind == TAIL else 1.0)
        return found


def forms(word: bytes) -> list[bytes]:
    """The word and its beginnings; an asterisk marks a beginning."""
    if len(word) <= BEGINNINGS[0]:
        return [word]
    text = word.decode("utf-8", "replace")
    return [word, *(text[:n].encode() + b"*" for n in BEGINNINGS if len(text) > n)]


def matches(text: str | None, classes: Classes, grammar: Grammar) -> list[float]:
    """The weight of each pattern in a whole text."""
    totals = [0.0] * len(PATTERNS)
    look = classes.__getitem__
    if not any(c in HITS for c, _ in map(look, words_of(text, ALPHANUMERIC))):
        return totals
    for clause in CLAUSE_ENDS.split(text):
        words = list(map(look, words_of(clause, ALPHANUMERIC)))
        if any(c in HITS for c, _ in words):
            grammar.clause(words, totals)
    return totals


@dataclass
class Model:
    lexicon: dict[bytes, float]
    weights: list[float]
    intercept: float


def match_rows(rows: DataFrame, lexicon: dict[bytes, float]) -> DataFrame:
    """The columns of `rows` with its last one, the text, replaced by `patterns`: log(1 + weight) of each."""
    text, names = rows.columns[-1], rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, grammar = Classes(lexicon), Grammar()
        for b in slices(batches, text):
            found = [[math.log1p(x) for x in matches(t, classes, grammar)] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*names, "patterns"])

    return rows.mapInArrow(run, passed_on(rows, "patterns array<double>"))


def families(rows: DataFrame) -> DataFrame:
    """id, toxic, family: copies and most near copies of a text share the family, its smallest hash of three words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in slices(batches, "body"):
            words, starts = hashed(b.column("body").to_pylist(), cache, ALPHANUMERIC)
            least = [int(grams(words[s:e], min(3, e - s)).min()) >> 1 if e > s else 0 for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(least, pa.int64())], names=["id", "toxic", "family"])

    return rows.mapInArrow(run, passed_on(rows, "family long"))


def learn_lexicon(rows: DataFrame, positive: int, negative: int) -> dict[bytes, float]:
    """Forms with their log odds; rows: toxic, body."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(keys, pa.binary()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (seen[1], seen[0])]]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["form", "toxic", "clean"])

        for b in slices(batches, "body"):
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("body").to_pylist()):
                seen[toxic].update({f for w in set(words_of(text, ALPHANUMERIC)) for f in forms(w)})
            if len(seen[0]) + len(seen[1]) > CACHED_WORDS:  # the rest is summed behind the shuffle
                yield counted()
        yield counted()

    share = positive / (positive + negative)
    n, t, c = F.col("toxic") + F.col("clean"), F.col("toxic"), F.col("clean")
    evidence = t * F.log(t / (n * share)) + F.when(c > 0, c * F.log(c / (n * (1 - share)))).otherwise(0.0)
    odds = F.log((t + 0.5) / (positive + 1)) - F.log((c + 0.5) / (negative + 1))
    forms_seen = rows.mapInArrow(count, "form binary, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = forms_seen.where((t > share * n) & (odds >= LEAST_ODDS) & (evidence >= EVIDENCE)).select("form", F.least(odds, F.lit(MOST_ODDS)).alias("odds"))
    return {bytes(r["form"]): r["odds"] for r in kept.collect()}  # bounded by the sample


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and pattern weights from labelled rows; give only rows to learn from."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(
        F.min(label).alias("toxic"), F.max(label).alias("high")
    ).where("toxic = high")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id", F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    scratch = Scratch(docs.sparkSession)
    labelled = scratch.keep("labelled", texts.join(F.broadcast(sample), "id").select("id", "toxic", "body"))  # at most sample_rows ids
    one_of_each = scratch.keep("families", families(labelled).groupBy("family", "toxic").agg(F.min("id").alias("id")).select("id").distinct())
    rows = labelled.join(F.broadcast(one_of_each), "id").select("toxic", "body")
    try:
        return fitted(rows, scratch)
    finally:
        scratch.clear()


def fitted(rows: DataFrame, scratch: Scratch) -> Model:
    """The model of the sample; rows: toxic, body."""
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    if not positive or not negative:
        share = positive / max(positive + negative, 1)
        return Model({}, [0.0] * len(PATTERNS), math.inf if share == 1 else -math.inf)
    lexicon = learn_lexicon(rows, positive, negative)
    found = scratch.keep("points", match_rows(rows, lexicon))
    points = found.select(F.col("toxic").cast("double").alias("label"), array_to_vector("patterns").alias("features"))
    fit = LogisticRegression(maxIter=50, regParam=1e-3, standardization=False).fit(points)
    return Model(lexicon, [float(x) for x in fit.coefficients], float(fit.intercept))


def score(docs: DataFrame, model: Model, keys: Sequence[str | Column] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns, patterns (array in the order of PATTERNS) and score."""
    rows = docs.select(*keys, F.col(text).alias("body__"))
    found = match_rows(rows, model.lexicon)
    if math.isinf(model.intercept):
        return found.withColumn("score", F.lit(1.0 if model.intercept > 0 else 0.0))
    total = F.lit(model.intercept)
    for i, w in enumerate(model.weights):
        total = total + F.get("patterns", F.lit(i)) * F.lit(w)
    return found.withColumn("score", 1 / (1 + F.exp(-total)))


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """The fold of a row: crc32 of its id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part
