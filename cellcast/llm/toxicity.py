"""Toxicity scores from a lexicon trie and Levenshtein automata.

The lexicon is learned from labelled rows: words whose documents are toxic far more often
than the rest, too often for chance. Its words form a trie. Each word of a document is matched by running the
Levenshtein automaton of that word over the trie, both at once, so that a misspelling
within ``distance(len)`` edits of a lexicon word is found without comparing all pairs. The
automaton is compiled to a table of states and steps, one table for each limit. A word of
clean documents is never taken for a misspelling, and only words with strong evidence
match misspellings. The lexicon has no size of its own: all words with enough evidence
among the rows of the fit are in it.

A match counts by its weight, by its closeness, and by its context: words around it tell
an insult (addressed at someone, near other matches) from a mention (in quotation marks,
or introduced as a quotation). Three sums per document feed a logistic regression, trained
on the same labelled rows.

Labels are learned from rows with ``crc32(doc_id as text) mod 5 <> 0`` only; score and
features use the text alone. Fitting takes at most ``FIT_ROWS`` such rows, those with the
least hash of the id, which are written once and deleted after the fit; scoring covers
every row in one pass without a shuffle.

A null text is read as empty; without a match a text gets the score of no evidence. A null
``doc_id`` is not held out, and repeated rows score alike. Without labels of both kinds
there is no lexicon and every score is ``PRIOR``. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.llm.text import slices, small_batches
from cellcast.session import delete_path, scratch_dir

FIT_ROWS = 40_000
FOLDS = 5
MAX_CHANCE = 1e-7
SURE_CHANCE = 1e-12
MIN_LIFT = 10.0
PRIOR = 0.05
CONTEXT_WORDS = 6
MEMO_WORDS = 500_000
N_FEATURES = 3

# How speech is introduced, and how someone is addressed (four languages).
REPORTING = frozenset("""said says say quote quoted quotes called calls word term wrote writes told asked
    sagte sagt zitat nannte wort schrieb dit disait cite mot appelle citation dijo dice cita palabra llama""".split())
ADDRESS = frozenset("""you your youre yourself u are is such damn du dich dein bist ihr sie tu toi ton vous votre es
    tus eres usted""".split())
OPENING, CLOSING = "\"'«“„‘‹", "\"'»”“’›"

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def distance(length: int) -> int:
    """Edits allowed in a word of some length: short words must match exactly."""
    return 0 if length < 5 else 1 if length < 9 else 2


def reach(length: int) -> int:
    """Most edits that a text word of some length can be away from a lexicon word: a misspelling
    may be shorter than its word by as many letters as that word's limit allows."""
    return max(distance(length + k) for k in range(3) if k <= distance(length + k))


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Automaton:
    """The Levenshtein automaton for a limit, as a table that serves every word.

    A state holds the edits from what was read to each of the word's prefixes at most ``limit``
    shorter or longer, counted up to ``limit + 1``. The next state depends on which of the
    word's characters there equal the character read: one bit each. So states and steps are
    finite and known before any word is.
    """

    def __init__(self, limit: int):
        over, width = limit + 1, 2 * limit + 1
        start = tuple(o - limit if o >= limit else over for o in range(width))
        number = {start: 0, (over,) * width: -1}  # -1: no word within the limit can follow
        #: edits by state and place; next state by state and bits
        self.states, self.steps = [start], []
        for state in self.states:  # grows while it is walked
            after = []
            for bits in range(1 << width):
                row: list[int] = []
                for o in range(width):
                    dropped = state[o + 1] if o + 1 < width else over
                    added = row[-1] if row else over
                    row.append(min(over, dropped + 1, added + 1, state[o] + 1 - (bits >> o & 1)))
                found = tuple(row)
                if found not in number:
                    number[found] = len(self.states)
                    self.states.append(found)
                after.append(number[found])
            self.steps.append(after)


compiled = cache(Automaton)


class Trie:
    """Lexicon words; nodes are dictionaries from a character to a node, words end in ``""``."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for i, word in enumerate(words):
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = i

    def nearest(self, word: str, limit: int, limits: list[int] | None = None) -> tuple[int, int] | None:
        """``(edits, index)`` of the closest lexicon word within ``limit`` edits, and within its own
        of ``limits`` if given; the first of equals.

        The trie is walked together with the word's Levenshtein automaton; a path ends where
        the automaton has no state left.
        """
        automaton = compiled(limit)
        n, window = len(word), (1 << 2 * limit + 1) - 1
        places: dict[str, int] = {}
        for p, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << p + limit
        best: tuple[int, int] | None = None
        todo = [(self.root, 0, 0)]
        while todo:
            node, depth, state = todo.pop()
            at = n - depth + limit  # where the state holds the edits to the whole word
            if "" in node and 0 <= at <= 2 * limit:
                found = (automaton.states[state][at], node[""])
                own = limit if limits is None else min(limit, limits[found[1]])
                if found[0] <= own and (best is None or found < best):
                    best = found
            if depth == n + limit:
                continue
            step = automaton.steps[state]
            for c, child in node.items():
                if c and (after := step[places.get(c, 0) >> depth & window]) >= 0:
                    todo.append((child, depth + 1, after))
        return best


class Pieces:
    """A quick test that most words fail: whether a misspelling could hold an unharmed piece.

    Of a lexicon word cut into ``limit + 1`` pieces, ``limit`` edits leave one whole; the first
    stays at the start, the last at the end, the middle one at most ``limit`` places off.
    """

    def __init__(self, words: list[str]):
        self.starts: set[str] = set()
        self.ends: set[str] = set()
        self.middles: set[tuple[int, str]] = set()
        for w in words:
            k = distance(len(w))
            if not k:
                continue
            cuts = [len(w) * i // (k + 1) for i in range(k + 2)]
            self.starts.add(w[:cuts[1]])
            self.ends.add(w[cuts[-2]:])
            for i in range(1, k):
                self.middles.update((at, w[cuts[i]:cuts[i + 1]]) for at in range(max(0, cuts[i] - k), cuts[i] + k + 1))
        self.start_sizes = sorted({len(x) for x in self.starts})
        self.end_sizes = sorted({len(x) for x in self.ends})
        self.middle_sizes = sorted({(at, len(x)) for at, x in self.middles})

    def may_hold(self, word: str) -> bool:
        return (any(word[:n] in self.starts for n in self.start_sizes) or any(word[-n:] in self.ends for n in self.end_sizes)
                or any((at, word[at:at + n]) in self.middles for at, n in self.middle_sizes))


def sure_words(words: list[str], sure: list[bool]) -> list[str]:
    return [w for w, s in zip(words, sure, strict=True) if s]


def own_limits(words: list[str]) -> list[int]:
    return [distance(len(w)) for w in words]


class Lexicon(NamedTuple):
    words: list[str]
    weights: list[float]
    sure: list[bool]  # words with evidence enough to match misspellings too
    common: frozenset[str]  # words of clean documents, never misspellings


class Matcher:
    """Matches words against a lexicon; remembers words it has seen."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.sure = sure_words(lexicon.words, lexicon.sure)
        self.trie = Trie(self.sure)
        self.limits = own_limits(self.sure)
        self.pieces = Pieces(self.sure)
        self.exact = {w: i for i, w in enumerate(lexicon.words)}
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def match(self, word: str) -> tuple[float, int] | None:
        """``(weight, edits)`` of a word that is, or misspells, a lexicon word."""
        if word in self.exact:
            return self.lexicon.weights[self.exact[word]], 0
        limit = reach(len(word))
        if not limit or word in self.lexicon.common or not self.pieces.may_hold(word):
            return None
        found = self.trie.nearest(word, limit, self.limits)
        if not found:
            return None
        return self.lexicon.weights[self.exact[self.sure[found[1]]]] / (1 + found[0]), found[0]

    def features(self, text: str) -> list[float]:
        """Weight of matches, misspellings less by their edits; of quoted matches; of all per word."""
        words = words_of(text)
        distinct = set(words)
        if len(self.seen) > MEMO_WORDS:
            self.seen, self.hits = set(), {}
        for w in distinct - self.seen:
            if found := self.match(w):
                self.hits[w] = found
        self.seen |= distinct
        if distinct.isdisjoint(self.hits):
            return [0.0] * N_FEATURES
        hits = [(i, *self.hits[w]) for i, w in enumerate(words) if w in self.hits]
        quoted = quoted_words(text)
        abuse = mention = 0.0
        for k, (i, weight, _) in enumerate(hits):
            around = words[max(0, i - CONTEXT_WORDS):i] + words[i + 1:i + 1 + CONTEXT_WORDS]
            near = sum(abs(i - j) <= CONTEXT_WORDS for j, *_ in hits[max(0, k - 1):k + 2]) - 1
            told = (i in quoted) + any(w in REPORTING for w in around)
            meant = any(w in ADDRESS for w in around) + near
            if told > meant:
                mention += weight
            else:
                abuse += weight
        return [math.log1p(abuse), math.log1p(mention), math.log1p(100 * abuse / (len(words) + 20))]


def quoted_words(text: str) -> set[int]:
    """Indices of words that stand alone, or among few, in quotation marks."""
    spans = [m.span() for m in TOKEN.finditer(text.lower())]
    out: set[int] = set()
    for i, (a, b) in enumerate(spans):
        if a and text[a - 1:a] in OPENING:
            for j in range(i, min(i + 4, len(spans))):
                end = spans[j][1]
                if text[end:end + 1] and (text[end] in CLOSING or text[end:end + 2][1:] and text[end + 1] in CLOSING):
                    out.update(range(i, j + 1))
                    break
    return out


class Model(NamedTuple):
    lexicon: Lexicon
    weights: list[float]
    bias: float


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Text and label of the bounded sample of labelled rows outside the held-out fold."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows))
    # At most fit_rows rows of two integers.
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    return _texts(docs).join(F.broadcast(known), "doc_id").withColumn("half", half)


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words by how much more often toxic documents hold them, all with enough evidence.

    Near copies of a document mostly have the same word of least hash; a word's support is
    the number of such least words among its documents, so that copies don't add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, keys, toxic, halves = [], [], [], []
            for text, label, half in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                mine = set(words_of(text or ""))
                words += mine
                keys += [min((zlib.crc32(w.encode()) for w in mine), default=0)] * len(mine)
                toxic += [label == 1] * len(mine)
                halves += [half] * len(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(keys, pa.int64()), pa.array(toxic, pa.bool_()), pa.array(halves, pa.int32())],
                ["word", "key", "toxic", "half"])

    totals = rows.agg(F.sum((F.col("toxic") == 1).cast("long")), F.sum((F.col("toxic") != 1).cast("long"))).first()
    n_toxic, n_clean = totals[0] or 0, totals[1] or 0
    if not n_toxic or not n_clean:
        return Lexicon([], [], [], frozenset())
    counts = (rows.select("doc_id", "text", "toxic", "half").mapInArrow(run, "word string, key long, toxic boolean, half int")
              .groupBy("word", "key").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.sum((~F.col("toxic")).cast("long")).alias("c"),
                                          F.sum((~F.col("toxic") & (F.col("half") == 0)).cast("long")).alias("c0"))
              .groupBy("word").agg(F.sum((F.col("t") > 0).cast("long")).alias("support"), F.sum("t").alias("t"),
                                   F.sum("c").alias("c"), F.sum("c0").alias("c0"))
              .cache())
    lift = (F.col("t") / n_toxic) / ((F.col("c") + 0.5) / n_clean)
    # Chernoff's bound on the chance that a word unrelated to the label has this support.
    share, chance = F.col("support") / (F.col("support") + F.col("c")), n_toxic / (n_toxic + n_clean)
    evidence = F.col("support") * F.log(share / chance) + F.col("c") * F.coalesce(F.log((1 - share) / (1 - chance)), F.lit(0.0))
    found = (counts.filter((F.col("support") > 0) & (lift >= MIN_LIFT)).filter(evidence >= -math.log(MAX_CHANCE))
             .select("word", "support", F.log(lift).alias("weight"), (evidence >= -math.log(SURE_CHANCE)).alias("sure"))
             .orderBy(F.desc("support"), "word").collect())
    words = [r["word"] for r in found]
    sure = [bool(r["sure"]) for r in found]
    trie, pieces, limits = Trie(sure_words(words, sure)), Pieces(sure_words(words, sure)), own_limits(sure_words(words, sure))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [w for w in batch.column(0).to_pylist()
                    if reach(len(w)) and pieces.may_hold(w) and trie.nearest(w, reach(len(w)), limits)]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["word"])

    # Clean words that an automaton would take for misspellings. They come from one half of the
    # sample; the regression sees the other half, and so what false matches are worth.
    near = counts.filter("c0 > 0").select("word").mapInArrow(close, "word string").collect()
    counts.unpersist()
    return Lexicon(words, [float(r["weight"]) for r in found], sure, frozenset(r[0] for r in near) - set(words))


_matchers: list[Matcher] = []


def matcher(lexicon: Lexicon) -> Matcher:
    """The worker's matcher for a lexicon, built once."""
    if not _matchers or _matchers[0].lexicon != lexicon:
        _matchers[:] = [Matcher(lexicon)]
    return _matchers[0]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    folder = scratch_dir(spark, "toxicity-fit")
    training_rows(docs, labels, fit_rows).write.parquet(folder)
    model = fit_table(spark.read.parquet(folder))
    delete_path(spark, folder)
    return model


def fit_table(rows: DataFrame) -> Model:
    """The model of a table as :func:`training_rows` gives it."""
    lexicon = learn_lexicon(rows)
    if not lexicon.words:
        return Model(lexicon, [0.0] * N_FEATURES, math.log(PRIOR / (1 - PRIOR)))
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(shared.value)
        for part in slices(batches):
            x = [match.features(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(2).cast(pa.float64()), pa.array(x, pa.list_(pa.float64()))],
                                             ["label", "x"])

    table = rows.filter("half = 1").select("doc_id", "text", "toxic").mapInArrow(run, "label double, x array<double>")
    table = table.select(F.when(F.col("label") == 1, 1.0).otherwise(0.0).alias("label"), array_to_vector("x").alias("features"))
    labels_seen = {r[0] for r in table.select("label").distinct().collect()}
    if len(labels_seen) < 2:
        return Model(Lexicon([], [], [], frozenset()), [0.0] * N_FEATURES, math.log(PRIOR / (1 - PRIOR)))
    found = LogisticRegression(maxIter=50, regParam=1e-3, standardization=True).fit(table.cache())
    table.unpersist()
    return Model(lexicon, [float(w) for w in found.coefficients], float(found.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        match, weights = matcher(model.lexicon), np.array(model.weights)
        for part in slices(batches):
            x = np.array([match.features(t or "") for t in part.column(1).to_pylist()])
            value = 1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    out = _texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
