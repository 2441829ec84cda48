"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata.

``fit`` learns terms, stems and their weights from labelled documents;
``score`` walks every word of every text through one automaton, the
intersection of the trie with the Levenshtein automata of its terms, made
deterministic as states are met. Each hit adds its weight, less where it stands
inside a quotation, between an opening and a closing mark however many words apart
within ``SPAN`` characters of one line, or near a word that reports what others say.

Edge cases: a null or empty text scores the prior; labels that are null or
neither 0 nor 1 are ignored; a row without a label only gets a score; repeated
rows get equal scores; ``score`` keeps other columns and refuses a clash with its own; without labels of both classes the model has no terms
and every text scores the prior. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import slices, without

_WORD = re.compile(r"[^\W\d_]+")
#: Pairs of quotation marks, and words that report what others say, in the languages of the corpus.
QUOTES = ('""', "''", "“”", "„“", "„”", "«»", "»«", "‘’", "‚‘")
REPORTING = frozenset("said says quote quoted called slur word term insult means sagte zitat wort dijo palabra insulto dit mot insulte".split())
#: How much of a hit's weight counts when it stands in quotation marks, where the highest weight alone must not reach the threshold, or near a reporting word.
QUOTED, REPORTED, WINDOW = 0.15, 0.6, 40
#: Characters on either side in which the marks of a quotation are looked for.
SPAN = 200


def edits_allowed(term: str, stem: bool) -> int:
    """Misspellings a term tolerates: none below five letters or for stems, two from nine on."""
    if stem or len(term) < 5:
        return 0
    return 2 if len(term) >= 9 else 1


class Automaton:
    """The trie of a lexicon intersected with the Levenshtein automata of its terms.

    A state is a set of (trie node, edits so far). Transitions are worked out once
    and kept, so a word costs one look-up a letter until no term can match.
    """

    def __init__(self, terms: list[tuple[str, bool]], most_states: int = 50_000):
        self._child: list[dict[str, int]] = [{}]
        self._ends: list[list[tuple[int, int]]] = [[]]  # of a node: (term number, edits allowed)
        self._stem: list[list[int]] = [[]]
        for number, (term, stem) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self._child[node]:
                    self._child[node][c] = len(self._child)
                    self._child.append({})
                    self._ends.append([])
                    self._stem.append([])
                node = self._child[node][c]
            (self._stem[node].append(number) if stem else self._ends[node].append((number, edits_allowed(term, False))))
        self._room = [0] * len(self._child)  # most edits allowed by any term below
        for node in range(len(self._child) - 1, -1, -1):
            below = [self._room[x] for x in self._child[node].values()]
            self._room[node] = max([0, *below, *(k for _, k in self._ends[node])])
        self._letters = {c for x in self._child for c in x}
        self._most = most_states
        self._reset()

    def _reset(self) -> None:
        self._number: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._next: list[dict[str, int]] = []
        self._accept: list[tuple[int, int] | None] = []
        self._stop: list[int | None] = []
        self._start = self._add({0: 0})

    def _add(self, state: dict[int, int]) -> int:
        """The number of a state, closed under letters of a term that a word leaves out; -1: none."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for child in self._child[node].values():
                if e + 1 <= self._room[child] and state.get(child, 99) > e + 1:
                    state[child] = e + 1
                    todo.append((child, e + 1))
        if not state:
            return -1
        key = tuple(sorted(state.items()))
        if key not in self._number:
            self._number[key] = len(self._states)
            self._states.append(key)
            self._next.append({})
            ends = [(e, n) for node, e in key for n, k in self._ends[node] if e <= k]
            self._accept.append((min(ends)[1], min(ends)[0]) if ends else None)
            stems = [n for node, e in key if e == 0 for n in self._stem[node]]
            self._stop.append(min(stems) if stems else None)
        return self._number[key]

    def _step(self, at: int, c: str) -> int:
        state: dict[int, int] = {}
        for node, e in self._states[at]:
            for letter, child in self._child[node].items():
                cost = e + (letter != c)
                if cost <= (self._room[child] if letter != c else max(self._room[child], cost)) and state.get(child, 99) > cost:
                    state[child] = cost
            if e + 1 <= self._room[node] and state.get(node, 99) > e + 1:
                state[node] = e + 1
        return self._add(state)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term number, edits) of the closest term, the first on ties; a stem matches any word it begins."""
        if len(self._states) > self._most:
            self._reset()
        at, stem = self._start, None
        letters = self._letters
        for c in word:
            if c not in letters:
                c = ""
            go = self._next[at]
            to = go.get(c)
            if to is None:
                to = go[c] = self._step(at, c)
            if to < 0:
                return None if stem is None else (stem, 0)
            at = to
            if stem is None:
                stem = self._stop[at]
        full = self._accept[at]
        if stem is not None and (full is None or full[1] > 0):
            return stem, 0
        return full


@dataclass(frozen=True)
class Model:
    """Terms with their weights as log odds; ``fuzzy`` weighs one and two misspelt letters."""

    prior: float
    terms: tuple[tuple[str, bool], ...] = ()
    weights: tuple[float, ...] = ()
    fuzzy: tuple[float, float] = (0.0, 0.0)
    benign: frozenset[str] = field(default_factory=frozenset)

    def scorer(self):
        """A function from a text to its score, with the automaton and the words met so far."""
        automaton = Automaton(list(self.terms))
        known: dict[str, tuple[float, str] | None] = {}

        def weight(word: str) -> float:
            hit = automaton.match(word)
            if hit is None or (hit[1] and word in self.benign):
                return 0.0
            return self.weights[hit[0]] if hit[1] == 0 else min(self.weights[hit[0]], self.fuzzy[hit[1] - 1])

        def score(text: str | None) -> float:
            logit = self.prior
            if text and self.terms:
                low = text.lower()
                hits = {}
                for word in set(_WORD.findall(low)):
                    w = known.get(word)
                    if w is None:
                        if len(known) > 150_000:
                            known.clear()
                        w = known[word] = weight(word)
                    if w > 0:
                        hits[word] = w
                if hits:
                    for m in _WORD.finditer(low):
                        w = hits.get(m[0])
                        if w:
                            logit += w * _stance(low, m.start(), m.end())
                            if logit > 30:
                                break
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

        return score


def _stance(text: str, start: int, end: int) -> float:
    """The share of a hit's weight that counts, from the window around it."""
    if _quoted(text, start, end):
        return QUOTED
    if REPORTING & set(_WORD.findall(text[max(0, start - WINDOW) : start])):
        return REPORTED
    return 1.0


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether an opening mark before a hit and a closing one after it, on its line, have no other of their kind between.

    An opening mark has no letter before it and no space after it, a closing one no
    space before it and no letter after it; others, such as apostrophes, are no marks.
    """
    low = max(0, start - SPAN)
    low = max(low, text.rfind("\n", low, start) + 1)
    high = text.find("\n", end, end + SPAN)
    high = min(len(text), end + SPAN) if high < 0 else high

    def opens(i: int) -> bool:
        return not text[i - 1 : i].isalnum() and not text[i + 1 : i + 2].isspace()

    def closes(i: int) -> bool:
        return i > 0 and not text[i - 1].isspace() and not text[i + 1 : i + 2].isalnum()

    for left, right in QUOTES:
        i = next((i for i in range(start - 1, low - 1, -1) if text[i] in (left, right) and (opens(i) or closes(i))), -1)
        if i < 0 or text[i] != left or not opens(i):
            continue
        j = next((j for j in range(end, high) if text[j] in (left, right) and (opens(j) or closes(j))), -1)
        if j >= 0 and text[j] == right and closes(j):
            return True
    return False


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labels to learn from, each once: crc32 of the number as text leaves 0 or 2 on division by 3."""
    some = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    some = some.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return some.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id", "toxic"])


def log_odds(docs: DataFrame, labels: DataFrame) -> float:
    """The log ratio of toxic to clean documents among all that have a usable label."""
    n = {r.toxic: r.n for r in docs.select("doc_id").join(usable(labels), "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` documents a class with a usable label, chosen by a hash of their number."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [usable(labels).where(F.col("toxic") == k).orderBy(*order).limit(most) for k in (0, 1)]
    chosen = some[0].unionByName(some[1])  # at most 2 * most rows: small enough to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, hypotheses: int = 200_000) -> Model:
    """Terms, stems and weights from at most ``most`` labelled documents of either class.

    A term is a word of any length, and a stem a beginning of four to six letters that three
    words or more share, so frequent in toxic and so rare in clean documents of the
    sample that none of ``hypotheses`` words would be so by chance, and that stands
    between as many different neighbours (words of one copied document don't). The
    prior comes from all usable labels, so the cap doesn't move it. A second round looks at the toxic documents that the first leaves unexplained.
    Counting is distributed; the driver gets candidate terms only.
    """
    sample = labelled(docs, labels, most)
    model, prior = Model(prior=-2.0), None
    for _ in range(2):
        terms, clean, toxic, explained = _terms(sample, model, hypotheses)
        if not clean or not toxic + explained:
            return model
        merged = dict(zip(model.terms, model.weights, strict=True)) | terms
        names = tuple(sorted(merged))
        prior = log_odds(docs, labels) if prior is None else prior
        model = Model(prior=prior, terms=names, weights=tuple(min(8.0, merged[n]) for n in names))
    return _with_misspellings(sample, model, clean, toxic + explained) if model.terms else model


def _features(text: str) -> set[tuple[str, bool]]:
    whole = {(w, False) for w in _WORD.findall(text)}
    return whole | {(w[:n], True) for w, _ in whole for n in (4, 5, 6) if len(w) > n}


def _terms(sample: DataFrame, model: Model, hypotheses: int) -> tuple[dict[tuple[str, bool], float], int, int, int]:
    """New terms with their weights; clean documents, toxic ones that ``model`` misses, and those it finds."""

    def rows(batch):
        texts = [(t or "").lower() for t in batch.column("text").to_pylist()]
        return zip(texts, batch.column("toxic").to_pylist(), strict=True)

    def features(batches):
        import pyarrow as pa

        hit = Automaton(list(model.terms)).match if model.terms else lambda w: None
        seen: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
        totals, explained = [0, 0], 0
        for batch in slices(batches):
            for text, toxic in rows(batch):
                if toxic and any((h := hit(w)) and not h[1] for w in set(_WORD.findall(text))):
                    explained += 1
                    continue
                totals[toxic] += 1
                for x in _features(text):
                    seen[x][toxic] += 1
        out = [("", False, *totals), ("", True, explained, 0), *((w, s, *n) for (w, s), n in seen.items())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["term", "stem", "clean", "toxic"])

    counts = sample.mapInArrow(features, "term string, stem boolean, clean long, toxic long").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = counts.where((F.col("term") == "") | ((F.col("toxic") >= 3) & (F.col("clean") * 20 <= F.col("toxic")))).collect()
    total = {r.stem: r for r in kept if r.term == ""}
    clean, toxic, explained = (total[False].clean, total[False].toxic, total[True].clean) if total else (0, 0, 0)
    if not clean or not toxic:
        return {}, clean, toxic, explained
    least = max(3, math.ceil(math.log(hypotheses) / math.log((clean + toxic) / toxic)))
    if toxic < least:
        return {}, clean, toxic, explained
    candidates = {(r.term, r.stem): r for r in kept if r.term and r.toxic >= least}

    def neighbours(batches):
        import zlib

        import pyarrow as pa

        found = set()
        for batch in slices(batches):
            for text, label in rows(batch):
                if not label:
                    continue
                all_words = _WORD.findall(text)
                for i, w in enumerate(all_words):
                    mine = [x for x in ((w, False), (w[:4], True), (w[:5], True), (w[:6], True)) if x in candidates and (not x[1] or len(w) > len(x[0]))]
                    if mine:
                        around = zlib.crc32(" ".join(all_words[max(0, i - 1) : i] + all_words[i + 1 : i + 2]).encode())
                        found.update((*x, around, w) for x in mine)
        yield pa.RecordBatch.from_pylist([{"term": t, "stem": s, "around": a, "word": w} for t, s, a, w in found], schema=pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("around", pa.int64()), ("word", pa.string())]))

    spread = sample.mapInArrow(neighbours, "term string, stem boolean, around long, word string").groupBy("term", "stem").agg(F.countDistinct("around").alias("around"), F.countDistinct("word").alias("words")).collect()
    wide = {(r.term, r.stem): r.words for r in spread if r.around >= max(least, candidates[r.term, r.stem].toxic * 0.5)}
    terms: dict[tuple[str, bool], float] = {}
    for (term, stem), n_words in sorted(wide.items(), key=lambda x: (len(x[0][0]), not x[0][1], x[0])):
        if any((term[:n], True) in terms for n in range(4, len(term) + (not stem))) or (stem and n_words < 3):
            continue
        r = candidates[term, stem]
        longer = [x for x in wide if x[1] and stem and len(x[0]) > len(term) and x[0].startswith(term)]
        if any(candidates[x].toxic >= 0.9 * r.toxic for x in longer):
            continue  # the longer stem says the same and is met less by chance
        terms[term, stem] = math.log((r.toxic + 0.5) / (toxic + 1)) - math.log((r.clean + 0.5) / (clean + 1))
    return terms, clean, toxic, explained


def _with_misspellings(sample: DataFrame, model: Model, clean: int, toxic: int) -> Model:
    """Weighs misspelt hits by what the sample shows, and notes words of clean documents near a term."""

    def near(batches):
        import pyarrow as pa

        automaton, seen = Automaton(list(model.terms)), Counter()
        for batch in slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for word in set(_WORD.findall((text or "").lower())):
                    hit = automaton.match(word)
                    if hit and hit[1]:
                        seen[word, hit[1], label] += 1
        yield pa.RecordBatch.from_pylist([{"word": w, "edits": e, "toxic": t, "n": n} for (w, e, t), n in seen.items()], schema=pa.schema([("word", pa.string()), ("edits", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())]))

    hits = sample.mapInArrow(near, "word string, edits int, toxic int, n long").groupBy("word", "edits").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic")).collect()
    benign = frozenset(r.word for r in hits if r.clean)
    fuzzy = []
    for k, usual in ((1, 0.01), (2, 0.002)):
        # Words noted as harmless show how often chance makes such a word. At least the
        # usual share of toxic documents is taken to misspell, whether or not the sample does.
        chance = sum(r.clean for r in hits if r.edits == k and r.clean == 1) + 0.5
        t = sum(r.toxic for r in hits if r.edits == k and not r.clean)
        share = max(usual, t / (toxic + 1))
        fuzzy.append(max(0.0, min(5.0, math.log(share) - math.log(chance / (clean + 1)))))
    return Model(model.prior, model.terms, model.weights, (fuzzy[0], fuzzy[1]), benign)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1; a higher score makes a toxic label likelier."""
    without(docs, "score")

    def run(batches):
        import pyarrow as pa

        of = model.scorer()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([of(t) for t in batch.column("text").to_pylist()], pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


#: From this score on a document counts as toxic.
THRESHOLD = 0.7


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it was held out, its score and the decision at 0.7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
