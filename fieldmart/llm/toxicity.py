"""Operator 4: toxicity from a learned lexicon, matched by Levenshtein automata.

Learning: terms (words, and stems: prefixes shared by many words) that labelled toxic
texts use far more often than others form the lexicon.  It is held as a trie.  A word is
matched by the intersection of that trie with Levenshtein automata, determinised as words
need it.  Each match is weighed by its context: inside quotation marks of its line or
within ``WINDOW_WORDS`` words of one of reporting it counts as quotation, otherwise as abuse.  A logistic
model turns the counts into a score.

The lexicon and the model are fitted on at most ``max_train`` labelled rows, taken in the
order of a hash of their ids, never on rows of the held-out fold.  Scores cover every
word of every text.

Defined results: a null or empty text has no matches and scores as such; rows without a
label, or with a null one, do not teach; several labels of one document count as toxic if
any is; with nothing to learn from, every score is 0; repeated rows get equal results; an empty
table gives an empty result; texts of any length are scored whole; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmart.llm import textarrays as ta
from fieldmart.llm.frames import input_columns
from fieldmart.llm.langid import fold

MAX_TRAIN = 20_000
THRESHOLD = 0.7
STEM_LENGTHS = range(4, 9)
#: A term must occur in this share of the toxic texts, and in three of them, so that a
#: few near copies of one text can't make its words terms.
MIN_SHARE = 0.02
#: Least log odds of a term between toxic and other texts.
MIN_LOG_ODDS = 2.5
#: Least likelihood ratio of a term; among a hundred thousand chance terms none reaches it.
MIN_EVIDENCE = 30.0
#: Words a task remembers as matched or not; beyond that it starts anew.
CACHE_WORDS = 500_000
WINDOW_WORDS = 4
#: States of the automaton that a task keeps.
MAX_STATES = 100_000

# Words that introduce someone else's words, in four languages.
REPORTING = frozenset(
    "said says saying wrote writes quote quoted quotes called calls word words term insult "
    "sagte sagt schrieb zitat nannte wort dijo dice cita llamó palabra escribió dit cite citation mot écrit appelé".split()
)


#: What a word counts that is one edit from a term of four letters.
WEAK = 0.5


def allowed_edits(term: str) -> int:
    """Edits that still count as the same term: none for short ones.

    A stem of four letters has none either: with any rest, one edit leaves too little of it.
    """
    return 0 if len(term.rstrip("*")) < 4 or term.endswith("*") and len(term) < 6 else 1 if len(term.rstrip("*")) < 8 else 2


class Lexicon:
    """Terms in a trie, intersected with Levenshtein automata.  Stems end with ``*``.

    Behind a stem's last letter follows the node ``REST``, which any letter leads back to.

    A state is a set of (trie node, edits so far): all places of the lexicon that a word
    may have reached.  States and steps are worked out when a word first needs them and
    kept, so matching a word costs one look-up per letter.
    """

    REST = 1

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        self.ends: dict[int, int] = {}  # node -> edits allowed for the term that ends there
        self.stems: dict[int, int] = {}  # the same for stems
        self.limit = [0, 0]  # most edits allowed for any term below
        self.short: set[int] = set()  # ends of terms of four letters
        for term in terms:
            node, allowed = 0, allowed_edits(term)
            self.limit[0] = max(self.limit[0], allowed)
            for ch in term.rstrip("*"):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                node = self.children[node][ch]
                self.limit[node] = max(self.limit[node], allowed)
            if term.endswith("*"):
                self.stems[node] = allowed
                self.limit[self.REST] = self.ends[self.REST] = max(self.limit[self.REST], allowed)
            else:
                self.ends[node] = allowed
                if len(term) == 4:
                    self.short.add(node)
        self.letters = {ch for child in self.children for ch in child}
        self._start_over()

    def _start_over(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, bool] | None] = []
        self.first = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Number of the state that has reached these nodes, and those past skipped letters; -1 if none."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                edits = reached[node] + 1
                if edits <= self.limit[child] and edits < reached.get(child, edits + 1):
                    reached[child] = edits
                    todo.append(child)
        rest = [reached[n] for n in reached if n in self.stems and reached[n] <= self.stems[n]]
        if rest:
            reached[self.REST] = min(*rest, reached.get(self.REST, rest[0]))
        if not reached:
            return -1
        key = frozenset(reached.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            found = [(e, e > 0 and n in self.short) for n, e in key if e <= self.ends.get(n, -1)]
            self.accepts.append(min(found) if found else None)
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.limit[node] and edits < reached.get(node, edits + 1):
                reached[node] = edits

        for node, edits in self.states[state]:
            if node == self.REST:
                reach(node, edits)
                continue
            reach(node, edits + 1)  # a letter too many
            for ch, child in self.children[node].items():
                reach(child, edits + (ch != letter))
        return self._state(reached)

    def edits(self, word: str) -> int | None:
        """Least number of edits to a term, or from a stem to a prefix; None if there is no match."""
        found = self.match(word)
        return None if found is None else found[0]

    def match(self, word: str) -> tuple[int, bool] | None:
        """The edits, and whether only terms of four letters are so near."""
        if len(self.states) > MAX_STATES:
            self._start_over()
        state, steps = self.first, self.steps
        for ch in word:
            if ch not in self.letters:
                ch = ""
            after = steps[state].get(ch)
            if after is None:
                after = steps[state][ch] = self._step(state, ch)
            if after < 0:
                return None
            state = after
        return self.accepts[state]


class Matcher:
    """Matches of a batch; each different word meets the automaton once.

    ``own`` holds words near a term that are words of their own, not misspellings.
    """

    def __init__(self, lexicon: Lexicon, own: frozenset[str] = frozenset()):
        self.lexicon, self.own, self.known = lexicon, own, {}

    def codes(self, words: ta.Words) -> np.ndarray:
        """-1 for a word without a match, else twice its edits, and one more for a weak match."""
        if not len(words.hash):
            return np.zeros(0, np.int64)
        values, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, out = self.known, np.empty(len(values), np.int64)
        for k, (value, at) in enumerate(zip(values.tolist(), first.tolist(), strict=True)):
            code = known.get(value)
            if code is None:
                word = words.word(at)
                d = self.lexicon.match(word)
                if d and d[0] and word in self.own:
                    d = None
                code = known[value] = -1 if d is None else 2 * d[0] + d[1]
            out[k] = code
        return out[inverse]


# Quotation marks in UTF-8, and the mark that closes what each one opens.
_MARKS = re.compile("|".join(["\n", *'"“”„«»‹›']).encode())
_PAIR = {a.encode(): b.encode() for a, b in zip("«»‹›", "»«›‹", strict=True)}
_LOW, _HIGH, _CLOSE, _STRAIGHT = "„".encode(), "“".encode(), "”".encode(), b'"'


def quotations(text: bytes) -> tuple[list[int], list[int]]:
    """Starts and ends, in bytes, of what stands between quotation marks of one line, by start.

    Marks are looked at once, in order, however far apart.  The sign “ closes „ and opens
    otherwise; « and » close each other.  A mark that opens by its shape and is never
    closed counts to the end of its line, as paragraphs of one long quotation begin so;
    one that may also close (the straight mark, », ›) does not.
    """
    found: list[tuple[int, int]] = []
    open_: dict[bytes, int] = {}

    def end_line(at: int) -> None:
        found.extend((since, at) for mark, since in open_.items() if mark not in (_STRAIGHT, "»".encode(), "›".encode()))
        open_.clear()

    for m in _MARKS.finditer(text):
        mark, at = m[0], m.start()
        if mark == b"\n":
            end_line(at)
            continue
        if mark == _STRAIGHT:
            closes = mark if mark in open_ else None
        elif mark in _PAIR:
            closes = _PAIR[mark] if _PAIR[mark] in open_ else None
        else:
            closes = _LOW if mark in (_HIGH, _CLOSE) and _LOW in open_ else _HIGH if mark == _CLOSE and _HIGH in open_ else None
        if closes is not None:
            found.append((open_.pop(closes), at))
        elif mark != _CLOSE:
            open_.setdefault(mark, at)
    end_line(len(text))
    found.sort()
    # Quotations inside or across others become one.
    starts: list[int] = []
    ends: list[int] = []
    for start, end in found:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


FEATURES = 5


def features(part: pa.Array, matcher: Matcher) -> tuple[np.ndarray, np.ndarray]:
    """Per text: abuse, misspelled abuse, quoted, misspelled quoted (log counts), abuse density; all matches."""
    words = ta.Words(ta.letter_runs(part))
    raw, _ = ta.buffer_of(part)
    codes = matcher.codes(words)
    counts = np.zeros((len(part), 4))
    at = np.flatnonzero(codes >= 0)
    current, marks = -1, ([], [])
    for i in at.tolist():
        t = int(words.text[i])
        if t != current:  # matches come in order of their texts
            current, marks = t, quotations(raw[words.offsets[t] : words.offsets[t + 1]].tobytes())
        start = int(words.start[i]) - int(words.offsets[t])
        k = bisect_right(marks[0], start)
        quoted = k > 0 and start < marks[1][k - 1]
        if not quoted:
            low, high = max(i - WINDOW_WORDS, int(words.first[t])), min(i + WINDOW_WORDS + 1, int(words.first[t + 1]))
            quoted = not REPORTING.isdisjoint(words.word(j) for j in range(low, high) if j != i)
        counts[t, 2 * quoted + (codes[i] > 1)] += WEAK if codes[i] % 2 else 1
    density = (counts[:, 0] + counts[:, 1]) / np.maximum(words.count, 1)
    return np.column_stack([np.log1p(counts), np.sqrt(density)]), np.bincount(words.text[at], minlength=len(part))


# ---- learning ---------------------------------------------------------------------------

_LETTERS = regex.compile(ta.LETTER_RUN)
_DIGIT = re.compile("[0-9]")


def terms_of(text: str | None) -> set[str]:
    """Words and their stems of four letters or more; words with a digit teach nothing."""
    found = set()
    for word in set(_LETTERS.findall((text or "").lower())):
        if _DIGIT.search(word):
            continue
        found.add(word)
        found.update(word[:n] + "*" for n in STEM_LENGTHS if n < len(word))
    return found


def _count_terms(wanted: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                terms = terms_of(text)
                counts.update(terms if wanted is None else terms & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return run


def choose_terms(toxic: dict[str, int], other: dict[str, int], n_toxic: int, n_other: int) -> list[str]:
    """Terms with high log odds; a stem gives way to a word that explains it, or to a shorter stem."""
    good = set()
    for term, a in toxic.items():
        b = other.get(term, 0)
        odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1))
        if odds >= MIN_LOG_ODDS and evidence(a, b, n_toxic, n_other) >= MIN_EVIDENCE:
            good.add(term)
    words = sorted(t for t in good if not t.endswith("*"))
    explained = {w[:n] + "*" for w in words for n in STEM_LENGTHS if n < len(w) and toxic[w] >= 0.8 * toxic.get(w[:n] + "*", 0)}
    kept: set[str] = set()
    covered = lambda t: any(t[:n] + "*" in kept for n in STEM_LENGTHS if n <= len(t))
    for stem in sorted((t for t in good - explained if t.endswith("*")), key=lambda t: (len(t), t)):
        if not covered(stem[:-1]):
            kept.add(stem)
    return sorted(kept) + words  # words that a stem covers as well: their misspellings count


def evidence(a: int, b: int, n_a: int, n_b: int) -> float:
    """Likelihood ratio statistic of a hits among n_a against b among n_b."""
    total = 0.0
    share = (a + b) / (n_a + n_b)
    for hits, n in ((a, n_a), (b, n_b)):
        for seen, expected in ((hits, n * share), (n - hits, n * (1 - share))):
            if seen > 0:
                total += 2 * seen * np.log(seen / expected)
    return total


#: Where the weights are drawn to when examples are few: abuse counts, quotation hardly.
PRIOR = np.array([-3.0, 4.0, 3.0, 0.5, 0.0, 1.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> np.ndarray:
    """Weights (first the bias) by Newton steps, with a ridge around PRIOR."""
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    w[1:5] = np.maximum(w[1:5], 0)  # more matches never lower a score
    return w


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """text and toxic of at most ``max_train`` labelled documents outside the held-out fold.

    Equal texts teach once.
    """
    taught = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold(F.col("doc_id"), 3) != 1)
        .groupBy(F.col("doc_id").alias("t_id")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("t_id"), "t_id").limit(max_train)
    )
    # max_train ids at most: a broadcast of fixed size.
    return docs.join(F.broadcast(taught), F.col("doc_id") == F.col("t_id")).groupBy("text").agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], frozenset[str], np.ndarray] | None:
    """The lexicon, words near it that are none of it, and the model's weights, or None if the labels show only one kind."""
    from fieldmart.sources.staging import stage

    rows = stage(training_rows(docs, labels, max_train), "toxic-train")  # max_train texts at most
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return None
    count = lambda kind, wanted: (
        rows.filter(F.col("toxic") == kind).mapInArrow(_count_terms(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    )
    least = max(3, MIN_SHARE * n_toxic)
    # Terms of MIN_SHARE of the sample's toxic texts: bounded by the sample.
    toxic = {r["term"]: r["n"] for r in count(1, None).filter(F.col("n") >= least).collect()}
    other = {r["term"]: r["n"] for r in count(0, frozenset(toxic)).collect()}
    terms = choose_terms(toxic, other, n_toxic, n_other)
    # Words near a term that other texts use as often: some of the sample's words.
    near = rows.mapInArrow(_near_terms(terms), "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    own = frozenset(r["word"] for r in near.filter((F.col("n") - F.col("a")) * n_toxic >= F.col("a") * n_other).collect())
    examples = rows.mapInArrow(_examples(terms, own), f"x array<double>, toxic int").collect()  # max_train small rows
    x = np.array([r["x"] for r in examples]).reshape(-1, FEATURES)
    return terms, own, fit_logistic(x, np.array([r["toxic"] for r in examples], float))


def _near_terms(terms: list[str]):
    """Words some edits away from a term, once for every text that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(terms))
        for batch in batches:
            for part in ta.pieces(batch, "text", 1 << 21):
                words = ta.Words(ta.letter_runs(part.column("text")))
                at = np.flatnonzero(matcher.codes(words) > 1).tolist()
                found = sorted({(int(words.text[i]), words.word(i)) for i in at})
                toxic = part.column("toxic").take(pa.array([t for t, _ in found], pa.int64())).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([w for _, w in found], pa.string()), toxic], ["word", "toxic"])

    return run


def _examples(terms: list[str], own: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(terms), own)
        for batch in batches:
            for part in ta.pieces(batch, "text", 1 << 21):
                x, _ = features(part.column("text"), matcher)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("toxic").cast(pa.int32())], ["x", "toxic"])

    return run


def _score(terms: list[str], own: frozenset[str], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(terms), own)
        for batch in batches:
            for part in ta.pieces(batch, "text", 1 << 21):
                x, matches = features(part.column("text"), matcher)
                score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
                n = pa.array(matches.astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), n], ["doc_id", "held_out", "score", "n_matches"])

    return run


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches for every document."""
    rows = input_columns(docs, "doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = learn(rows, input_columns(labels, "doc_id", "toxic"), max_train)
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_matches"))
    else:
        schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("n_matches", T.LongType())])
        scored = rows.mapInArrow(_score(*model), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
