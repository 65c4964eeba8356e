"""Reading level of articles in typesetting markup.

Running prose is taken out of the markup, cut into sentences, and every
sentence gets a distribution over the levels from two regularised models: words
and, for words that the labels never showed, character n-grams, besides the
length of the sentence.  A document's distributions are aggregated and turned
into a level by a calibrated logistic model that was fitted on sentence scores
of held-out documents.  The labelled rows for the fit are bounded by
``MAX_LABELLED``, a parameter; every document is scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.runtime import fit_parallelism

#: Most labelled documents that the models are fitted on; the choice goes by a hash of the id.
MAX_LABELLED = 3000
LEVELS = (1, 2, 3, 4)
FOLDS = 5
_SMOOTH, _CHAR_SMOOTH, _TEMPER = 2.0, 20.0, 0.35
_LENGTHS = np.array([5, 8, 11, 14, 18, 22, 27, 33, 40, 50])

_ARG = r"\s*(?:\[[^\]]*\]\s*)?\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
#: A formula ends within its paragraph; a sign that no other closes there is a stray one, and only it is taken out.
_INSIDE = r"(?:[^\n{}]|\n(?![ \t\r]*\n))"
_ENVIRONMENT = r"comment|thebibliography|table\*?|tabular|equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|figure\*?|verbatim|lstlisting|tikzpicture"
_APART = re.compile(
    rf"\\begin\{{({_ENVIRONMENT})\}}(?:.*?\\end\{{\1\}}|(?:{_INSIDE.format('')})*)"  # one without an end reaches to the end of its paragraph
    + rf"|\\iffalse\b(?:.*?\\fi\b|(?:{_INSIDE.format('')})*)"
    + rf"|\\\[(?:{_INSIDE.format('')})*?\\\]|\$\$(?:{_INSIDE.format('$')})+\$\$|\\\((?:{_INSIDE.format('')})*?\\\)|\$(?:{_INSIDE.format('$')})+\$",
    re.DOTALL,
)
_STRAY = re.compile(r"\\[\[\]()]|\$+")
_DEFINITION = re.compile(
    r"\\(?:documentclass|usepackage|bibliographystyle|bibliography|include|input|subfile|label|cite\w*|ref|eqref|footnote|todo|includegraphics|caption|title|author|date|thanks|affiliation|email|keywords|section\*?|subsection\*?|subsubsection\*?|paragraph\*?|chapter\*?|begin|end|hspace|vspace|textcolor\s*\{[^{}]*\}|color)" + _ARG
    + r"|\\(?:re)?newcommand\*?\s*\{?\\\w+\}?(?:\s*\[[^\]]*\])*" + _ARG.removeprefix(r"\s*(?:\[[^\]]*\]\s*)?")
    + r"|\\DeclareMathOperator\*?\s*\{[^{}]*\}\s*\{[^{}]*\}|\\def\s*\\\w+(?:#\d)*" + _ARG + r"|\\let\s*\\\w+\s*=?\s*\\\w+"
)
_ACCENT = re.compile(r"\\(?:[\"'`^~=.]|[cvuHrk](?=\{))\s*\{?\\?([A-Za-z])\}?")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?|\\.|[{}~]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n[ \t\r]*\n")
_WORDS = re.compile(r"[^\W\d_]+")
_ABBREVIATION = re.compile(r"\b(?:i\.e|e\.g|cf|resp|Eq|Fig|Sec)\.")
_FLAT = {c: unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if unicodedata.normalize("NFD", chr(c))[0] != chr(c)}


def prose(text: str | None) -> list[list[str]]:
    """The sentences of a text's running prose, as lists of plain lower-case words.

    Comments, drafts, formulas, floats, headings, titles, notes, bibliographies
    and definitions are no prose.  Accents are taken off, however they are
    written.  Sentences of fewer than two words are left out.
    """
    if not text:
        return []
    t = _COMMENT.sub("", text)
    at = t.find("\\begin{document}")
    if at >= 0:
        t = t[at + 16:]
    at = t.find("\\end{document}")
    if at >= 0:
        t = t[:at]
    t = _STRAY.sub(" ", _APART.sub(" ", t))
    t = _DEFINITION.sub(" ", t)
    if "\\" in t:
        t = _ACCENT.sub(r"\1", t)
        t = _COMMAND.sub(" ", t)
    if not t.isascii():
        t = t.translate(_FLAT)
    t = _ABBREVIATION.sub("", t).lower()
    out = [_WORDS.findall(s) for s in _SENTENCE.split(t)]
    return [s for s in out if len(s) > 1]


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i:i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class SentenceModel:
    """Log-likelihoods of levels for words, unseen words and lengths of sentences."""

    def __init__(self, docs: list[list[list[str]]], levels: np.ndarray) -> None:
        k = len(LEVELS)
        words: list[Counter[str]] = [Counter() for _ in range(k)]
        lengths = np.ones((k, len(_LENGTHS) + 1))
        for sentences, level in zip(docs, levels, strict=True):
            c = int(level)
            for s in sentences:
                words[c].update(s)
            if sentences:
                lengths[c] += np.bincount(np.digitize([len(s) for s in sentences], _LENGTHS), minlength=len(_LENGTHS) + 1)
        every = Counter()
        for w in words:
            every.update(w)
        total = max(1, sum(every.values()))
        sums = np.array([max(1, sum(w.values())) for w in words], float)
        grams: list[Counter[str]] = [Counter() for _ in range(k)]
        for word, n in every.items():
            for g in _grams(word):
                for c in range(k):
                    if words[c][word]:
                        grams[c][g] += min(words[c][word], n)
        gram_sums = np.array([max(1, sum(g.values())) for g in grams], float)
        gram_all = Counter()
        for g in grams:
            gram_all.update(g)
        gram_total = max(1, sum(gram_all.values()))
        # shrunk towards the mean of the levels: a rare word or n-gram says little
        self.grams = {g: np.log((np.array([x[g] for x in grams]) + _CHAR_SMOOTH * n / gram_total * gram_sums / n) / (gram_sums + _CHAR_SMOOTH * gram_sums / n)) - np.log(n / gram_total) for g, n in gram_all.items() if n >= 5}
        self.words = {w: np.log((np.array([x[w] for x in words]) + _SMOOTH * sums / total) / (sums * (n + _SMOOTH) / total)) for w, n in every.items()}
        self.lengths = np.log(lengths / lengths.sum(axis=1, keepdims=True)).T
        self.lengths -= self.lengths.mean(axis=1, keepdims=True)
        self.zero = np.zeros(k)

    def word(self, w: str) -> np.ndarray:
        """Evidence of one word; of an unseen one by its n-grams, which are then kept."""
        out = self.words.get(w)
        if out is None:
            seen = [self.grams[g] for g in _grams(w) if g in self.grams]
            out = np.mean(seen, axis=0) if seen else self.zero
            if len(self.words) < 300_000:
                self.words[w] = out
        return out


class Scorer:
    """A sentence model with its words in one table, for whole documents at once."""

    def __init__(self, model: SentenceModel) -> None:
        self.model = model
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, len(LEVELS)))

    def features(self, sentences: list[list[str]]) -> np.ndarray:
        """Features of a document from the distributions of its sentences."""
        index, rows = self.index, self.rows
        ids = []
        for s in sentences:
            for w in s:
                i = index.get(w)
                if i is None:
                    i = index[w] = len(rows)
                    rows.append(self.model.word(w))
                ids.append(i)
        if len(rows) > len(self.table):
            self.table = np.array(rows)
        if len(rows) > 400_000:
            index.clear()
            rows.clear()
            table, self.table = self.table, np.zeros((0, len(LEVELS)))
        else:
            table = self.table
        sizes = np.array([len(s) for s in sentences])
        starts = np.zeros(len(sizes), int)
        np.cumsum(sizes[:-1], out=starts[1:])
        per = table[ids]
        sums = np.add.reduceat(per, starts, axis=0)
        p = _softmax(_TEMPER * sums + self.model.lengths[np.digitize(sizes, _LENGTHS)])
        mean = per.mean(axis=0)
        expected = p @ np.array(LEVELS)
        return np.concatenate([p.mean(axis=0), mean - mean.mean(), [expected.mean(), expected.std(), np.log(sizes.mean()), np.log1p(sizes.std()), np.mean([len(w) for s in sentences for w in s]), np.log(len(sizes))]])


class LevelModel:
    """Sentence model, and the calibrated step from a document's features to its level."""

    def __init__(self, docs: list[list[list[str]]], labels: list[float]) -> None:
        keep = [i for i, d in enumerate(docs) if d]
        docs, y = [docs[i] for i in keep], np.array([labels[i] for i in keep])
        if not docs:
            self.scorer = None
            return
        # a document between two levels counts half for each
        target = np.zeros((len(y), len(LEVELS)))
        low = np.clip(np.floor(y), 1, 4).astype(int) - 1
        high = np.clip(np.ceil(y), 1, 4).astype(int) - 1
        target[np.arange(len(y)), low] += 0.5
        target[np.arange(len(y)), high] += 0.5
        hard = np.clip(np.floor(y + 0.5), 1, 4).astype(int) - 1
        fold = np.arange(len(y)) % FOLDS
        x = np.zeros((len(y), 2 * len(LEVELS) + 6))
        for f in range(FOLDS):
            rest = [i for i in range(len(y)) if fold[i] != f] or list(range(len(y)))
            scorer = Scorer(SentenceModel([docs[i] for i in rest], hard[rest]))
            for i in np.flatnonzero(fold == f):
                x[i] = scorer.features(docs[i])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = _logistic((x - self.mean) / self.scale, target)
        self.scorer = Scorer(SentenceModel(docs, hard))

    def probabilities(self, sentences: list[list[str]]) -> np.ndarray:
        """The calibrated distribution over the levels of a document with prose."""
        if self.scorer is None:
            return np.full(len(LEVELS), 1 / len(LEVELS))
        x = (self.scorer.features(sentences) - self.mean) / self.scale
        return _softmax(np.append(x, 1.0) @ self.weights)


def _logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.02, steps: int = 400) -> np.ndarray:
    """Multinomial logistic regression with a ridge, by accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x.shape[1], target.shape[1]))
    v, rate = w.copy(), 1.0 / (0.25 * np.linalg.norm(x, 2) ** 2 / len(x) + ridge)
    for k in range(steps):
        grad = x.T @ (_softmax(x @ v) - target) / len(x) + ridge * np.vstack([v[:-1], np.zeros((1, v.shape[1]))])
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LevelModel:
    """The models from at most ``max_labelled`` labelled documents; raters' levels are averaged."""
    marks = labels.where("doc_id is not null and level between 1 and 4").groupBy("doc_id").agg(F.avg("level").alias("_level"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").orderBy("doc_id").toPandas()
    return LevelModel([prose(t) for t in rows["text"]], list(rows["_level"]))


def reading_levels(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, level, score): one row per document with running prose.

    ``level`` is 1 to 4, ``score`` the expected level.  Texts that are null, blank
    or only markup have no row; repeated rows come out once.  Without any
    labelled document every level is equally likely and the lowest is given.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, max_labelled))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            ids, levels, scores = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sentences = prose(text)
                if sentences:
                    p = m.probabilities(sentences)
                    ids.append(i)
                    levels.append(LEVELS[int(np.argmax(p))])
                    scores.append(float(p @ np.array(LEVELS)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(levels, pa.int32()), pa.array(scores, pa.float64())], ["doc_id", "level", "score"])

    return fit_parallelism(documents.select("doc_id", "text").where("text is not null")).mapInArrow(run, f"doc_id {kind}, level int, score double")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, level) of every document with running prose."""
    return reading_levels(documents, labels).select("doc_id", "level")
