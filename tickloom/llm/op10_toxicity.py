"""Toxicity: support vector machine over a gap-tolerant subsequence kernel with Nystroem landmarks."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, sample, table, text_batches

#: The fit takes at most so many toxic rows and twice as many others, those of least hash.
SAMPLE_ROWS = 800
#: Words of other texts that a round of the fit takes: those scored highest, and random ones.
HARD_WORDS, RANDOM_WORDS = 2500, 2500
#: Landmarks of the Nystroem map at most.
LANDMARKS = 192
#: Decay of the kernel for each character that a subsequence spans, and the widest span.
DECAY, SPAN = 0.8, 6
#: Word scores that a task remembers; the memory starts anew when full.
REMEMBERED = 400_000

K = 32
#: Digits that stand for letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def _classes() -> np.ndarray:
    """Letter class of code points below U+0250: 1-26 by base letter, 0 for what is no
    letter (a gap); the last entry serves all others, which fall into 27-31."""
    out = np.zeros(0x250, np.int32)
    for c in range(0x250):
        base = unicodedata.normalize("NFD", _LEET.get(chr(c), chr(c)).lower())[0]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif unicodedata.category(chr(c))[0] == "L":
            out[c] = 27 + c % 5
    return out


_CLASS = _classes()
_PAIRS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


#: Marks the triples of letters (class 0 is a gap); gives each word's norm.
_LETTERS = np.pad(np.ones((K - 1,) * 3), ((1, 0),) * 3).ravel()


class Words:
    """Words as one array of letter classes, each followed by SPAN - 1 gaps, so that no
    subsequence reaches another word; vectorised subsequence features over all of them."""

    def __init__(self, words: list[str]):
        gap = "\n" * (SPAN - 1)
        codes = np.frombuffer((gap.join(words) + gap).encode("utf-32-le"), np.uint32)
        cls = np.where(codes == 10, 0, np.where(codes < 0x250, _CLASS[np.minimum(codes, 0x24F)], 27 + codes % 5)).astype(np.int32)
        self.n, self.size = len(words), len(cls) - SPAN + 1
        length = np.fromiter(map(len, words), np.int64, self.n) + SPAN - 1
        self.start = np.cumsum(length) - length
        self.x, self.y, self.z = cls[: self.size] * K * K, cls * K, cls

    def _triples(self, a: int, b: int) -> np.ndarray:
        return self.x + self.y[a : a + self.size] + self.z[a + b : a + b + self.size]

    def parts(self):
        """(triple ids, words, weight) of each pair of gaps."""
        word = np.repeat(np.arange(self.n), np.diff(self.start, append=self.size))
        for a, b in _PAIRS:
            t = self._triples(a, b)
            ok = _LETTERS[t] > 0
            yield t[ok], word[ok], DECAY ** (a + b + 1)

    def dot(self, table: np.ndarray) -> np.ndarray:
        """<phi(word), table> / |word| for each word: one look-up finds a triple's weight
        and whether it counts for the norm."""
        both = (table * _LETTERS + 1j * _LETTERS).astype(np.complex64)
        total, square = np.zeros(self.size), np.zeros(self.size)
        for span in range(2, SPAN):
            found = sum(both[self._triples(a, b)] for a, b in _PAIRS if a + b == span)
            total += DECAY ** (span + 1) * found.real
            square += DECAY ** (2 * span + 2) * found.imag
        norm = np.sqrt(np.maximum(np.add.reduceat(square, self.start), 1e-12))
        return np.round(np.add.reduceat(total, self.start) / norm, 6)

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """Normalised features of these triples, (words, columns): for few words at a time."""
        place = np.full(K**3, -1, np.int64)
        place[columns] = np.arange(len(columns))
        out, square = np.zeros(self.n * len(columns)), np.zeros(self.n)
        for t, w, weight in self.parts():
            square += np.bincount(w, minlength=self.n) * weight**2
            at, ok = place[t], place[t] >= 0
            out += np.bincount(w[ok] * len(columns) + at[ok], minlength=len(out)) * weight
        return out.reshape(self.n, -1) / np.sqrt(np.maximum(square, 1e-12))[:, None]


def words_of(text: str) -> list[str]:
    """Lower-cased words; runs of single characters, as in 'i d i o t', are one word."""
    text = text.lower()
    return _SPACED.sub(lambda m: re.sub(r"\s", "", m[0]), text).split()


def _svm(z: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Primal Newton steps for the squared-hinge linear SVM; the last weight is the bias."""
    z = np.concatenate([z, np.ones((len(z), 1))], 1)
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * (z.shape[1] - 1) + [1e-3])
    for _ in range(25):
        sv = y * (z @ w) < 1
        zs = z[sv] * c[sv, None]
        new = np.linalg.solve(ridge + zs.T @ z[sv], zs.T @ y[sv])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


class ToxicityModel:
    """A word's decision value is sum_l alpha_l k(word, landmark_l) + bias, with k the
    normalised subsequence kernel of order 3. As k is an inner product of sparse features,
    the sum over landmarks is kept as one table of K**3 triple weights: the same value, at
    a cost that doesn't depend on the number of landmarks. A text's value is the largest of
    its words', through a logistic curve."""

    def __init__(self):
        self.table, self.bias, self.curve, self.landmarks = np.zeros(K**3), -1.0, (4.0, 0.0), []
        self.memory: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "memory": {}}

    def set_landmarks(self, words: list[str], seen: list[str], y: np.ndarray, c: np.ndarray) -> None:
        """Nystroem map at these landmarks, then the SVM on the words seen."""
        columns = np.unique(np.concatenate([t for t, _, _ in Words(words).parts()]))
        phi = Words(words).dense(columns)
        values, vectors = np.linalg.eigh(phi @ phi.T)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        kernel = np.concatenate([Words(seen[i : i + 256]).dense(columns) @ phi.T for i in range(0, len(seen), 256)])
        fit = _svm(kernel @ root, y, c)
        self.table, self.bias, self.landmarks = np.zeros(K**3), float(fit[-1]), words
        self.table[columns] = (root @ fit[:-1]) @ phi

    def values(self, words: list[str]) -> np.ndarray:
        return Words(words).dot(self.table) + self.bias if words else np.zeros(0)

    def text_values(self, texts: list[str]) -> list[float]:
        """The largest of each text's word values; new words of all texts at once."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        bags = [set(words_of(t)) for t in texts]
        new = list(set().union(*bags).difference(self.memory))
        self.memory.update(zip(new, self.values(new).tolist(), strict=True))
        return [max(map(self.memory.__getitem__, bag), default=-4.0) for bag in bags]

    def value(self, text: str) -> float:
        return self.text_values([text])[0]

    def score(self, value: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * value + self.curve[1], -30, 30))))


def train(texts: list[str], toxic: list[int], rounds: int = 6, hard_words: int = HARD_WORDS, random_words: int = RANDOM_WORDS) -> ToxicityModel:
    """Multiple-instance fit: a toxic text holds at least one toxic word, others none.

    Each round fits the SVM on the witness words of toxic texts (first those whose
    subsequences are significantly more frequent in toxic texts, then those that the last
    round scores highest) against words of other texts: the `hard_words`
    that score highest and `random_words` more, a bound on the fit's sample. Witness
    words and hardest others are the landmarks of the Nystroem map.
    """
    model, y = ToxicityModel(), np.array(toxic)
    bags = [sorted(set(words_of(t))) for t in texts]
    if not len(y) or y.min() == y.max():
        return model
    index: dict[str, int] = {}
    member = [np.array([index.setdefault(w, len(index)) for w in b], np.int64) for b in bags]
    vocab = list(index)
    all_words = Words(vocab)
    df = np.zeros((2, len(vocab)))
    tf = np.zeros((2, K**3))
    triples = [np.zeros(0, np.int64)] * len(vocab)
    near = [(t, w) for (t, w, _), (a, b) in zip(all_words.parts(), _PAIRS, strict=True) if max(a, b) <= 2]
    ids, own = np.concatenate([t for t, _ in near]), np.concatenate([w for _, w in near])
    order = np.argsort(own, kind="stable")
    cut = np.searchsorted(own[order], np.arange(len(vocab) + 1))
    ids = ids[order]
    for i in range(len(vocab)):
        triples[i] = ids[cut[i] : cut[i + 1]]
    for m, t in zip(member, toxic, strict=True):
        df[t][m] += 1
        if len(m):
            tf[t][np.unique(np.concatenate([triples[i] for i in m]))] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)

    def z(f):
        p = (f[0] + f[1] + 1) / (n.sum() + 2)
        return (f[1] / n[1] - f[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))

    clean = df[0] == 0
    start = all_words.dot(np.maximum(z(tf), 0)) + np.maximum(z(df), 0)
    value = np.where(clean, start, -1.0)
    pos_bags = [m for m, t in zip(member, toxic, strict=True) if t and len(m)]
    negative = np.flatnonzero(~clean)
    rng = np.random.default_rng(3)
    for r in range(rounds):
        witness: dict[int, int] = {}
        for m in pos_bags:
            at = m[np.argmax(value[m])]
            witness[at] = witness.get(at, 0) + 1
            if r:
                for i in m[value[m] > 0.3]:
                    witness.setdefault(int(i), 1)
        good = np.array([i for i in witness if clean[i]], np.int64)
        if not len(good) or not len(negative):
            break
        hard = negative[np.argsort(-value[negative] if r else -start[negative], kind="stable")[:hard_words]]
        some = rng.choice(negative, min(random_words, len(negative)), replace=False)
        bad = np.unique(np.concatenate([hard, some]))
        marks = sorted(good, key=lambda i: (-witness[i], vocab[i]))[: LANDMARKS // 2] + list(hard[: LANDMARKS // 2])
        seen = np.concatenate([good, bad])
        sign = np.where(np.arange(len(seen)) < len(good), 1.0, -1.0)
        # A witness that many texts share is surer than one that a single text names.
        count = np.array([witness[i] for i in good], float)
        c = np.concatenate([np.sqrt(count), np.ones(len(bad))])
        c[len(good) :] *= 4 * c[: len(good)].sum() / len(bad)
        model.set_landmarks([vocab[i] for i in marks], [vocab[i] for i in seen], sign, 2.0 * c)
        value = all_words.dot(model.table) + model.bias
    top = np.array([value[m].max() if len(m) else -4.0 for m in member])
    model.curve = _curve(top, y)
    return model


def _curve(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve whose 0.5 falls midway between the labels' values where they are
    told apart best."""
    order = np.sort(top)
    cuts = (order[1:] + order[:-1]) / 2
    right = np.array([((top >= c) == y).sum() for c in cuts])
    best = cuts[right == right.max()]
    low, high = top[(y == 0)], top[(y == 1)]
    cut = float((best[0] + best[-1]) / 2)
    spread = max(0.05, float(np.median(high) - np.median(low)))
    return 6.0 / spread, -cut * 6.0 / spread


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits on labelled rows whose crc32(doc_id as text) mod 5 is not 0: at most
    `sample_rows` toxic and twice as many other rows, those of the least hash of the id, with their
    whole texts of any length."""
    got = sample(docs, labels, "toxic", (remainder(F.col("doc_id"), 5) != 0), {1: sample_rows, 0: 2 * sample_rows})
    return train([t for _, t in got], [s for s, _ in got])


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` with score double (0 to 1, higher: more likely toxic) and predicted int
    (score >= threshold), from whole texts.

    Null, empty and blank texts get the score of the least value. Every row is scored by
    itself: repeated rows, ties and other columns need no rule; columns that are already
    named score or predicted are replaced. One map over Arrow batches,
    no shuffle; the model is one table of 32,768 weights.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            m = shared.value
            texts, value = b.column(at), []
            for i in range(0, len(texts), 64):
                value += m.text_values([t or "" for t in texts.slice(i, 64).to_pylist()])
            score = np.array([m.score(v) for v in value], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_toxicity over all of `documents`, fitted on `labels` outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
