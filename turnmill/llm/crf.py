"""Language identification with a linear-chain conditional random field.

Every word of a line is labelled with a language. A word's score for a language is the sum of the weights of its affixes,
its character n-grams and its membership in the languages' lexicons; the chain adds a learned weight for each transition.
Forward-backward gives each word's probability per language, so that a text which switches between languages is labelled
word by word. A document's language is the one with the largest mean probability over its words.

The model is learned on the driver from a bounded number of labelled documents per language (``PER_LABEL``), drawn by a
keyed order. Its training sequences are spliced from runs of several documents, so that transitions are seen. The model has
a fixed size and is sent to every task; all documents are labelled by it, whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.llm.arrays import slices

PER_LABEL = 150
LEXICON_WORDS = 300
HASH_BITS = 17
SEQUENCE = 96
MEMO_WORDS = 1 << 17
FIT_SEQUENCES = 512
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # feature x label
    transitions: np.ndarray  # log weight, from x to
    lexicons: dict[str, list[int]] = field(default_factory=dict)  # word -> labels


def features(word: str, lexicons: dict[str, list[int]]) -> list[int]:
    """Hashed features of a lower-case word, from its bytes; the first ones are a bias and the lexicons."""
    data, mask, crc, base = b"^" + word.encode("utf-8", "surrogatepass") + b"$", (1 << HASH_BITS) - 1, zlib.crc32, 64
    size = len(data)
    found = [0, *[1 + i for i in lexicons.get(word, ())]]
    found += [base + (crc(data[:n], 1) & mask) for n in (2, 3, 4) if n < size]
    found += [base + (crc(data[-n:], 2) & mask) for n in (2, 3, 4, 5) if n < size]
    found += [base + (crc(data[i:i + 3], 3) & mask) for i in range(size - 2)]
    found += [base + (crc(data[i:i + 4], 4) & mask) for i in range(size - 3)]
    if size < 40:
        found.append(base + (crc(data, 5) & mask))
    return found


def words_of(line: str) -> list[str]:
    """Runs of letters. Numbers that are no digits, such as superscripts and fractions, are no letters either."""
    found = WORD.findall(line)
    if all(map(str.isalpha, found)):
        return found
    return [w for word in found for w in "".join(c if c.isalpha() else " " for c in word).split()]


def sequences(text: str | None) -> list[list[str]]:
    """The lower-case words of each line, in runs of at most SEQUENCE words."""
    found = []
    for line in (text or "").lower().split("\n"):
        words = words_of(line)
        found += [words[i:i + SEQUENCE] for i in range(0, len(words), SEQUENCE)]
    return found


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of padded sequences, longest first: (time, sequence, label), their log partition sums, expected transitions."""
    steps, count, labels = emissions.shape
    peak = emissions.max(axis=2, keepdims=True)
    local = np.exp(emissions - peak)
    step = np.exp(transitions)
    active = np.searchsorted(-lengths, -np.arange(steps) - 0.5)
    alpha, scale = np.zeros_like(local), np.ones((steps, count), dtype=local.dtype)
    alpha[0] = local[0]
    scale[0] = alpha[0].sum(axis=1)
    alpha[0] /= scale[0][:, None]
    for t in range(1, steps):
        n = active[t]
        moved = (alpha[t - 1, :n] @ step) * local[t, :n]
        scale[t, :n] = moved.sum(axis=1)
        alpha[t, :n] = moved / scale[t, :n, None]
    beta = np.ones_like(local)
    pairs = np.zeros((labels, labels))
    for t in range(steps - 1, 0, -1):
        n = active[t]
        ahead = local[t, :n] * beta[t, :n] / scale[t, :n, None]
        pairs += (alpha[t - 1, :n].T @ ahead) * step
        beta[t - 1, :n] = ahead @ step.T
    marginals = alpha * beta
    marginals /= marginals.sum(axis=2, keepdims=True) + 1e-30
    known = np.arange(steps)[:, None] < lengths[None, :]
    marginals *= known[:, :, None]
    partition = (np.log(scale) + peak[:, :, 0]).sum(axis=0, where=known)
    return marginals, partition, pairs


def _pad(rows: list[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as columns, longest first, with their lengths and their places in ``rows``."""
    lengths = np.array([len(r) for r in rows])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    table = np.full((int(lengths[0]), len(rows)), fill, dtype=np.int64)
    table.T[np.arange(table.shape[0])[None, :] < lengths[:, None]] = np.concatenate([rows[i] for i in order])
    return table, lengths, order


def fit(samples: list[tuple[str, str]], rounds: int = 50, seed: int = 5, l2: float = 1e-6) -> Model:
    """Learn from (text, label) pairs by maximum likelihood."""
    labels = sorted({label for _, label in samples})
    place = {label: i for i, label in enumerate(labels)}
    counts: list[dict[str, int]] = [{} for _ in labels]
    runs: list[tuple[int, list[str]]] = []
    random = np.random.default_rng(seed)
    for text, label in samples:
        own = counts[place[label]]
        for words in sequences(text):
            for word in words:
                own[word] = own.get(word, 0) + 1
            at = 0
            while at < len(words):
                size = int(random.integers(4, SEQUENCE))
                runs.append((place[label], words[at:at + size]))
                at += size
    lexicons: dict[str, list[int]] = {}
    for i, own in enumerate(counts):
        for word, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            lexicons.setdefault(word, []).append(i)
    model = Model(labels, np.zeros((64 + (1 << HASH_BITS) + len(labels), len(labels))), np.zeros((len(labels), len(labels))), lexicons)
    if not runs:
        return model
    spliced, gold = [], []
    index: dict[str, int] = {}
    for i in random.permutation(len(runs)).tolist():
        label, words = runs[i]
        coded = [index.setdefault(w, len(index)) for w in words]
        if spliced and len(spliced[-1]) + len(words) <= SEQUENCE:
            spliced[-1] += coded
            gold[-1] += [label] * len(words)
        else:
            spliced.append(coded)
            gold.append([label] * len(words))
    every, sizes = array("i"), []
    for word in index:
        found = features(word, lexicons)
        every.extend(found)
        sizes.append(len(found))
    cuts = np.r_[0, np.cumsum(sizes)]
    used, flat = np.unique(np.frombuffer(every, dtype=np.int32), return_inverse=True)
    flat, owner = flat.astype(np.int32), np.repeat(np.arange(len(index), dtype=np.int32), np.diff(cuts))
    order = sorted(range(len(spliced)), key=lambda i: -len(spliced[i]))
    # Some sequences at a time, so that the arrays of forward-backward stay small.
    groups = [order[at:at + FIT_SEQUENCES] for at in range(0, len(order), FIT_SEQUENCES)]
    weights, moves = np.zeros((len(used), len(labels))), np.zeros((len(labels), len(labels)))
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for t in range(1, rounds + 1):
        scores = np.zeros((len(index) + 1, len(labels)))
        for k in range(len(labels)):
            scores[:-1, k] = np.add.reduceat(weights[flat, k], cuts[:-1])
        per_word, pair_slope, size = np.zeros((len(index) + 1, len(labels))), np.zeros_like(moves), 0
        for group in groups:
            table, lengths, _ = _pad([np.array(spliced[i]) for i in group], len(index))
            answers, _, _ = _pad([np.array(gold[i]) for i in group], 0)
            error, _, pairs = forward_backward(scores[table], lengths, moves)
            known = np.arange(table.shape[0])[:, None] < lengths[None, :]
            both = known[1:]
            observed = np.bincount(answers[:-1][both] * len(labels) + answers[1:][both], minlength=len(labels) ** 2)
            pair_slope += pairs - observed.reshape(moves.shape)
            at, column = np.nonzero(known)
            error[at, column, answers[known]] -= 1.0
            for k in range(len(labels)):
                per_word[:, k] += np.bincount(table.ravel(), error[:, :, k].ravel(), len(index) + 1)
            size += int(lengths.sum())
        slope = np.stack([np.bincount(flat, per_word[owner, k], len(used)) for k in range(len(labels))], axis=1)
        for i, (value, gradient) in enumerate(((weights, slope / size + l2 * weights), (moves, pair_slope / size + l2 * moves))):
            first[i] = 0.9 * first[i] + 0.1 * gradient
            second[i] = 0.99 * second[i] + 0.01 * gradient ** 2
            value -= 0.1 * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.99 ** t)) + 1e-8)
    full = np.zeros((64 + (1 << HASH_BITS), len(labels)))
    full[used] = weights
    model.weights, model.transitions = full.astype(np.float32), moves.astype(np.float32)
    return model


class Labeller:
    """Labels documents; remembers the scores of words it has met."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.scores = np.zeros((1024, len(model.labels)), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        listed = [features(w, self.model.lexicons) for w in words]
        cuts = np.r_[0, np.cumsum([len(f) for f in listed])[:-1]]
        flat = np.fromiter((x for f in listed for x in f), dtype=np.int64)
        start = len(self.index)
        self.index.update(zip(words, range(start, start + len(words))))
        while len(self.scores) < len(self.index):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[start:start + len(words)] = np.add.reduceat(self.model.weights[flat], cuts)

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its mean probability per text; UNKNOWN and 0 without a letter or without any learned label."""
        rows, owners = [], []
        for i, text in enumerate(texts):
            own = sequences(text)
            rows += own
            owners += [i] * len(own)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not rows or not self.model.labels:
            return names, scores
        words = [w for row in rows for w in row]
        if len(self.index) > MEMO_WORDS:
            self.index = {}
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self._learn(new)
        flat = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        cuts = np.cumsum([len(row) for row in rows])[:-1]
        table, lengths, order = _pad(np.split(flat, cuts), 0)
        owner = np.array(owners)[order]
        totals = np.zeros((len(texts), len(self.model.labels)))
        width = 2048
        for at in range(0, len(lengths), width):
            part = lengths[at:at + width]
            marginals, _, _ = forward_backward(self.scores[table[:part[0], at:at + width]], part, self.model.transitions)
            np.add.at(totals, owner[at:at + width], marginals.sum(axis=0))
        counts = np.bincount(np.array(owners), [len(row) for row in rows], len(texts))
        for i in np.flatnonzero(counts).tolist():
            best = int(totals[i].argmax())
            names[i], scores[i] = self.model.labels[best], float(min(1.0, totals[i, best] / counts[i]))
        return names, scores


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_label: int = PER_LABEL) -> list[tuple[str, str]]:
    """At most ``per_label`` labelled documents of each language that are not held out, in a keyed order."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    counted = labelled.groupBy(lang_col).agg(F.count("*").alias("n")).collect()
    picked = []
    for row in counted:
        # A keyed share of about half as many more, of which the first stay: no sort of all documents.
        share = min(1.0, (1.5 * per_label + 50) / row["n"])
        key = F.xxhash64(F.col(id_col).cast("string"), F.lit("train"))
        some = labelled.filter((F.col(lang_col) == row[lang_col]) & (F.shiftrightunsigned(key, 2) < int(share * (1 << 62))))
        picked.append(some.select(key.alias("k"), F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")))
    if not picked:
        return []
    whole = picked[0]
    for more in picked[1:]:
        whole = whole.unionByName(more)
    rows = sorted(((r.l, r.k, r.i or "", r.t) for r in whole.collect()))
    kept: dict[str, int] = {}
    found = []
    for label, _, _, text in rows:
        kept[label] = kept.get(label, 0) + 1
        if kept[label] <= per_label:
            found.append((text, label))
    return found


def held_out(identity: Column) -> Column:
    """Documents that must not be learned from: crc32 of the id as text is 1 modulo 3. A null id is held out."""
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def languages(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """struct(lang_pred, score) of a text column; repeated rows, ties (the first label by code point) and nulls included."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shared.value)
        for texts in batches:
            names, scores = [], []
            for part in slices(texts):
                found = labeller.documents(part.to_pylist())
                names += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return run(F.col(text_col))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL) -> Model:
    """The model of all labelled documents that are not held out; without any it has no label and predicts UNKNOWN."""
    return fit(training_rows(docs, id_col, text_col, lang_col, per_label))
