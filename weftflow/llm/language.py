"""Language identification by averaged hashed subword embeddings (operator 9).

The letters of a text, in lower case, form words; every other character is a gap. Runs of two to four
characters inside a word (its edges count as characters) are hashed to ``BUCKETS`` embeddings of ``SIZE``
numbers. A text is the average of its subwords' embeddings, and a linear softmax gives the languages.
Embeddings and softmax are trained together by stochastic gradient descent in numpy, on whole texts and on
short excerpts of them. A temperature, fitted on rows kept out of training, calibrates the probabilities.

Rejection marks predictions that aren't to be trusted (``accepted``). Beside the probability it looks at how
familiar a text is: the mean logarithm of how often its subwords came up in training. Bars for both come
from rows kept out of training, whole and in excerpts, and from negatives made of them: their letters shuffled,
their letters replaced by others that training never had, and texts of each language seen with that language's
counts taken out. The bar of familiarity, one for each class of length, stands between low values of the true
texts and high values of the negatives, and never rejects more than ``REJECTED`` of the true ones.

The model is fitted on at most about ``SAMPLE`` rows of each language and about ``TRAIN_BYTES`` of text in all,
drawn by a hash of the id over all rows that the caller allows; texts of more than ``TEXT_BYTES`` and languages
beyond the ``LANGUAGES`` most frequent (by name, if equally so) teach nothing. Prediction is one narrow pass over
whole texts with the product of embeddings and softmax, a table of ``BUCKETS`` rows. Texts are taken in parts
of ``CHUNK`` characters that end at gaps, so memory doesn't grow with them.

Edge cases: a null text, or one with no letter, is ``und`` with score 0; rows with a null language teach
nothing; with no usable rows everything is ``und``; equally likely languages: the first by name; a run of letters
longer than a part counts as several words; repeated rows are repeated; other columns are left out, so their
names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.routing import spread
from .common import slices
from .pieces import release

BUCKETS = 1 << 15
SIZE = 12
LENGTHS = (2, 3, 4)
#: Rows of each language that the model may be fitted on.
SAMPLE = 800
#: Bytes of text that the model may be fitted on, in all and of one row, and the number of languages.
TRAIN_BYTES = 32 << 20
TEXT_BYTES = 1 << 20
LANGUAGES = 200
#: Characters that are handled at once.
CHUNK = 1 << 18
#: Share of true texts that rejection by familiarity may cost.
REJECTED = 0.02
#: Upper ends of the classes of length, in subwords; the last class is open.
SIZES = (8, 16, 32, 64, 128, 512)
NONE = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool))
    return _LETTER[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords, which text each belongs to, and whether each text has a letter."""
    points = np.frombuffer((" " + " ".join(texts) + " ").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # lower() may lengthen a text, so texts are measured as they are after it
    sizes = np.fromiter((len(text.lower()) for text in texts), dtype=np.int64, count=len(texts))
    if len(points) != sizes.sum() + len(texts) + 1:  # a letter whose lower case depends on its neighbours
        points = np.frombuffer((" " + " ".join(text.lower() for text in texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[points]
    points = np.where(letter, points, np.uint32(32))
    row = np.repeat(np.arange(len(texts)), sizes + 1)  # of the character after; a gap belongs to the text before it
    some = np.zeros(len(texts), dtype=bool)
    some[row[np.flatnonzero(letter) - 1]] = True  # the first character is the gap before the first text
    mixed = points * np.uint32(0x9E3779B1)
    found, rows = [], []
    for length in LENGTHS:
        n = len(points) - length + 1
        if n <= 0:
            continue
        h = np.full(n, length * 0x85EBCA6B & 0xFFFFFFFF, dtype=np.uint32)
        inside = letter[:n].copy() if length == 2 else letter[1 : n + 1].copy()
        if length == 2:
            inside |= letter[1 : n + 1]
        for k in range(length):
            h ^= mixed[k : n + k]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            if 1 < k < length - 1:
                inside &= letter[k : n + k]
        at = np.flatnonzero(inside)
        found.append((h[at] % np.uint32(BUCKETS)).astype(np.int32))
        rows.append(row[at])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), some
    return np.concatenate(found), np.concatenate(rows), some


def chunked(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts in parts of at most ``CHUNK`` characters, and which text each belongs to."""
    if all(len(text) <= CHUNK for text in texts):
        return texts, np.arange(len(texts))
    out, owner = [], []
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or at == 0:
            to = min(len(text), at + CHUNK)
            if to < len(text):
                to = next((x for x in range(to, at, -1) if not text[x].isalpha()), to)
            out.append(text[at:to])
            owner.append(k)
            if to == len(text):
                break
            at = to
    return out, np.array(owner)


def totals(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the mean of its subwords' rows of ``table``, how many they are, and whether it has a letter."""
    sums, counts, some = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    parts, owner = chunked(texts)
    columns = np.ascontiguousarray(table.T)
    held, first = 0, 0
    for k, part in enumerate(parts):
        held += len(part)
        if held >= 4 * CHUNK or k == len(parts) - 1:
            at, row, letter = subwords(parts[first : k + 1])
            own = owner[first : k + 1]
            row = own[row]
            n = int(own[-1]) + 1
            counts[:n] += np.bincount(row, minlength=n)
            for c, column in enumerate(columns):
                sums[:n, c] += np.bincount(row, weights=column[at], minlength=n)
            some[own[letter]] = True
            held, first = 0, k + 1
    return sums / np.maximum(1, counts)[:, None], counts, some


def size_class(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(SIZES, counts)


@dataclass
class Model:
    """``table`` has a column for each language, and one of log frequencies; ``bars`` are by class of length."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    bars: np.ndarray

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        logits = (means[:, :-1] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability, and whether the prediction is accepted."""
        if not texts:
            return [], np.zeros(0), np.zeros(0, dtype=bool)
        means, counts, some = totals(self.table, texts)
        p = self.probabilities(means)
        best = p.argmax(axis=1)
        score = np.where(some, p[np.arange(len(p)), best], 0.0)
        names = [self.languages[k] if s else NONE for k, s in zip(best.tolist(), some.tolist())]
        return names, score, some & (score >= self.reject_below) & (means[:, -1] >= self.bars[size_class(counts)])


def excerpts(texts: list[str], rng: np.random.Generator) -> list[str]:
    """For each text a run of one to twelve of its words."""
    out = []
    for text in texts:
        words = text.split()
        if words:
            size = int(rng.integers(1, 13))
            start = int(rng.integers(0, max(1, len(words) - size + 1)))
            out.append(" ".join(words[start : start + size]))
        else:
            out.append(text)
    return out


def fit(texts: list[str], languages: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 9) -> Model:
    """Gradient descent on the cross-entropy of averaged embeddings, in small batches."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    order = rng.permutation(len(texts))
    aside, own = order[: len(order) // 8], order[len(order) // 8 :]
    texts = [*texts, *excerpts(texts, rng)]
    y, own, aside = np.append(y, y), np.append(own, own + len(order)), np.append(aside, aside + len(order))
    embed = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    out = rng.normal(0, 0.3, (SIZE, len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    cached = {}
    for start in range(0, len(own), 32):
        part = own[start : start + 32]
        cached[start] = (part, *subwords([texts[k] for k in part])[:2])
    for epoch in range(epochs):
        pace = np.float32(rate * (1 - epoch / epochs))
        for start in rng.permutation(list(cached)):
            part, at, row = cached[int(start)]
            used, where = np.unique(at, return_inverse=True)
            counts = np.maximum(1, np.bincount(row, minlength=len(part))).astype(np.float32)
            flat = np.bincount(row * len(used) + where, minlength=len(part) * len(used)).reshape(len(part), -1).astype(np.float32)
            share = flat / counts[:, None]
            mean = share @ embed[used]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            step = share.T @ (p @ out.T)
            out -= pace * mean.T @ p
            bias -= pace * 0.1 * p.sum(axis=0)
            embed[used] -= pace * 8 * step
    counts = np.zeros((len(names), BUCKETS))
    for part, at, row in cached.values():
        counts += np.bincount(y[part][row] * BUCKETS + at, minlength=counts.size).reshape(counts.shape)
    model = Model(names, np.column_stack([embed @ out, familiarity(counts.sum(axis=0))]), bias, 1.0, 0.0, np.full(len(SIZES) + 1, -np.inf))
    if len(aside):
        calibrate(model, [texts[k] for k in aside], y[aside], counts, rng)
    return model


def familiarity(counts: np.ndarray) -> np.ndarray:
    """The logarithm of each bucket's share of all subwords, as if it had been seen half a time more."""
    return np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts)))


def shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters dealt anew over their places."""
    marks = np.array(list(text))
    at = np.flatnonzero([c.isalpha() for c in text])
    marks[at] = marks[rng.permutation(at)]
    return "".join(marks.tolist())


def foreign(text: str, rng: np.random.Generator, known: set[str]) -> str:
    """The text with each letter replaced by another of an alphabet that training never had."""
    alphabets = [range(0x0430, 0x0450), range(0x03B1, 0x03C9), range(0x05D0, 0x05EA), range(0x0627, 0x0648), range(0x0905, 0x0939), range(0x4E00, 0x5E00), range(0xAC00, 0xBC00), range(0x0E01, 0x0E2F)]
    usable = [a for a in alphabets if not any(chr(c) in known for c in a)] or alphabets
    alphabet = usable[int(rng.integers(len(usable)))]
    start = int(rng.integers(len(alphabet)))
    return "".join(chr(alphabet[(ord(c) + start) % len(alphabet)]) if c.isalpha() else c for c in text)


def calibrate(model: Model, texts: list[str], y: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> None:
    """Set temperature and bars from texts that weren't trained on, and from negatives made of them."""
    means, sizes, some = totals(model.table, texts)
    logits = means[:, :-1] + model.bias

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y]).mean())

    model.temperature = float(min(np.geomspace(0.01, 20, 153), key=loss))
    p = model.probabilities(means)
    best = p.argmax(axis=1)
    right, score = best == y, p[np.arange(len(p)), best]
    # of the thresholds under which no more than one accepted prediction in a hundred is wrong, the lowest, and
    # at least the score of the poorest hundredth of right predictions
    order = np.argsort(-score)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= 0.99)
    if right.any():
        model.reject_below = float(min(max(score[order[good[-1]]] if len(good) else 1.0, np.quantile(score[right], 0.005)), np.quantile(score[right], REJECTED)))
    known = {c for text in texts for c in text.lower()}
    strange = [make(text) for text in texts for make in (lambda t: shuffled(t, rng), lambda t: foreign(t, rng, known))]
    far, far_sizes, _ = totals(model.table, strange)
    values, lengths = [far[:, -1]], [far_sizes]
    if len(counts) > 1:
        for k in range(len(counts)):  # texts of a language that training never saw
            own = [text for text, of in zip(texts, y) if of == k]
            if own:
                left, left_sizes, _ = totals(familiarity(counts.sum(axis=0) - counts[k])[:, None], own)
                values.append(left[:, -1])
                lengths.append(left_sizes)
    far, far_sizes = np.concatenate(values), np.concatenate(lengths)
    for size in range(len(SIZES) + 1):
        true = means[some & (size_class(sizes) == size), -1]
        false = far[size_class(far_sizes) == size]
        if len(true) >= 20:
            low = np.quantile(true, REJECTED)
            floor = true.min() - 0.05
            # between the kinds where they are apart, else as high as the true texts allow
            model.bars[size] = min(low, max(floor, (np.quantile(false, 0.99) + true.min()) / 2)) if len(false) else floor
    usable = np.flatnonzero(np.isfinite(model.bars))
    for size in np.flatnonzero(~np.isfinite(model.bars)):  # too few texts of that length: as the nearest class
        if len(usable):
            model.bars[size] = model.bars[usable[np.argmin(np.abs(usable - size))]]


def train(documents: DataFrame, allowed: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on rows with a language where ``allowed`` (over the columns of ``documents``) holds."""
    rows = documents.where(allowed).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where((F.octet_length("text") <= TEXT_BYTES) & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    shares = [(r.lang, int((1 << 30) * min(1.0, sample / r.n, TRAIN_BYTES / len(counts) / max(1, r.bytes)))) for r in counts]
    few = documents.sparkSession.createDataFrame(shares, "lang string, share long")
    drawn = rows.join(F.broadcast(few), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share"))
    got = drawn.select("text", "lang").toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    return fit(got["text"].to_pylist(), got["lang"].to_pylist()) if got.num_rows else None


def identify(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for each whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column(1).to_pylist()
                if held.value:
                    names, scores, accepted = held.value.predict(texts)
                else:
                    names, scores, accepted = [NONE] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    kind = documents.schema[id_col].dataType.simpleString()
    read = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return spread(read).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
