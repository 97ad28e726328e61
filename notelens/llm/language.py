"""Operator 9: language of words and documents by a linear-chain conditional random field.

Every word of a text is labelled: its features are affixes, letter n-grams and, for
words of a learned lexicon, the word itself, hashed to ``WEIGHTS`` weights per language;
transitions between the languages of neighbouring words are learned with them. The
forward-backward algorithm gives each word's language probabilities in its context, so
switches inside a text are found. A document's language is the one with the most
expected words, its score their share.

Training maximises the likelihood of word sequences by gradient steps over batches. It
uses a bounded sample: about ``ROWS_PER_LANGUAGE`` documents of each language that a
row names (a hash of the id chooses them), and of each at most ``PIECES`` pieces of
``PIECE`` words, chosen by a hash too. Two pieces of different documents follow one
another in a training sequence, so that both staying and switching are seen.

Prediction is exact over whole texts of any length: words are dealt to blocks, the
transfer matrices of all blocks are multiplied in parallel, and the blocks' ends are
then carried through each document. Rows stay where they are; the model is a few MB.

Words are runs of letters, in lower case. A null text, or one without a letter, is
``und`` with score 0; so is every text if nothing was learned. Rows without a language
or text, or with a null id, are not learned from. Repeated rows are labelled each.
Outputs replace kept columns of the same name.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.tables import map_rows, slices

WEIGHTS = 1 << 15
ROWS_PER_LANGUAGE, PIECES, PIECE, MAX_LANGUAGES = 400, 4, 20, 64
LEXICON, LEXICON_SUPPORT = 5000, 5
STEPS, BATCH, RATE, DECAY = 120, 128, 0.3, 1e-5
#: Words of a block, words whose scores a Python worker keeps, and the longest of those.
BLOCK, CACHED_WORDS, CACHED_CHARS = 32, 300_000, 40
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Words of a text, in lower case; none where no character is a letter."""
    words = WORD.findall((text or "").lower())
    if words and not words[0][0].isalpha():
        words = [w for w in words if any(map(str.isalpha, w))]
    return words


def _hashed(*letters: np.ndarray) -> np.ndarray:
    h = np.full(len(letters[0]), len(letters), np.uint64)
    for x in letters:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(WEIGHTS)).astype(np.int64)


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): places of the words' weights, one word after the other, and where each word's places begin.

    A word written between two marks gives its pairs and triples of characters (with the marks: affixes of one and two
    letters), its affixes of three letters, and its own place if it is in the lexicon. Place ``WEIGHTS`` has no weight.
    """
    joined = "".join([f"^{w}$" for w in words])
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    left = np.repeat(start + size, size) - np.arange(len(c))  # characters from a place to its word's end
    after = [np.concatenate([c[k:], np.zeros(k, np.uint64)]) for k in range(4)]
    pairs = np.where(left >= 2, _hashed(*after[:2]), WEIGHTS)
    triples = np.where(left >= 3, _hashed(*after[:3]), WEIGHTS)
    fours = _hashed(*after)
    prefix = np.where(size >= 5, fours[start], WEIGHTS)
    suffix = np.where(size >= 5, fours[np.maximum(start + size - 4, 0)], WEIGHTS)
    known = np.array([xxhash.xxh3_64_intdigest(w) % WEIGHTS if w in lexicon else WEIGHTS for w in words], np.int64)
    # of each word: two places a character, the last of which have no weight; three of them are free for affixes and word
    places = np.stack([pairs, triples], 1)
    last = start + size - 1
    places[last, 0], places[last, 1], places[last - 1, 1] = prefix, suffix, known
    return places.ravel(), 2 * start


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    lexicon: frozenset[str]
    key: int = 0
    index: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"index": {}, "scores": None}

    def emission(self, words: list[str]) -> np.ndarray:
        """Scores of different words by language."""
        places, first = features(words, self.lexicon)
        return np.add.reduceat(self.weights[places], first, axis=0)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the words by language; words that come again are worked out once."""
        if self.scores is None or len(self.index) > CACHED_WORDS:
            self.index, self.scores = {}, np.zeros((1024, len(self.languages)))
        index = self.index
        places = list(map(index.get, words))
        long: dict[str, int] = {}
        if None in places:
            missing = list(dict.fromkeys(itertools.compress(words, [p is None for p in places])))
            missing.sort(key=lambda w: len(w) > CACHED_CHARS)  # long words come last: they are not kept
            at = len(index)
            while at + len(missing) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at:at + len(missing)] = self.emission(missing)
            for k, word in enumerate(missing, at):
                (index if len(word) <= CACHED_CHARS else long)[word] = k
            places = [(index[w] if w in index else long[w]) if p is None else p for p, w in zip(places, words)]
        return self.scores[np.array(places, np.int64)]


def marginals(emissions: np.ndarray, lengths: Sequence[int], transition: np.ndarray) -> np.ndarray:
    """Language probabilities of every word of chains that follow one another, each of at least one word.

    The state before a chain's first word is any language with the same probability.
    """
    n, k = emissions.shape
    step = np.exp(transition - transition.max())
    e = np.exp(emissions - emissions.max(1, keepdims=True))
    e = np.maximum(e, 1e-30)
    lengths = np.asarray(lengths)
    per_chain = -(-lengths // BLOCK)
    chain_start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    first_block = np.concatenate([[0], np.cumsum(per_chain)[:-1]])
    within = np.arange(per_chain.sum()) - np.repeat(first_block, per_chain)
    start = np.repeat(chain_start, per_chain) + within * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, per_chain) - within * BLOCK)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(BLOCK)]  # blocks with more than t words
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))

    product = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
    for t in range(BLOCK):
        a = active[t]
        if a:
            moved = (product[:a].reshape(-1, k) @ step).reshape(a, k, k) * e[start[:a] + t][:, None, :]
            product[:a] = moved / moved.max((1, 2), keepdims=True)

    entry, leave = np.ones((len(start), k)) / k, np.ones((len(start), k))
    for j in range(1, int(per_chain.max())):
        chains = np.flatnonzero(per_chain > j)
        before, own = place[first_block[chains] + j - 1], place[first_block[chains] + j]
        v = np.einsum("bi,bij->bj", entry[before], product[before])
        entry[own] = v / v.sum(1, keepdims=True)
    for j in range(int(per_chain.max()) - 1, 0, -1):
        chains = np.flatnonzero(per_chain > j)
        before, own = place[first_block[chains] + j - 1], place[first_block[chains] + j]
        v = np.einsum("bij,bj->bi", product[own], leave[own])
        leave[before] = v / v.sum(1, keepdims=True)

    forward, backward = np.empty((n, k)), np.empty((n, k))
    v = entry
    for t in range(BLOCK):
        a = active[t]
        if not a:
            break
        v = (v[:a] @ step) * e[start[:a] + t]
        v /= v.sum(1, keepdims=True)
        forward[start[:a] + t] = v
    v = leave.copy()
    for t in range(BLOCK - 1, -1, -1):
        a = active[t]
        if not a:
            continue
        backward[start[:a] + t] = v[:a]
        u = (v[:a] * e[start[:a] + t]) @ step.T
        v[:a] = u / u.sum(1, keepdims=True)
    found = forward * backward
    return found / found.sum(1, keepdims=True)


def _gradient(emissions: np.ndarray, labels: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the log likelihood of [sequence, word] labels by emissions and transition, and the likelihood a word."""
    b, n, k = emissions.shape
    step = np.exp(transition)
    e = np.exp(emissions - emissions.max(2, keepdims=True))
    forward, backward, scale = np.empty((b, n, k)), np.ones((b, n, k)), np.empty((b, n))
    v = np.ones((b, k)) / k
    for t in range(n):
        v = (v @ step) * e[:, t]
        scale[:, t] = v.sum(1)
        v = v / scale[:, t, None]
        forward[:, t] = v
    for t in range(n - 2, -1, -1):
        u = (backward[:, t + 1] * e[:, t + 1]) @ step.T
        backward[:, t] = u / u.sum(1, keepdims=True)
    marginal = forward * backward
    marginal /= marginal.sum(2, keepdims=True)
    onehot = np.eye(k)[labels]
    pair = forward[:, :-1, :, None] * step * (e * backward)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    seen = np.einsum("bti,btj->ij", onehot[:, :-1], onehot[:, 1:])
    first = step[None] * (e * backward)[:, 0, None, :]  # from any state to the first word's
    first /= first.sum((1, 2), keepdims=True)
    known = step[:, labels[:, 0]]
    begun = (known / known.sum(0)) @ onehot[:, 0]
    score = (np.take_along_axis(emissions - emissions.max(2, keepdims=True), labels[..., None], 2).sum()
             + transition[labels[:, :-1], labels[:, 1:]].sum() + np.log(known.mean(0)).sum())
    return onehot - marginal, seen + begun - pair.sum((0, 1)) - first.sum(0), float(score - np.log(scale).sum()) / (b * n)


def train(pieces: list[tuple[str, list[str]]], seed: int = 0) -> Model:
    """A model of (language, words) pieces; the pieces' order does not matter."""
    pieces = sorted(p for p in pieces if len(p[1]) > 1)
    languages = sorted({lang for lang, _ in pieces})
    counts = Counter(w for _, words in pieces for w in words)
    lexicon = frozenset(w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n >= LEXICON_SUPPORT)
    k = len(languages)
    weights, transition = np.zeros((WEIGHTS + 1, k)), np.zeros((k, k))
    if not k:
        return Model([], weights, transition, lexicon)
    rng = np.random.default_rng(seed)
    listed = sorted(counts)
    all_places, first = features(listed, lexicon)
    own = {w: p[p < WEIGHTS] for w, p in zip(listed, np.split(all_places, first[1:]))}
    by_language = [[words for lang, words in pieces if lang == name] for name in languages]
    power_w, power_t = np.full((WEIGHTS + 1, k), 1e-2), np.full((k, k), 1e-2)

    def piece(lang: int) -> list[str]:
        words = by_language[lang][rng.integers(len(by_language[lang]))]
        return [words[i % len(words)] for i in range(PIECE)]

    for _ in range(STEPS):
        words, labels = [], []
        for _ in range(BATCH):
            a, b = rng.integers(k), rng.integers(k)
            words += piece(a) + piece(b)
            labels += [a] * PIECE + [b] * PIECE
        places = [own[w] for w in words]
        flat = np.concatenate(places)
        word = np.repeat(np.arange(len(words)), [len(p) for p in places])
        starts = np.concatenate([[0], np.cumsum([len(p) for p in places])[:-1]])
        emissions = np.add.reduceat(weights[flat], starts, axis=0).reshape(BATCH, 2 * PIECE, k)
        by_emission, by_transition, _ = _gradient(emissions, np.array(labels).reshape(BATCH, -1), transition)
        by_word = by_emission.reshape(-1, k)
        change = np.stack([np.bincount(flat, by_word[word, c], WEIGHTS + 1) for c in range(k)], 1) / BATCH - DECAY * weights
        power_w += change ** 2
        weights += RATE * change / np.sqrt(power_w)
        by_transition = by_transition / BATCH - DECAY * transition
        power_t += by_transition ** 2
        transition += RATE * by_transition / np.sqrt(power_t)
    return Model(languages, weights, transition, lexicon, int(xxhash.xxh3_64_intdigest(weights.tobytes()) >> 1))


def fit(labelled: DataFrame, lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Train on about ``rows`` documents of each language of ``labelled`` (``doc_id``, ``text`` and a language).

    Documents are sampled by a hash of id and text. However often rows repeat, at most twice the expected number of pieces is
    learned from, those of the smallest hashes.
    """
    known = labelled.select("doc_id", F.col(lang).cast("string").alias("label"), "text").filter(
        "doc_id is not null and label is not null and text is not null")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30))
    wanted = F.lit(False)
    for name, n in sorted(counts.items()):
        wanted = wanted | ((F.col("label") == name) & (u < int(min(1.0, rows / n) * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for doc_id, label, text in zip(*(c.to_pylist() for c in part.columns)):
                words = words_of(text)
                starts = range(0, max(1, len(words) - PIECE + 1), PIECE)
                chosen = sorted(starts, key=lambda s: xxhash.xxh3_64_intdigest(f"{doc_id}:{s}"))[:PIECES]
                for s in chosen:
                    out[0].append(label)
                    out[1].append(words[s:s + PIECE])
                    out[2].append(xxhash.xxh3_64_intdigest(" ".join(out[1][-1])) >> 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.int64())], ["label", "words", "h"])

    found = map_rows(known.filter(wanted), run, [
        T.StructField("label", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("h", T.LongType())])
    bounded = found.orderBy("h", "label", "words").limit(2 * rows * PIECES * max(1, len(counts)))
    return train([(r["label"], list(r["words"])) for r in bounded.collect()])  # short pieces


_MODELS: dict[int, Model] = {}


def label_words(model: Model, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
    """Words of each text and their language probabilities."""
    words = [words_of(t) for t in texts]
    lengths = [len(w) for w in words if w]
    if not lengths or not model.languages:
        return [(w, np.zeros((len(w), len(model.languages)))) for w in words]
    found = marginals(model.emissions(list(itertools.chain.from_iterable(words))), lengths, model.transition)
    ends = np.cumsum([len(w) for w in words])
    return [(w, found[e - len(w):e]) for w, e in zip(words, ends)]


def predict(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``lang_pred``, ``score``, and ``switches``, the changes of the likeliest language between words."""
    new = ("lang_pred", "score", "switches")
    names = [n for n in keep if n not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = shared.value
        own = _MODELS[key]
        for part in slices(batches):
            langs, scores, switches = [], [], []
            for words, p in label_words(own, part.column(len(names)).to_pylist()):
                if not words or not own.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    switches.append(0)
                    continue
                expected = p.sum(0)
                best = int(expected.argmax())
                likeliest = p.argmax(1)
                langs.append(own.languages[best])
                scores.append(min(1.0, float(expected[best] / expected.sum())))
                switches.append(int((likeliest[1:] != likeliest[:-1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(names)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(switches, pa.int64())],
                [*names, *new])

    wide = docs.select(*names, F.col(text).alias("_text"))
    return map_rows(wide, run, [docs.schema[n] for n in names] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("switches", T.LongType())])
