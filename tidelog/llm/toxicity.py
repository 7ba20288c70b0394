"""Toxicity with a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel counts common subsequences of three and of four characters of two words, gaps included: an occurrence that
spans g extra characters weighs DECAY ** g, up to two gaps for three characters and three for four, so that an insult
with characters put in keeps most of its likeness. Letters spread by single blanks or by punctuation are read as one word.
A sentence is as toxic as its most toxic word.

The machine learns from sentences. Labels are of documents, so sentences start with their document's label and the
machine relabels them, as multiple-instance learning does: of a toxic document the sentences it finds toxic stay so, the
most toxic one at least; each stands for its worst word, while all words of clean sentences are clean. Landmarks are
words of the labelled sentences. A word's Nystroem features are its kernel values with the landmarks, turned by the
inverse root of the landmarks' own kernel matrix. As the machine is linear in these, its decision is one weight for
each subsequence, so a text is scored in time proportional to its length, landmarks however many. A logistic curve over
its three most toxic sentences judges a document.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

DECAY = 0.6
_MARK, _CODES = 31, 32  # 1 to 26: letters; 27 to 30: other letters and digits; 31: a word's border
_SPAN3, _SPAN4 = 5, 7
_SIZE3 = _CODES**3
SIZE = _SIZE3 + _CODES**4
#: (places within the span, weight)
_SHAPES = [((0, *c), DECAY ** (c[-1] - 2)) for c in combinations(range(1, _SPAN3), 2)] + [((0, *c), DECAY ** (c[-1] - 3)) for c in combinations(range(1, _SPAN4), 3)]
_PIECE, _STEP = 24, 16  # longer words are read in overlapping pieces
_SPACE, _POINT, _END = 1, 2, 3
_CHUNK = 1 << 19


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code (0: no letter) and kind of gap of the characters below 0x250; the last entry is for all others."""
    code, gap = np.zeros(0x251, np.uint8), np.full(0x251, _POINT, np.uint8)
    for c in range(0x250):
        low = chr(c).lower()[0]
        if "a" <= low <= "z":
            code[c] = ord(low) - 96
        elif low.isalnum():
            code[c] = 27 + ord(low) % 4
        elif chr(c).isspace():
            gap[c] = _SPACE
    gap[[ord(c) for c in "\n\r.!?;|"]] = _END
    return code, gap


_CODE, _GAP = _tables()
#: Norm of a word's subsequences by its length, its two marks included.
_NORM = np.sqrt(np.maximum(1e-6, [sum(w * w * max(0, n - places[-1]) for places, w in _SHAPES) for n in range(_PIECE + 3)])).astype(np.float32)


@dataclass(frozen=True)
class Kernel:
    """Bounds of the training sample: ``rows`` toxic documents and twice as many others, ``sentences`` of each.

    landmarks: of the machine; clean: clean words it learns from at first, and most that each round adds, those it takes
    for toxic; words: most words of a sentence; cost: of training errors;
    caution: how many times as much those on clean words weigh; sure: margin from which any sentence of a toxic document
    stays toxic; rounds: of relabelling.
    """

    rows: int = 3000
    sentences: int = 40
    landmarks: int = 512
    clean: int = 6000
    words: int = 12
    cost: float = 10000.0
    caution: float = 3.0
    sure: float = 1.0
    rounds: int = 5
    seed: int = 3


@dataclass
class Reading:
    """Texts as pieces of words: codes with marks, where each piece begins in them, its length, sentence; each sentence's text."""

    codes: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    sentence: np.ndarray
    text: np.ndarray

    def pieces(self) -> np.ndarray:
        """The pieces as byte strings of their codes, padded with zeros."""
        out = np.zeros((len(self.begin), _PIECE + 2), np.uint8)
        for k in range(_PIECE + 2):
            some = np.flatnonzero(self.size > k)
            out[some, k] = self.codes[self.begin[some] + k]
        return out.view(f"S{_PIECE + 2}").ravel()


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[False], x[:-1]])


def read(texts: list[str], words: int) -> Reading:
    """Whole texts, cut into sentences of at most ``words`` words."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) + 1 for t in texts])
    close = np.zeros(len(points), bool)
    close[np.cumsum(lens) - 1] = True  # the line end after each text
    low = np.minimum(points, 0x250)
    code, gap = _CODE[low], _GAP[low]
    other = np.flatnonzero(points >= 0x250)
    if len(other):
        x = points[other]
        sign = ((x >= 0x2000) & (x < 0x2070)) | ((x >= 0x3000) & (x < 0x3040)) | ((x >= 0xFF00) & (x < 0xFF10))
        code[other] = np.where(sign, 0, 27 + x % 4)
        gap[other] = np.where((x == 0x3000) | ((x >= 0x2000) & (x < 0x200B)), _SPACE, np.where(x == 0x3002, _END, _POINT))
    letter = code > 0
    drop = ~letter & (gap != _SPACE) & ~close & (points != 10) & (points != 13) & _before(letter) & np.append(letter[1:], False)
    keep = ~drop
    code, gap, close = code[keep], gap[keep], close[keep]
    letter = code > 0
    start = np.flatnonzero(letter & ~_before(letter))
    if not len(start):
        z = np.zeros(0, np.int64)
        return Reading(np.zeros(0, np.uint8), z, z, z, z)
    stop = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1
    size = stop - start
    text = np.searchsorted(np.flatnonzero(close), start)
    stops = np.cumsum(~letter & (gap == _END))
    single = size == 1
    joined = np.append(False, single[1:] & single[:-1] & (start[1:] - stop[:-1] == 1) & (text[1:] == text[:-1]) & (stops[start[1:]] == stops[start[:-1]]))
    first = np.flatnonzero(~joined)
    size = np.add.reduceat(size, first)
    at = np.cumsum(size) - size  # within the letters
    start, text = start[first], text[first]
    # sentences
    fresh = np.append(True, (text[1:] != text[:-1]) | (stops[start[1:]] != stops[start[:-1]]))
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(start)), 0))
    fresh |= (np.arange(len(start)) - head) % words == 0
    sentence = np.cumsum(fresh) - 1
    of = text[fresh]
    # pieces of long words
    count = np.where(size <= _PIECE, 1, -(-(size - (_PIECE - _STEP)) // _STEP))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    from_ = np.repeat(at, count) + nth * _STEP
    size = np.minimum(_PIECE, np.repeat(size, count) - nth * _STEP)
    begin = np.cumsum(size + 2) - size - 2
    codes = np.full(int((size + 2).sum()), _MARK, np.uint8)
    shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    codes[np.repeat(begin + 1, size) + shift] = code[letter][np.repeat(from_, size) + shift]
    return Reading(codes, begin, size + 2, np.repeat(sentence, count), of)


def occurrences(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights (0 where there is none), a row for each piece; rows have unit length."""
    code = pieces.view(np.uint8).reshape(len(pieces), -1).astype(np.int32)
    size = (code > 0).sum(1)
    m = int(size.max())
    n = len(code)
    padded = np.concatenate([code[:, :m], np.zeros((n, _SPAN4), np.int32)], 1)
    ids, weights = [], []
    for places, weight in _SHAPES:
        number = np.zeros((n, m), np.int32)
        for q in places:
            number = number * _CODES + padded[:, q : q + m]
        ids.append(number + (0 if len(places) == 3 else _SIZE3))
        weights.append(np.where(padded[:, places[-1] : places[-1] + m] > 0, np.float32(weight), np.float32(0)))
    return np.concatenate(ids, 1), np.concatenate(weights, 1) / _NORM[size][:, None]


def _chunks(pieces: np.ndarray, rows: int = 2048):
    """Rows of pieces of like lengths, with their subsequences."""
    order = np.argsort((pieces.view(np.uint8).reshape(len(pieces), -1) > 0).sum(1), kind="stable")
    for k in range(0, len(order), rows):
        part = order[k : k + rows]
        yield part, *occurrences(pieces[part])


def values(pieces: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sum of each piece's weighted subsequences."""
    out = np.zeros(len(pieces))
    for part, ids, w in _chunks(pieces):
        out[part] = (w * weight[ids]).sum(1)
    return out


def margins(r: Reading, weight: np.ndarray, bias: float) -> np.ndarray:
    """Of each sentence: the greatest of its words' sums of weighted subsequences, and the bias."""
    if not len(r.begin):
        return np.zeros(0, np.float32)
    n = len(r.codes)
    c = np.concatenate([r.codes, np.zeros(_SPAN4, np.uint8)]).astype(np.int32)
    owner = np.concatenate([np.repeat(np.arange(len(r.begin), dtype=np.int32), r.size), np.full(_SPAN4, -1, np.int32)])
    by = [c, c << 5, c << 10, c << 15]
    total = np.zeros(n, np.float32)
    within = {last: owner[last : n + last] == owner[:n] for last in range(2, _SPAN4)}
    for places, decay in _SHAPES:
        k = len(places)
        at = by[k - 1][:n] + by[k - 2][places[1] : n + places[1]]
        at += by[k - 3][places[2] : n + places[2]]
        if k == 4:
            at += by[0][places[3] : n + places[3]]
            at += _SIZE3
        total += weight.take(at) * within[places[-1]] * np.float32(decay)
    word = np.add.reduceat(total, r.begin) / _NORM[r.size]
    return np.maximum.reduceat(word, np.flatnonzero(np.append(True, r.sentence[1:] != r.sentence[:-1]))) + np.float32(bias)


def worst(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The three greatest margins of each text's sentences; -2 where there are fewer, and at least -2."""
    out = np.full((n, 3), -2.0)
    order = np.lexsort((-values, text))
    first = np.searchsorted(text[order], np.arange(n))
    nth = np.arange(len(order)) - first[text[order]]
    top = nth < 3
    out[text[order][top], nth[top]] = values[order][top]
    return np.maximum(out, -2.0)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: np.ndarray
    middle: float
    words: int

    def worst(self, texts: list[str]) -> np.ndarray:
        out = np.full((len(texts), 3), -2.0)
        for lo, hi in _parts(texts):
            r = read(texts[lo:hi], self.words)
            out[lo:hi] = worst(margins(r, self.weight, self.bias), r.text, hi - lo)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.worst(texts) @ self.slope + self.middle, -30, 30)))


def kernel(pieces: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of each piece with each landmark."""
    ids, weights = occurrences(landmarks)
    names, number = np.unique(ids, return_inverse=True)
    table = np.zeros((len(names) + 1, len(landmarks)), np.float32)  # a last row for all other subsequences
    np.add.at(table, (number.reshape(ids.shape), np.arange(len(landmarks))[:, None]), weights)
    where = np.full(SIZE, len(names), np.int32)
    where[names] = np.arange(len(names))
    out = np.zeros((len(pieces), len(landmarks)), np.float32)
    for part, i, w in _chunks(pieces, 256):
        at = where[i]
        known = (at < len(names)) & (w > 0)
        for r, row in enumerate(part.tolist()):
            hit = np.flatnonzero(known[r])
            out[row] = w[r][hit] @ table[at[r][hit]]
    return out


def contrast(pieces: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """For each subsequence how far its shares of the toxic and the clean sentences' words lie apart, in deviations."""
    a, b = max(1.0, positive.sum()), max(1.0, negative.sum())
    plus, minus = np.zeros(SIZE), np.zeros(SIZE)
    for part, ids, w in _chunks(pieces):
        some = w > 0
        plus += np.bincount(ids[some], (w * positive[part, None])[some], SIZE)
        minus += np.bincount(ids[some], (w * negative[part, None])[some], SIZE)
    return (plus / a - minus / b) / np.sqrt((plus + minus + 1) / (a + b) * (1 / a + 1 / b))


def _unlike(pieces: np.ndarray, value: np.ndarray, rows: np.ndarray, most: int) -> list[int]:
    """Rows by value; what a chosen one explains is taken off the others'."""
    likely = rows[np.argsort(-value[rows], kind="stable")[: 16 * most]]
    if not len(likely):
        return []
    ids, w = occurrences(pieces[likely])
    left, chosen = value[likely].copy(), []
    one = np.zeros(SIZE, np.float32)
    for _ in range(most):
        best = int(np.argmax(left))
        if left[best] <= 0:
            break
        np.add.at(one, ids[best], w[best])
        left -= left[best] * np.clip((one[ids] * w).sum(1), 0, 1)
        one[ids[best]] = 0
        left[best] = -np.inf
        chosen.append(int(likely[best]))
    return chosen


def choose_landmarks(pieces: np.ndarray, value: np.ndarray, clean: np.ndarray, p: Kernel) -> np.ndarray:
    """Words as landmarks, unlike each other: a quarter by value, a half clean words by value, the rest at large."""
    chosen = _unlike(pieces, value, np.arange(len(pieces)), p.landmarks // 4)
    chosen += [k for k in _unlike(pieces, value, np.flatnonzero(clean), p.landmarks // 2) if k not in set(chosen)]
    rest = np.setdiff1d(np.arange(len(pieces)), chosen)
    at_large = np.random.default_rng(p.seed).permutation(rest)[: p.landmarks - len(chosen)]
    return pieces[np.concatenate([np.array(chosen, np.int64), at_large])]


def machine(x: np.ndarray, y: np.ndarray, share: np.ndarray, p: Kernel) -> np.ndarray:
    """Squared-hinge support vector machine by Newton's method, with a bias; clean words weigh ``caution`` times as much."""
    share = share * np.where(y > 0, 1 / max(1e-9, share[y > 0].sum()), p.caution / max(1e-9, share[y < 0].sum())) * p.cost
    width = x.shape[1] + 1
    ridge = np.eye(width)
    ridge[-1, -1] = 1e-3
    beta = np.zeros(width)
    for _ in range(25):
        left, right = ridge.copy(), np.zeros(width)
        for k in range(0, len(x), 4096):
            part = np.concatenate([x[k : k + 4096], np.ones((len(x[k : k + 4096]), 1))], 1)
            active = y[k : k + 4096] * (part @ beta) < 1
            part = part[active]
            weighted = part * share[k : k + 4096][active][:, None]
            left += weighted.T @ part
            right += weighted.T @ y[k : k + 4096][active]
        new = np.linalg.solve(left, right)
        if np.allclose(new, beta, atol=1e-7):
            break
        beta = new
    return beta


def gapped(pieces: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each word with a letter put in, at a random place; words of under four letters as they are."""
    code = pieces.view(np.uint8).reshape(len(pieces), -1)
    out = np.zeros_like(code)
    for k, row in enumerate(code):
        n = int((row > 0).sum())
        if n - 2 < 4 or n == code.shape[1]:
            out[k] = row
            continue
        at = int(rng.integers(2, n - 1))
        out[k, : n + 1] = np.concatenate([row[:at], [rng.integers(1, 27)], row[at:n]])
    return np.ascontiguousarray(out).view(pieces.dtype).ravel()


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Logistic regression with a bias, by Newton's method; one clear sentence should do where labels allow it."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    beta = np.array([1.0, 0.5, 0.5, -1.0])
    ridge = np.diag([0.02, 2.0, 2.0, 1e-3])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (share * s * (1 - s))[:, None]).T @ x + ridge, x.T @ (share * (y - s)) - ridge @ beta)
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return beta


@dataclass
class _Bags:
    """Distinct sentences of a sample: each one's document, label and words; clean if a clean document has it too."""

    pieces: np.ndarray
    word: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    toxic: np.ndarray


def _parts(texts: list[str]):
    """Stretches of texts of about ``_CHUNK`` characters: from, to."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= _CHUNK or k + 1 == len(texts):
            yield lo, k + 1
            lo, size = k + 1, 0


def _bags(texts: list[str], toxic: np.ndarray, p: Kernel) -> _Bags:
    table = np.random.default_rng(p.seed).integers(0, 1 << 64, (_PIECE + 2, _CODES), np.uint64)
    found = []
    for lo, hi in _parts(texts):
        r = read(texts[lo:hi], p.words)
        if not len(r.begin):
            continue
        nth = np.arange(len(r.codes)) - np.repeat(r.begin, r.size)
        token = np.add.reduceat(table[nth, r.codes], r.begin)  # of each piece
        cut = np.flatnonzero(np.append(True, r.sentence[1:] != r.sentence[:-1]))
        digest = np.add.reduceat(token, cut)
        order = np.lexsort((digest, r.text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(r.text[order], np.arange(hi - lo))[r.text[order]]
        chosen = np.flatnonzero(rank < p.sentences)  # of each document, by hash
        size = np.append(cut[1:], len(token))[chosen] - cut[chosen]
        word = np.repeat(cut[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
        names, first = np.unique(token[word], return_index=True)
        kept = Reading(r.codes, r.begin[word[first]], r.size[word[first]], first, first)
        found.append((token[word], size, digest[chosen], lo + r.text[chosen], names, kept.pieces()))
    if not found:
        z = np.zeros(0, np.int64)
        return _Bags(np.zeros(0, f"S{_PIECE + 2}"), z, z, z, z.astype(bool))
    word, size, digest, text, names, pieces = (np.concatenate([f[k] for f in found]) for k in range(6))
    names, first = np.unique(names, return_index=True)
    pieces = pieces[first]
    _, first, bag = np.unique(digest, return_index=True, return_inverse=True)
    label = np.ones(len(first), bool)
    np.logical_and.at(label, bag, toxic[text])
    begin = (np.cumsum(size) - size)[first]
    size = size[first]
    word = np.searchsorted(names, word[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())])
    return _Bags(pieces, word, np.repeat(np.arange(len(first)), size), text[first], label)


def train(texts: list[str], toxic: np.ndarray, p: Kernel) -> Model:
    """From labelled documents: sentences, landmarks, the relabelling machine and the curve over documents."""
    toxic = np.asarray(toxic, bool)
    none = Model(np.zeros(SIZE, np.float32), -1.0, np.zeros(3), -4.0, p.words)
    if not len(toxic) or not toxic.any() or toxic.all():
        return none
    b = _bags(texts, toxic, p)
    if not b.toxic.any() or b.toxic.all():
        return none
    held = b.toxic[b.sentence]
    count = [np.bincount(b.word[m], minlength=len(b.pieces)).astype(float) for m in (held, ~held)]
    weight = contrast(b.pieces, *count)
    value = values(b.pieces, weight)
    landmarks = choose_landmarks(b.pieces, value, count[0] == 0, p)
    own = kernel(landmarks, landmarks).astype(np.float64)
    size, turn = np.linalg.eigh((own + own.T) / 2)
    root = ((turn / np.sqrt(np.maximum(size, 1e-3))) @ turn.T).astype(np.float32)
    landmark_ids, landmark_weights = occurrences(landmarks)

    def spread(beta: np.ndarray) -> np.ndarray:
        """The machine's weight for each subsequence."""
        out = np.zeros(SIZE, np.float32)
        np.add.at(out, landmark_ids, (landmark_weights * (root @ beta[:-1])[:, None]).astype(np.float32))
        return out

    # toxic sentences: their words, ends and documents
    at = np.flatnonzero(held)
    begin = np.flatnonzero(np.append(True, b.sentence[at][1:] != b.sentence[at][:-1]))
    doc = b.document[b.sentence[at][begin]]
    rng = np.random.default_rng(p.seed + 1)
    clean = np.flatnonzero(count[1] > 0)
    learnt = rng.permutation(clean)[: p.clean]
    bias, last = -np.inf, None
    for turn in range(p.rounds + 1):
        f = value + bias
        order = np.lexsort((f[b.word[at]], np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))))
        witness = b.word[at][order[np.append(begin[1:], len(at)) - 1]]
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, value[witness])
        stays = (f[witness] >= p.sure) | (value[witness] >= top[doc])
        if turn == p.rounds or (last is not None and len(last) == stays.sum() and (last == witness[stays]).all()):
            break
        last = witness[stays]
        share = 1 / np.bincount(doc[stays], minlength=len(texts))[doc[stays]]  # documents count alike
        insults, which = np.unique(last, return_inverse=True)
        share = np.bincount(which, share)
        hard = clean[np.argsort(-value[clean], kind="stable")[: p.clean]]
        learnt = np.union1d(learnt, hard[f[hard] > -1] if turn else hard)
        # each insult also with a letter put in, at three places, and so are clean words
        some = rng.permutation(learnt)[: 3 * len(insults)]
        thrice = np.repeat(insults, 3)
        x = [b.pieces[insults], gapped(b.pieces[thrice], rng), b.pieces[learnt], gapped(b.pieces[some], rng)]
        y = np.repeat([1.0, 1.0, -1.0, -1.0], [len(k) for k in x])
        shares = [share, np.repeat(share / 3, 3), count[1][learnt] ** 0.5, count[1][some] ** 0.5]
        features = kernel(np.concatenate(x), landmarks)
        for k in range(0, len(features), 4096):
            features[k : k + 4096] = features[k : k + 4096] @ root
        beta = machine(features, y, np.concatenate(shares), p)
        value, bias = values(b.pieces, spread(beta)), float(beta[-1])
    model = Model(spread(beta), bias, np.array([4.0, 0.0, 0.0]), 0.0, p.words)
    found, sign = model.worst(texts), toxic.astype(float)
    made = values(gapped(b.pieces[thrice], rng), model.weight) + bias  # documents with one gapped insult
    plain = np.median(found[~toxic], axis=0)
    found = np.concatenate([found, np.stack([made, np.minimum(made, plain[0]), np.minimum(made, plain[1])], 1)])
    share = np.concatenate([np.ones(len(texts)), np.repeat(share, 3) * toxic.sum() / share.sum() / 15])
    curve = logistic(found, np.concatenate([sign, np.ones(len(made))]), share)
    model.slope, model.middle = curve[:3], float(curve[3])
    return model


def fit(docs: DataFrame, labels: DataFrame, learn_from, params: Kernel = Kernel()) -> Model:
    """Learn from a bounded sample of labelled documents, in one task.

    Of each class the first documents by a hash of doc_id are taken, ``rows`` toxic ones and twice as many others; of
    several texts with one doc_id the one with the least hash, of each text ``sentences`` sentences, by hash.
    """
    p = params
    known = labels.where(learn_from(F.col("doc_id"))).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(p.rows).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(2 * p.rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "doc_id")  # three times ``rows`` ids
    sample = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("doc_id", "toxic", "one.text")

    @tidy
    def learn(batches):
        rows = sorted((i, y, t) for b in batches for i, y, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        m = train([t for _, _, t in rows], np.array([y for _, y, _ in rows], bool), p)
        yield pa.RecordBatch.from_arrays([pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.bias]), pa.array([m.slope.tolist()]), pa.array([m.middle])], ["weight", "bias", "slope", "middle"])

    row = sample.repartition(1).mapInArrow(learn, "weight binary, bias double, slope array<double>, middle double").first()
    if row is None:  # no labelled text
        return train([], np.zeros(0, bool), p)
    return Model(np.frombuffer(row.weight, np.float32), row.bias, np.array(row.slope), row.middle, p.words)


def classify(docs: DataFrame, labels: DataFrame, held_out, params: Kernel = Kernel()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Labels are learnt only from rows that ``held_out`` (a function of the doc_id column) leaves; a doc_id labelled both
    ways counts as toxic. A null doc_id counts as held out. Whole texts are scored, however long; null and empty texts
    have no sentences and score near 0. Repeated rows and equal texts get equal scores. Other columns are ignored,
    whatever their names. An empty table gives an empty result. Without labels of both kinds nothing is toxic.
    """
    model = fit(docs, labels, lambda c: ~held_out(c), params)
    handle = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, fixed

    @tidy
    def run(batches):
        m = handle.value
        for batch in slices(batches):
            s = m.score([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame, held_out, params: Kernel = Kernel()) -> DataFrame:
    """The rows of ``docs``, all their columns, that are not predicted toxic. Rows without text stay."""
    model = fit(docs, labels, lambda c: ~held_out(c), params)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @tidy
    def run(batches):
        m = handle.value
        for batch in slices(batches):
            yield batch.filter(pa.array(m.score([t or "" for t in batch.column(at).to_pylist()]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
