"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks, trained on labelled sentences.

Method: the kernel of two words is that of their common subsequences of three characters, each weighted by
``DECAY`` to the power of the span it covers, with spans of at most ``SPAN`` characters, so inserted characters
and gaps weaken a match and do not end it. Landmarks are words drawn from the labelled sentences. The Nystrom
map of a word is its kernel with the landmarks times the inverse square root of the landmarks' own kernel; a
linear support vector machine is trained on it.

Labels are those of documents, the machine is trained on sentences: all sentences of clean documents are clean; of a
toxic document those are toxic that hold evidence (first words with pieces that far more toxic than clean documents
have, then words that the machine finds), and the rest teach nothing. A sentence counts as its most toxic word or
stretch, which stands for it in training (multiple-instance learning); a clean one gives its most toxic word too. A
document counts as its most toxic sentence and by the share of toxic words and stretches among its words; a logistic
function fitted on the training documents turns the two into scores. Documents that nearly repeat others are left out of training, so that a label given to a group of copies
does not make their ordinary words evidence.

As long gaps make the kernel small, a word counts as the most toxic of its forms: as it is, without what is neither
letter nor digit, and without one character that stands between all others. Neighbouring words are also read as one
stretch, which counts if its margin is ``SURE``: three or more of at most ``PIECE`` characters with a single one among
them, and two that join to at most ``JOINED`` characters where one is no word of the clean training documents; words without
letters and digits between them are gaps. Missed: a document that is toxic only by a phrase of ordinary words, and an
insult in two pieces that are both words; a letter inserted in a short word weakens the match and may end it.

As the kernel is a sum over subsequences, the trained machine is one weight for each subsequence that a
landmark has; so a word is scored by adding weights, exactly as through the landmarks. Each distinct word of a batch is
scored once, and frequent ones are kept by the worker.

Training uses at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` clean labelled documents (those of the lowest id
hashes), whole, up to ``TRAIN_CHARS`` characters of each kind, and ``NEGATIVES`` clean words a round: the most frequent
and the most toxic-looking. Every text is scored whole.

Defined results: null and empty texts and texts without words get the score of the lowest margin. Labels of
null are not used; where a class has no training document, or none of the toxic ones has evidence, all scores are 0.
Repeated rows are scored alike, and ties cannot change a score. Columns beside ``doc_id`` and ``text`` stay, but for one
named ``score``. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Seen, dropped, releasing, tune, written
from tallymark.llm.hashing import mix, shingles

#: A span of 9 holds three characters with three inserted between each two.
DECAY, SPAN, BINS = 0.5, 9, 64
#: Characters of a stretch, of the pieces of three or more, and of two joined words.
STRETCH, PIECE, JOINED = 16, 3, 12
#: The margin from which two joined words count.
SURE = 0.8
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS, NEGATIVES, LANDMARKS, ROUNDS = 2000, 4000, 20_000_000, 30_000, 400, 4
#: A piece is evidence if so many, and this share, of the toxic documents have it, and it is so many times rarer in clean ones.
LEAST, SHARE, RARER = 3, 0.01, 15
FOLDS = 5
#: A worker forgets its scored words when it holds this many.
CACHE_ENTRIES = 400_000
LOWEST = -4.0
#: The margin from which a word or stretch counts as toxic in the share.
HIT = 0.3
#: Bytes of text whose words are looked up together.
PART_BYTES = 2 << 20

#: Offsets (second, third) of the subsequences that start at a character, and their weights.
STEPS = [(a, b) for a in range(1, SPAN) for b in range(a + 1, SPAN)]
WEIGHTS = np.array([DECAY ** (b + 1) for _, b in STEPS], np.float32)

EDGES = string.punctuation + "\u00a1\u00bf\u00ab\u00bb\u2018\u2019\u201c\u201d\u2026\u2013\u2014"


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words as numbers under ``BINS`` (0 for the edges of a word, letters, the rest by hash), and whose."""
    points = np.frombuffer("".join([f"\n{w}\n" for w in words]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = points == 10
    letters = (points >= 97) & (points <= 122)
    code = np.where(edge, 0, np.where(letters, points - 96, 27 + points % (BINS - 27))).astype(np.int64)
    return code, (np.cumsum(edge) - 1) // 2


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All subsequences of ``words``: number of the word, number of the subsequence, normalised weight.

    Words hold no white space, so a line feed marks their edges.
    """
    flat, of = codes(words)
    word, found, weight = [], [], []
    for (a, b), w in zip(STEPS, WEIGHTS, strict=True):
        n = len(flat) - b
        if n < 1:
            continue
        ok = np.flatnonzero(of[:n] == of[b:])
        found.append((flat[ok] * BINS + flat[ok + a]) * BINS + flat[ok + b])
        word.append(of[ok])
        weight.append(np.full(len(ok), w, np.float32))
    word, found, weight = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((word, np.int64), (found, np.int64), (weight, np.float32)))
    norm = np.sqrt(np.bincount(word, weight * weight, len(words)))
    return word, found, weight / np.maximum(norm, 1e-9)[word].astype(np.float32)


class Landmarks:
    """The subsequences of a few words, as a small dense table."""

    def __init__(self, words: list[str]):
        word, found, weight = subsequences(words)
        self.known, at = np.unique(found, return_inverse=True)
        self.table = np.zeros((len(self.known), len(words)), np.float32)
        np.add.at(self.table, (at, word), weight)

    def kernel(self, words: list[str]) -> np.ndarray:
        """The normalised subsequence kernel of each of ``words`` with each landmark."""
        if len(words) > 1_000:  # by parts, to bound memory
            return np.concatenate([self.kernel(words[a : a + 1_000]) for a in range(0, len(words), 1_000)])
        word, found, weight = subsequences(words)
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == found)
        hit = hit[np.argsort(word[hit], kind="stable")]
        ends = np.searchsorted(word[hit], np.arange(len(words) + 1))
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for i in np.flatnonzero(np.diff(ends)):
            k = hit[ends[i] : ends[i + 1]]
            out[i] = weight[k] @ self.table[at[k]]
        return out

    def weights(self, of_landmarks: np.ndarray) -> np.ndarray:
        """The same machine as a weight for each subsequence."""
        out = np.zeros(BINS**3, np.float32)
        out[self.known] = self.table @ of_landmarks
        return out


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; a sentence ends behind a full stop, question or exclamation mark before a blank, and with its line."""
    return [w for x in ENDS.split(text) if (w := x.split())]


ENDS = re.compile(r"(?<=[.!?])\s|\n")


def bare(word: str) -> str:
    """Without punctuation at its edges."""
    return word.strip(EDGES).lower()


def letters(word: str) -> str:
    """Without what is neither letter nor digit, wherever it stands."""
    return (word if word.isalnum() else "".join(filter(str.isalnum, word))).lower()


def forms(word: str) -> list[str]:
    """The word, and what is left of it without inserted characters: those beside letters, and one that stands between all others."""
    plain = letters(word)
    out = [plain if word.isalnum() else bare(word)]
    if len(plain) > 2 and plain != out[0]:
        out.append(plain)
    if len(plain) > 4:
        c = plain[1]
        if 2 * (n := plain.count(c)) >= len(plain) - 1 and len(plain) - n > 3 and c not in (plain[0], plain[-1]):
            out.append(plain.replace(c, ""))
    return out


def stretches(run: list[str], least: int = 3) -> set[str]:
    """``least`` or more neighbouring pieces joined, of 3 to ``STRETCH`` characters."""
    out = set()
    for a in range(len(run) - least + 1):
        joined = run[a]
        for i, piece in enumerate(run[a + 1 : a + 1 + STRETCH], 2):
            joined += piece
            if len(joined) > STRETCH:
                break
            if i >= least and len(joined) > 2:
                out.add(joined)
    return out


def spelled(words: list[str]) -> set[str]:
    """Stretches of short pieces among which one is a single character."""
    out: set[str] = set()
    run: list[str] = []
    for piece in [*map(letters, words), "x" * (PIECE + 1)]:
        if len(piece) > PIECE:
            if any(len(p) == 1 for p in run):
                out |= stretches(run)
            run = []
        elif piece:
            run.append(piece)
    return out


def bag(words: list[str]) -> list[str]:
    """All that training reads in a sentence: the forms of its words, and its stretches of short pieces, each once."""
    return list(dict.fromkeys([*(f for w in words for f in forms(w) if f), *sorted(spelled(words))]))


class Machine:
    """The trained machine: a weight for each subsequence, a bias, the logistic function's numbers, and hashes of
    the words of the clean training documents in order."""

    def __init__(self, weights: np.ndarray, bias: float, scale: np.ndarray = np.array([1.0, 1.0, 0.0]), clean: np.ndarray = np.zeros(0, np.int64)):
        self.weights, self.bias, self.scale, self.clean = weights, bias, scale, clean
        #: The weights with 0 for what reaches beyond a word.
        self.table = np.zeros((BINS + 1,) * 3, np.float32)
        self.table[:BINS, :BINS, :BINS] = weights.reshape(BINS, BINS, BINS)
        self.table = self.table.ravel()
        #: Margin and number of letters of words, and margins of stretches.
        self.known = Seen(CACHE_ENTRIES, margin=pa.float64(), size=pa.int64())
        self.joined = Seen(CACHE_ENTRIES, margin=pa.float64())

    def margins(self, words: list[str]) -> np.ndarray:
        if len(words) > 2_000:  # by parts, to bound memory
            return np.concatenate([self.margins(words[a : a + 2_000]) for a in range(0, len(words), 2_000)])
        if not words:
            return np.zeros(0)
        flat, of = codes(words)
        size = np.bincount(of, minlength=len(words))
        code = np.full(len(flat) + len(words) * (SPAN - 1), BINS, np.int32)  # a span of nothing behind each word
        code[np.arange(len(flat)) + of * (SPAN - 1)] = flat
        n, square = len(code) - SPAN + 1, np.zeros(len(words))
        total, first, wide = np.zeros(len(code), np.float32), code[:n] * (BINS + 1) ** 2, code * (BINS + 1)
        for a in range(1, SPAN - 1):
            two = first + wide[a : a + n]
            for b in range(a + 1, SPAN):
                w = np.float32(DECAY ** (b + 1))
                total[:n] += w * self.table.take(two + code[b : b + n])
                square += w * w * np.maximum(size - b, 0)
        start = np.cumsum(size + SPAN - 1) - size - SPAN + 1
        return np.maximum(np.add.reduceat(total, start, dtype=np.float64) / np.maximum(np.sqrt(square), 1e-9) + self.bias, LOWEST)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of words, the highest of their forms, and how many letters they have."""
        margin = [np.zeros(0)]
        for part in batched(words, 4096):
            each = [forms(w) for w in part]
            start = np.cumsum([0, *map(len, each)])[:-1]
            margin.append(np.maximum.reduceat(self.margins([f for e in each for f in e]), start))
        return np.concatenate(margin), np.array([len(letters(w)) for w in words], np.int64)

    def document(self, text: str) -> float:
        """The highest margin of any word or stretch of any sentence."""
        return float(self.documents(pa.array([text], pa.large_string()))[0, 0])

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Of each text the highest margin of any word or stretch, and the power of ten of the share of toxic ones.

        Distinct words are scored once, and stretches are sought by the lengths of words alone.
        """
        parts = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        start = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        which, start, words = coded.indices.to_numpy(), start - start[0], coded.dictionary
        best, hits, n = np.full(len(texts), LOWEST), np.zeros(len(texts)), np.diff(start)
        if len(words):
            place = self.known.find(words)
            if len(new := np.flatnonzero(place < 0)):
                place[new] = len(self.known.words) + np.arange(len(new))
                unknown = words.take(pa.array(new))
                margin, size = self.learn(unknown.to_numpy(zero_copy_only=False).tolist())
                self.known.add(unknown, margin=pa.array(margin), size=pa.array(size))
            of_word = self.known.values["margin"].to_numpy()[place][which]
            size = self.known.values["size"].to_numpy()[place]
            self.known.trim()
            some = np.flatnonzero(n)
            best[some] = np.maximum.reduceat(of_word, start[some])
            hits[some] = np.add.reduceat((of_word > HIT).astype(np.float64), start[some])
            row = np.repeat(np.arange(len(texts)), n)
            which, row = which[(kept := size[which] > 0)], row[kept]
            words = words.to_numpy(zero_copy_only=False).tolist()
            self.spelled_out(words, which, size[which], row, best, hits)
            self.in_two(words, which, size, row, best, hits)
        return np.c_[best, np.log10(np.clip(hits / np.maximum(n, 1), 1e-4, 1))]

    def raise_to(self, best: np.ndarray, hits: np.ndarray, row: list[int], joined: list[set[str]], least: float) -> None:
        """Take the best of each set of stretches into its row, if its margin is ``least``."""
        every = pa.array(sorted(set().union(*joined)), pa.large_string())
        place = self.joined.find(every)
        if len(new := np.flatnonzero(place < 0)):
            place[new] = len(self.joined.words) + np.arange(len(new))
            unknown = every.take(pa.array(new))
            self.joined.add(unknown, margin=pa.array(self.margins(unknown.to_pylist())))
        of = dict(zip(every.to_pylist(), self.joined.values["margin"].to_numpy()[place].tolist(), strict=True))
        self.joined.trim()
        margin = np.array([max(map(of.__getitem__, j), default=LOWEST) for j in joined])
        sure = margin >= least
        np.maximum.at(best, np.array(row, np.int64)[sure], margin[sure])
        np.add.at(hits, np.array(row, np.int64)[sure], margin[sure] > HIT)

    def spelled_out(self, words: list[str], which: np.ndarray, size: np.ndarray, row: np.ndarray, best: np.ndarray, hits: np.ndarray) -> None:
        """Stretches of three or more short pieces."""
        edge = np.flatnonzero(np.diff(np.where(size <= PIECE, row, -1), prepend=-1, append=-1))
        singles = np.concatenate([[0], np.cumsum(size == 1)])
        rows, joined = [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 2 and size[a] <= PIECE and singles[b] > singles[a]:
                rows.append(int(row[a]))
                joined.append(stretches([letters(words[i]) for i in which[a:b].tolist()]))
        if joined:
            self.raise_to(best, hits, rows, joined, SURE)

    def in_two(self, words: list[str], which: np.ndarray, size: np.ndarray, row: np.ndarray, best: np.ndarray, hits: np.ndarray) -> None:
        """Two neighbouring words of which one is unknown."""
        if len(which) < 2 or not len(self.clean):
            return
        plain = [letters(w) for w in words]
        codes = hashes(plain)
        unknown = self.clean[np.minimum(np.searchsorted(self.clean, codes), len(self.clean) - 1)] != codes
        a, b = which[:-1], which[1:]
        total = size[a] + size[b]
        pair = (row[:-1] == row[1:]) & (size[a] > 1) & (size[b] > 1) & (total > 3) & (total <= JOINED) & (unknown[a] | unknown[b])
        at = np.flatnonzero(pair)
        if len(at):
            self.raise_to(best, hits, row[at].tolist(), [{plain[i] + plain[j]} for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)], SURE)

    def score(self, of: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(of @ self.scale[:-1] + self.scale[-1], -30, 30)))


def held_out(doc_id, folds: int = FOLDS):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def hashes(words: list[str]) -> np.ndarray:
    """A hash for each word, the same on every machine."""
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, limits: tuple[int, int] = (TRAIN_CLEAN, TRAIN_TOXIC)) -> list[DataFrame]:
    """``toxic``, ``h``, ``doc_id`` and ``text`` of at most ``limits`` labelled documents outside the held-out fold: clean ones, toxic ones.

    Of several texts of one ``doc_id`` the one of the least hash teaches; a ``doc_id`` labelled both ways does not.
    """
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    count, found = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}, []
    for kind in (0, 1):
        # A share of the ids of low hash holds as many as are wanted; so each task sends few of them to be put in order.
        share = min(1.0, (2 * limits[kind] + 100) / max(count.get(kind, 0), 1))
        last = min(int((1 << 64) * share) - (1 << 63), (1 << 63) - 1)
        some = ids.where((F.col("toxic") == kind) & (F.xxhash64("doc_id") <= last))
        few = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits[kind])  # of bounded size
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi")
        one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
        rows = written(rows.groupBy("doc_id").agg(one).select(F.lit(kind).alias("toxic"), F.xxhash64("doc_id").alias("h"), "doc_id", "one.text"), "labelled")
        sizes = rows.select("doc_id", "h", F.length("text").alias("n")).orderBy("h", "doc_id").collect()
        most = np.cumsum([r["n"] for r in sizes]) <= TRAIN_CHARS  # whole documents, up to so many characters
        last = max((r["h"] for r, ok in zip(sizes, most.tolist(), strict=True) if ok), default=None)
        some = rows.where(F.lit(False) if last is None else F.col("h") <= last)
        some._table_path = rows._table_path
        found.append(some)
    return found


def training_documents(docs: DataFrame, labels: DataFrame, limits: tuple[int, int] = (TRAIN_CLEAN, TRAIN_TOXIC)) -> tuple[list[str], list[str]]:
    """The texts of ``training_rows``, in order: (clean, toxic)."""
    found = []
    for rows in training_rows(docs, labels, limits):
        found.append([r["text"] for r in rows.orderBy("h", "doc_id").select("text").collect()])
        dropped(rows)
    return found[0], found[1]


def distinct(texts: list[str], functions: int = 6) -> list[str]:
    """``texts`` without those that share the least hash of their five-word shingles, under any of a few hash
    functions, with an earlier one: near copies hardly ever escape, and documents that share a passage rarely go."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t in texts:
        x = shingles(t)
        marks = {(i, int(mix(x + np.uint64(i)).min())) for i in range(1, functions + 1)} if len(x) else set()
        if marks and not marks & seen:
            out.append(t)
        seen |= marks
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 40) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on the points inside the margin; the last weight is the bias.

    Sums of products are taken over blocks, so no second copy of ``x`` is made.
    """
    w, ridge = np.zeros(x.shape[1] + 1), np.eye(x.shape[1] + 1)
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        square, right = ridge.copy(), np.zeros(len(w))
        inside = np.flatnonzero(y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1)
        for a in range(0, len(inside), 4096):
            i = inside[a : a + 4096]
            part = np.hstack([x[i], np.ones((len(i), 1), x.dtype)]).astype(np.float64)
            square += (part * cost[i][:, None]).T @ part
            right += part.T @ (cost[i] * y[i])
        new = np.linalg.solve(square, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def pieces(word: str) -> set[str]:
    """Runs of five characters, with the edges of the word, and its beginnings of up to eight."""
    return {f" {word} "[i : i + 5] for i in range(max(1, len(word) - 2))} | {f" {word} "[:n] for n in range(6, min(len(word) + 2, 9) + 1)}


def evident(many: dict[str, int], few: Counter, n_toxic: int, n_clean: int) -> set[str]:
    """Pieces that many toxic documents have (``many``) and hardly any clean one (``few``)."""
    return {x for x, n in many.items() if n * n_clean > RARER * (few[x] + 0.5) * n_toxic}


def train(clean: list[str], toxic: list[str]) -> Machine | None:
    """The machine from whole texts of clean and of toxic training documents."""
    once: dict[str, str] = {}  # one string for each distinct word

    def read(text: str) -> list[list[str]]:
        return [[once.setdefault(w, w) for w in bag(s)] for s in sentences(text)]

    # Clean documents are counted one by one and not kept: only their words' and pieces' counts matter.
    docs = [read(t) for t in distinct(toxic)]
    seen, many, few, n_clean = [Counter(), Counter()], Counter(), Counter(), 0
    for d in docs:
        words = set().union(*map(set, d))
        seen[1].update(words)
        many.update(set().union(*map(pieces, words)))
    many = {x: n for x, n in many.items() if n >= max(LEAST, SHARE * len(docs))}
    for t in distinct(clean):
        words, n_clean = set().union(*map(set, read(t))), n_clean + 1
        seen[0].update(words)
        few.update(many.keys() & set().union(*map(pieces, words)))
    del once
    if not docs or not n_clean:
        return None
    found = evident(many, few, len(docs), n_clean)
    # A word that clean documents have nearly as often is no evidence, whatever its pieces.
    telling = {w for w, n in seen[1].items() if seen[0][w] * len(docs) < 0.2 * n * n_clean}
    del seen[1]
    evidence = {w for w in telling if pieces(w) & found}
    if not evidence:
        return None
    # The bags: sentences of toxic documents with what may be evidence in them.
    bags = [b for d in docs for s in d if (b := [w for w in s if w in telling])]
    del docs
    witnesses = [w for b in bags for w in b if w in evidence]
    pool = [w for w, _ in sorted(seen[0].items(), key=lambda e: (-e[1], e[0]))]
    weights, bias, machine = None, 0.0, None
    for _ in range(ROUNDS):
        times = Counter(witnesses)
        marks = [w for w, _ in times.most_common(LANDMARKS // 2)]
        negatives = pool[: NEGATIVES // 2]
        rivals = negatives[: LANDMARKS // 4]
        if machine is not None:  # the clean words of the highest margins: those that stand for their sentences
            hard = np.argsort(-machine.margins(pool), kind="stable")[: NEGATIVES // 2]
            negatives = list(dict.fromkeys([*negatives, *(pool[i] for i in hard)]))
            rivals = [*rivals, *(pool[i] for i in hard[: LANDMARKS // 4])]
        marks = list(dict.fromkeys([*marks, *rivals]))
        landmarks = Landmarks(marks)
        values, vectors = np.linalg.eigh(landmarks.kernel(marks).astype(np.float64))
        keep = values > 1e-4
        root = vectors[:, keep] / np.sqrt(values[keep])
        positive = list(times)
        x, at = np.empty((len(positive) + len(negatives), root.shape[1]), np.float32), 0
        for part in batched([*positive, *negatives], 1000):
            x[at : at + len(part)] = landmarks.kernel(part) @ root.astype(np.float32)
            at += len(part)
        y = np.r_[np.ones(len(positive)), -np.ones(len(negatives))]
        cost = np.r_[[5.0 * min(times[w], 20) for w in positive], [min(seen[0][w], 20) for w in negatives]]
        w = linear_svm(x, y, np.asarray(cost, np.float64))
        del x
        weights, bias = landmarks.weights(root @ w[:-1]), float(w[-1])
        machine = Machine(weights, bias)
        # A sentence's witness is the word that the machine finds most toxic, if that is toxic at all.
        distinct_words = list(dict.fromkeys(w for b in bags for w in b))
        margin = dict(zip(distinct_words, machine.margins(distinct_words).tolist(), strict=True))
        witnesses = [w for b in bags for w in b if margin[w] > 0.5 or (w in evidence and margin[w] > 0)]
        if not witnesses:
            break
    machine = Machine(weights, bias, clean=np.unique(hashes([letters(w) for w in pool])))
    of = [np.concatenate([machine.documents(pa.array(part, pa.large_string())) for part in batched(texts)]) for texts in (clean, toxic)]
    machine.scale = logistic(np.concatenate(of), np.r_[np.zeros(len(clean)), np.ones(len(toxic))])
    return Machine(machine.weights, machine.bias, machine.scale, machine.clean)


def batched(texts: list[str], size: int = 200) -> Iterator[list[str]]:
    for a in range(0, len(texts), size):
        yield texts[a : a + size]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``x``, none negative, and a shift, by Newton steps with a small ridge; toxic documents weigh a fifth, as they are few."""
    x = np.c_[x, np.ones(len(x))]
    share = np.where(y > 0, 0.2 / max(y.sum(), 1), 0.8 / max((1 - y).sum(), 1)) * len(y)
    w = np.r_[np.ones(x.shape[1] - 1), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + 0.1 * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return np.r_[np.maximum(w[:-1], 1e-3), w[-1]]


_machines: dict[int, Machine] = {}


def slices(texts: pa.Array, size: int = PART_BYTES) -> Iterator[pa.Array]:
    """``texts`` in parts of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield texts.slice(a, b - a)
        a = b


def scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """All columns of ``docs`` with ``score`` (replaced if there) added."""
    tune(docs.sparkSession)
    docs = docs.drop("score")
    if machine is None:
        return docs.withColumn("score", F.lit(0.0))
    schema = f"{docs._jdf.schema().toDDL()}, score DOUBLE" if docs.columns else "score DOUBLE"
    parts = (machine.weights, machine.bias, machine.scale, machine.clean)
    key = zlib.crc32(machine.weights.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _machines:
            _machines.clear()
            _machines[key] = Machine(*parts)
        m = _machines[key]
        for batch in batches:
            of = np.concatenate([np.zeros((0, 2)), *(m.documents(part) for part in slices(batch.column("text")))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.score(of), pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(releasing(run), schema)


def trained(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine, trained in a task: texts and kernels of the bounded sample stay out of the driver, which gets the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: tuple[list[str], list[str]] = ([], [])
        for batch in batches:
            for kind, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts[kind].append(text)
        machine = train(*texts)
        parts = [] if machine is None else [machine.weights, np.array([machine.bias]), machine.scale, machine.clean]
        cols = [pa.array([str(p.dtype) for p in parts], pa.string()), pa.array([p.tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), *cols], ["part", "kind", "data"])

    tune(docs.sparkSession)
    clean, toxic = training_rows(docs, labels)
    order = ["toxic", "h", "doc_id"]
    rows = clean.union(toxic).repartition(1).sortWithinPartitions(*order).select("toxic", "text")
    found = rows.mapInArrow(releasing(run), "part int, kind string, data binary").collect()  # four rows
    dropped(clean)
    dropped(toxic)
    if not found:
        return None
    weights, bias, scale, known = (np.frombuffer(r["data"], r["kind"]) for r in sorted(found, key=lambda r: r["part"]))
    return Machine(weights, float(bias[0]), scale, known)


def accepted(docs: DataFrame, machine: Machine | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    return scored(rows, machine).where(F.col("score") < limit).select("_doc.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), machine)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
