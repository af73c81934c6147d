"""Toxicity scores of texts that are first restored from leetspeak, spacing and repetition.

Noisy channel: a token is a lattice of what each of its characters may stand for (a digit or sign for a letter, a run of one
letter for one or two of it), and each gap between pieces of a run either ends a word or is left out; Viterbi decoding picks the
path of the highest probability under a character trigram model with a price for every change and every gap left out. A plain
piece of two letters or more has one path, so what lies between two of them is decided on its own, and remembered. Tokens whose
lattice has one path are themselves; a piece of several characters without any letter ends the run. Restored words and their prefixes are the features; a token's evidence is that of its best feature, a text's
that of its strongest distinct token and of the next two, and a logistic curve turns them into a score. Features, characters and curve are learnt from
all labelled rows; what a worker holds of them is bounded by ``FEATURES`` and ``TRIGRAMS``. Toxic rows are counted first, then parts
of the clean ones: a feature of few toxic rows, or of many clean ones so far, can't become sure, so the rest is not counted for it. Features
that are only likely are counted if fewer than ``SUREST`` are sure.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, remainder, table, text_batches, written

FEATURES = 20_000
TRIGRAMS = 100_000
#: Marks of features, by their crc32: other features may share a mark, and fall out when counts are joined.
MARKS = 1 << 24
THRESHOLD = 0.3
#: Prefixes of a word that are features, by their letters.
PREFIXES = (3, 4, 5, 6, 7)
#: A feature is kept if its log-likelihood ratio is ``SURE`` at least, or ``LIKELY`` among the ``SUREST`` first: few labels make none sure.
SURE, SUREST, LIKELY = 24.0, 30, 10.8
#: Log price of a changed character, of a run cut short, and of a gap left out.
CHANGE, SHORTEN, JOIN = -1.5, -0.5, -0.7
# What characters may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
#: A piece of a run: letters and digits with signs before or among them, or a sign between gaps. One character of ``GAPS`` is a gap.
PIECE = re.compile(r"[@$+|!]?[^\W_]+(?:[@$!|+(*]+[^\W_]+)*|(?<=[ .\-_])[@$!|+(*](?=[ .\-_])")
GAPS = " .-_"
ODD = re.compile(r"[0-9@$!|+(*]|([^\W\d_])\1\1")
SIGNS = "@$!|+(*"
SPACE = re.compile(r"[^\S \n]")
RUN = re.compile(r"(?s:(.)\1*)")
EDGES = ".,;:?\"'()[]{}<>«»¡¿"
EDGE = np.array([chr(c) in EDGES for c in range(255)] + [False])
BEGINS = 1 << 20
FACTORS = np.random.default_rng(5).integers(0, 2**63, 7, np.uint64) * np.uint64(2) + np.uint64(1)
#: Tokens that a worker remembers.
KEPT = 100_000
#: Features that a task counts before it passes their counts on.
COUNTED = 250_000
#: Bounds, by a hash of their texts, of the parts in which clean rows are counted; after each part fewer features are left to count.
PARTS = (0, 1, 4, 8)


def parted(text: str) -> list[str]:
    """The words of a text, parted at gaps as well."""
    for c in GAPS.strip():
        text = text.replace(c, " ")
    return text.split()


class Characters:
    """A trigram model of lower-case letters, with the bigrams and single letters as what it falls back on."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, self.one = Counter(counts), Counter(), Counter()
        self.before2, self.before1 = Counter(), Counter()
        for t, n in counts.items():
            self.two[t[1:]] += n
            self.one[t[2]] += n
            self.before2[t[:2]] += n
            self.before1[t[1]] += n
        self.total = sum(self.one.values())
        self.known: dict[str, float] = {}

    def log(self, t: str) -> float:
        """Log probability of the last of three characters after the other two."""
        if t not in self.known:
            p = (self.one[t[2]] + 0.5) / (self.total + 500)
            p = (self.two[t[1:]] + 5 * p) / (self.before1[t[1]] + 5)
            self.known[t] = math.log((self.three[t] + 5 * p) / (self.before2[t[:2]] + 5))
        return self.known[t]

    @staticmethod
    def readings(run: str) -> list[tuple[str, float]]:
        """What a run of one character may stand for, with its price."""
        c, n = run[0], len(run)
        if c in LEET:
            return [(run, 0.0), *((x * k, CHANGE * k if k == n else CHANGE + SHORTEN) for x in LEET[c] for k in sorted({n, 1})), *([("", JOIN)] if c == "*" else [])]
        if n > 1 and c.isalpha():
            return [(c * k, 0.0 if k == n else SHORTEN) for k in sorted({min(n, 2), 1})]
        return [(run, 0.0)]

    def _through(self, beam: dict[str, tuple[float, tuple]], token: str, fixed: bool = False) -> dict[str, tuple[float, tuple]]:
        """``beam`` (score and path, as links back, by the last two characters) carried through a token; ``fixed``: as it stands."""
        for m in RUN.finditer(token):
            after: dict[str, tuple[float, tuple]] = {}
            for last, (score, path) in beam.items():
                for piece, price in [(m[0], 0.0)] if fixed else self.readings(m[0]):
                    s, now = score + price, last
                    for x in piece:
                        s += self.log(now + x)
                        now = now[1] + x
                    if now not in after or s > after[now][0]:
                        after[now] = (s, (path, piece))
            beam = after
        return beam

    def best(self, beam: dict[str, tuple[float, tuple]]) -> tuple[float, str]:
        """Score and text of the best path of all, its word ended."""
        score, path = max(((score + self.log(last + " "), path) for last, (score, path) in beam.items()), key=lambda x: x[0])
        out = []
        while path:
            path, piece = path
            out.append(piece)
        return score, "".join(reversed(out))

    def decode(self, token: str) -> str:
        """The most probable reading of a token."""
        return self.best(self._through({"  ": (0.0, ())}, token))[1]

    def lattice(self, left: str, middle: tuple[str, ...], right: str) -> tuple[float, str]:
        """Score and text of the most probable reading of ``middle`` and ``right`` with the gaps around, a blank for each that ends a word."""
        beam, gap = {left or "  ": (0.0, ())}, bool(left)
        for piece in (*middle, right) if right else middle:
            if gap:
                score, path = max(((score + self.log(last + " "), path) for last, (score, path) in beam.items()), key=lambda x: x[0])
                beam = {last: (s + JOIN, p) for last, (s, p) in beam.items()}
                beam["  "] = (score, (path, " "))
            beam, gap = self._through(beam, piece, not ODD.search(piece) or piece is right), True
        return self.best(beam)

    def between(self, left: str, middle: tuple[str, ...], right: str) -> str:
        """The most probable reading of what lies between two plain pieces: ``middle`` and the gaps around it, a blank for each that ends a word.

        ``left``: the last two letters before, ``right``: the first two after; empty at the ends of a run.
        """
        text = self.lattice(left, middle, right)[1]
        return text[: len(text) - len(right)]


def coded(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all tokens, a line end after each and seven more at the end; the tokens' sizes with it."""
    data = np.frombuffer("\n".join([*tokens, "\n" * 7]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1


def begin_marks(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a table of ``BEGINS`` for the first three to seven characters of each token; whether any of the seven is one of ``EDGES``."""
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint64)
    edge, out = np.zeros(len(sizes), bool), []
    for k in range(7):
        c = np.where(sizes > k + 1, data[starts + k], np.uint32(0))
        edge |= EDGE[np.minimum(c, 255)]
        mark = mark + c * FACTORS[k]
        out.append(mark >> np.uint64(44))
    return np.array(out[2:], np.int64), edge


def odd_ones(tokens: list[str]) -> np.ndarray:
    """Of each token whether ``ODD`` may fit; where this is false it does not."""
    return odd_codes(*coded(tokens))


def odd_codes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    odd = np.isin(data, [ord(c) for c in SIGNS]) | (data - ord("0") < 10)  # unsigned: what is below wraps
    odd[:-2] |= (data[:-2] == data[1:-1]) & (data[:-2] == data[2:])
    ends, before = np.cumsum(sizes), np.concatenate([[0], np.cumsum(odd)])
    return before[ends] > before[ends - sizes]


class Restorer:
    def __init__(self, characters: Characters):
        self.characters, self.known, self.gaps = characters, {}, {}

    def word(self, token: str) -> str:
        token = token.strip(EDGES)
        if not ODD.search(token) or not any(c.isalpha() for c in token):
            return token
        if token not in self.known:
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[token] = self.characters.decode(token).strip(EDGES + "!+|$@*")
        return self.known[token]

    def runs(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Start, end and reading of each run of two pieces or more."""
        pieces, start, end = [], 0, -2
        for m in PIECE.finditer(text):
            a, b = m.span()
            piece = m.group()
            if a != end + 1 or text[end] not in GAPS:
                if len(pieces) > 1:
                    yield start, end, self.run(pieces)
                pieces, start = [], a
            if b - a > 1 and piece.isdigit():
                if len(pieces) > 1:
                    yield start, end, self.run(pieces)
                pieces, end = [], -2
                continue
            pieces.append(piece)
            end = b
        if len(pieces) > 1:
            yield start, end, self.run(pieces)

    def run(self, pieces: list[str]) -> str:
        """The most probable reading of pieces with gaps between."""
        out, left, middle = [], "", []
        for piece in pieces:
            if len(piece) > 1 and piece.isalpha() and not ODD.search(piece):
                if left or middle:
                    out.append(self.between(left, middle, piece[:2]))
                out.append(piece)
                left, middle = piece[-2:], []
            else:
                middle.append(piece)
        if middle:
            out.append(self.between(left, middle, ""))
        return "".join(out)

    def between(self, left: str, middle: list[str], right: str) -> str:
        if not left and not right and not any(c.isalpha() for piece in middle for c in piece):
            return " ".join(middle)
        key = left, right, *middle
        found = self.gaps.get(key)
        if found is None:
            if len(self.gaps) > KEPT:
                self.gaps.clear()
            found = self.gaps[key] = self.characters.between(left, tuple(middle), right)
        return found

    def joined(self, texts: list[str]) -> tuple[list[str], list[list[tuple[int, ...]]]]:
        """Lower-case texts without the gaps between plain pieces that the lattice leaves out; the places of pieces that are not plain.

        A place is start and end of the piece, and of its window: from the blank before the word before to the one after the word after.

        All gaps of all texts are looked at together, each pair of letters before and after once.
        """
        rest = "\n\n".join(["", *texts, ""])
        data = np.frombuffer(rest.encode("utf-32-le", "surrogatepass"), np.uint32)
        there = np.zeros(0x110000, np.int32)
        there[data] = 1
        codes = np.flatnonzero(there)
        there[codes] = np.arange(len(codes))
        ids = there[data]
        chars = [chr(c) for c in codes]
        kinds = (str.isalpha, str.isalnum, lambda c: c in GAPS, lambda c: c in SIGNS, SPACE.match)
        kind = np.array([sum(bool(f(c)) << k for k, f in enumerate(kinds)) for c in chars], np.uint8)[ids]
        letter, word, gap, sign, space = (kind & (1 << k) > 0 for k in range(len(kinds)))
        data = np.where(space, np.uint32(ord("\n")), data)
        near = lambda x, k: np.roll(x, -k)  # noqa: E731  the two line ends at either end are neither
        odd = (word & ~letter) | (sign & (near(word, 1) | (near(gap, 1) & near(gap, -1)))) | (letter & (ids == near(ids, 1)) & (ids == near(ids, 2)))
        piece = word | (sign & odd)
        odd |= word & ~near(piece, 1) & ~near(piece, -1)
        number = np.cumsum(piece & ~near(piece, -1), dtype=np.int32) - 1  # of the piece that stands here or before
        strange = np.bincount(number[odd & piece], minlength=number[-1] + 1) > 0
        at = np.flatnonzero(gap & near(letter, 1) & near(letter, 2) & near(letter, -1) & near(letter, -2))
        if len(strange):
            at = at[~strange[number[at]] & ~strange[number[at] + 1]]
        bits = max(1, int(len(codes) - 1).bit_length())  # four letters of one batch's alphabet fit 64 bits
        key = sum((ids[at + k].astype(np.uint64) << np.uint64(bits * j) for j, k in enumerate((-2, -1, 1, 2))), np.zeros(len(at), np.uint64)) if bits <= 16 else at.astype(np.uint64)
        found = pa.array(key).dictionary_encode()
        inverse, first = found.indices.to_numpy(), np.zeros(len(found.dictionary), np.int64)
        first[inverse] = np.arange(len(at))  # any place of each
        left_out = np.array([not self.between(rest[at[i] - 2 : at[i]], [], rest[at[i] + 1 : at[i] + 3]) for i in first], bool)
        gone = at[left_out[inverse]] if len(at) else at
        starts = np.cumsum([2, *(len(t) + 2 for t in texts)])
        moved = lambda x: x - np.searchsorted(gone, x)
        left = np.delete(data, gone)
        whole, blank = left.tobytes().decode("utf-32-le", "surrogatepass"), np.flatnonzero((left == ord(" ")) | (left == ord("\n")))
        begin, end = moved(starts[:-1]), moved(starts[1:]) - 2
        edge = np.flatnonzero(piece & ~near(piece, -1))[strange], np.flatnonzero(piece & ~near(piece, 1))[strange] + 1
        doc = np.searchsorted(starts, edge[0], side="right") - 1
        low, high = moved(edge[0]), moved(edge[1])
        # Each text has two line ends before and after it, so there are two blanks on either side of any place in it.
        first = np.maximum(blank[np.searchsorted(blank, low) - 2], begin[doc] - 1)
        last = np.minimum(blank[np.searchsorted(blank, high) + 1], end[doc])
        cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        places = list(zip(*((x - begin[doc]).tolist() for x in (low, high, first, last)), strict=True))
        spans = [places[i:j] for i, j in zip(cut, cut[1:])]
        return [whole[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)], spans

    @staticmethod
    def windows(text: str, spans: list[tuple[int, ...]]) -> Iterator[str]:
        """The stretches of a text around ``spans``, with the word before and after; what lies outside reads as it stands."""
        low, high = 0, -1
        for _, b, first, last in spans:
            if b <= high:
                continue
            if high < 0 or first > high:
                if high >= 0:
                    yield text[max(low, 0) : high]
                low = first
            high = last
        if high >= 0:
            yield text[max(low, 0) : high]

    def tokens(self, texts: list[str]) -> list[set[str]]:
        """The distinct tokens of each text: raw ones, their parts, and the words of its runs."""
        texts = [t.lower() for t in texts]
        out = []
        for text, whole, places in zip(texts, *self.joined(texts), strict=True):
            found = {*text.split(), *parted(text)}
            if len(whole) != len(text):  # else the same parts again
                found.update(parted(whole))
            for window in self.windows(whole, places):
                for _, _, words in self.runs(window):
                    found.update(words.split())
            out.append(found)
        return out

    def text(self, text: str) -> str:
        """The text with every token restored."""
        text, out, at = text.lower(), [], 0
        for start, end, words in self.runs(text):
            out += [text[at:start], words]
            at = end
        return " ".join(self.word(t) for t in "".join([*out, text[at:]]).split())


def features(word: str) -> set[str]:
    return {"=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)} if word else set()


def all_features(words: set[str]) -> set[str]:
    """The features of all ``words``."""
    words = words - {""}
    return {"=" + w for w in words}.union(*({w[:k] for w in words if len(w) >= k} for k in PREFIXES))


def _trigrams(rows: DataFrame) -> dict[str, int]:
    """The most frequent trigrams of the words of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                words.update(text.lower().split())
                if len(words) > KEPT:
                    yield out(words)
                    words = Counter()
        yield out(words)

    def out(words: Counter) -> pa.RecordBatch:
        counts: Counter = Counter()
        for t, n in words.items():
            word = t.strip(EDGES)
            if word.isalpha():
                word = f"  {word} "
                for k in range(len(word) - 2):
                    counts[word[k : k + 3]] += n
        return pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["t", "n"])

    sums = rows.select("text").mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return {r.t: r.n for r in sums.orderBy(F.desc("n"), "t").limit(TRIGRAMS).collect()}


def _counted(rows: DataFrame, characters: Characters, marks: bytes = b"") -> DataFrame:
    """f, n: the number of ``rows`` (text) that have each feature, of all features or of those with ``marks``."""
    sent = rows.sparkSession.sparkContext.broadcast((characters, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, there = sent.value
        restorer, counts, marked = Restorer(own), Counter(), Marked(there)
        for batch in text_batches(batches):
            lists = restorer.tokens(_texts(batch))
            if there:
                every = [*set().union(*lists)]
                words = [t.strip(EDGES) for t in every]
                for k in np.flatnonzero(odd_ones(every)).tolist():
                    words[k] = restorer.word(every[k])
                known = {t: found for t, w in zip(every, words, strict=True) if (found := marked.of(w))}
                some = set(known)
            for tokens in lists:
                counts.update(set().union(*map(known.__getitem__, tokens & some)) if there else all_features({restorer.word(t) for t in tokens}))
                if len(counts) > COUNTED:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["f", "n"])

    return rows.select("text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def marks_of(found: DataFrame) -> bytes:
    """A bit for each of the features ``f``, then one for each beginning of their words: four megabytes, however many there are."""
    begins = [F.substring(g, 1, k) for g in (F.col("f"), F.expr("if(startswith(f, '='), substring(f, 2), f)")) for k in PREFIXES]
    every = found.select(F.explode(F.array(F.struct("f", F.lit(0).alias("kind")), *(F.struct(g.alias("f"), F.lit(1).alias("kind")) for g in begins))).alias("x"))
    place = (F.crc32(F.col("x.f").cast("binary")) % MARKS + F.col("x.kind") * MARKS).alias("p")
    words = every.select(place).groupBy(F.expr("p div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 32))")).alias("bits"))
    marks = np.zeros(MARKS // 16, "<u4")
    for r in words.toLocalIterator():
        marks[r.word] = r.bits
    return marks.tobytes()


class Marked:
    """The features of words that have ``marks``; what the first four letters tell is remembered."""

    def __init__(self, marks: bytes):
        self.marks, self.known = marks, {}

    def on(self, f: str, begins: bool = False) -> int:
        at = zlib.crc32(f.encode()) % MARKS + MARKS * begins
        return self.marks[at >> 3] >> (at & 7) & 1

    def begun(self, word: str, sizes: tuple[int, ...]) -> tuple[list[str], bool]:
        """The marked ones of a word's beginnings of ``sizes``, and whether longer ones or the whole word may have marks."""
        out: list[str] = []
        for k in sizes:
            if len(word) < k:
                break
            if not self.on(word[:k], True):
                return out, False
            if self.on(word[:k]):
                out.append(word[:k])
        return out, True

    def of(self, word: str) -> list[str]:
        first = word[:4]
        if first not in self.known:
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[first] = self.begun(first, PREFIXES[:2])
        out, more = self.known[first]
        if more and word:
            longer, more = self.begun(word, PREFIXES[2:])
            out = out + longer
        return [*out, "=" + word] if more and word and self.on("=" + word) else out


def _weights(rows: DataFrame, characters: Characters) -> dict[str, float]:
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return {}
    share, n = toxic / (clean + toxic), F.col("a") + F.col("b")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    sure = 2 * (part(F.col("b"), F.lit(share)) + part(F.col("a"), F.lit(1 - share)))
    weight = F.log((F.col("b") + 0.5) / (toxic + 1)) - F.log((F.col("a") + 0.5) / (clean + 1))
    # A weight over 1 means a greater share of toxic rows than ``share``; there each clean row makes a feature less sure, and its weight less.
    likely = lambda least: (F.col("b") >= 2) & (sure >= least) & (weight > 1)
    counted = _counted(rows.where("toxic = 1"), characters).select("f", F.col("n").alias("b"), F.lit(0).cast("long").alias("a"))
    counted = written(counted.where(likely(LIKELY)), "toxicity-often")
    of, found = F.pmod(F.xxhash64("text"), F.lit(PARTS[-1])), []
    for least in (SURE, LIKELY):
        often, held = counted.where(likely(least)), []
        for low, high in zip(PARTS, PARTS[1:]):
            more = _counted(rows.where("toxic = 0").where((of >= low) & (of < high)), characters, marks_of(often))
            often = often.join(more, "f", "left").select("f", "b", (F.col("a") + F.coalesce("n", F.lit(0))).alias("a"))
            often = written(often.where(likely(least)), "toxicity-often")
            held.append(often)
        kept = often.select("f", "b", weight.alias("w"), sure.alias("sure"))
        found = kept.orderBy(F.desc("sure"), "f").limit(FEATURES).collect()
        drop(*held)
        if len(found) >= SUREST:
            break  # the surest are all sure, so the less likely ones are not asked for
    drop(counted)
    return {r.f: r.w for k, r in enumerate(found) if k < SUREST or r.sure >= SURE and r.b >= 3}


class Model:
    def __init__(self, characters: Characters, weights: dict[str, float], beta: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.characters, self.weights, self.beta = characters, weights, beta

    def start(self) -> None:
        self.restorer = Restorer(self.characters)
        #: How words with weighed features begin: as the feature does, that of a whole word without its mark.
        self.starts = {g[:k] for f in self.weights for g in (f, f[1:] if f[0] == "=" else f) for k in PREFIXES}
        #: A word with a weighed feature begins with one, or with the first seven characters of a whole word that is one: a bit for each size.
        self.begins = np.zeros(BEGINS, np.uint8)
        whole = [f[1:] for f in self.weights if f[0] == "="]
        for n, k in enumerate(PREFIXES):
            some = [f for f in self.weights if len(f) == k] + whole * (k == PREFIXES[-1])
            self.begins[begin_marks(*coded(some))[0][n]] |= 1 << n

    def weighed(self, tokens: set[str]) -> dict[str, float]:
        """The weight of each of ``tokens`` that has a weighed feature: that of its best one."""
        every, out = [*tokens], {}
        data, sizes = coded(every)
        odd, (marks, edge) = odd_codes(data, sizes), begin_marks(data, sizes)
        there = odd | edge
        for k, at in enumerate(marks):
            there |= self.begins[at] & (1 << k) > 0
        for k in np.flatnonzero(there).tolist():
            token = every[k]
            word = self.restorer.word(token) if odd[k] else token.strip(EDGES)
            if word and word[:3] in self.starts and (x := self.best(word)):
                out[token] = x
        return out

    def best(self, word: str) -> float:
        """The weight of a word's best feature; a beginning that no weighed word has ends the search."""
        found = []
        for k in PREFIXES:
            if len(word) < k:
                break
            if word[:k] not in self.starts:
                return max(*found, 0.0) if found else 0.0
            found.append(self.weights.get(word[:k], 0.0))
        return max([*found, self.weights.get("=" + word, 0.0)])

    def evidence(self, texts: list[str]) -> list[tuple[float, float]]:
        """Of each text the weight of its strongest token, and of the next two; each distinct token is looked at once."""
        lists, out = self.restorer.tokens(texts), []
        weights = self.weighed(set().union(*lists))
        strong = set(weights)
        for tokens in lists:
            found = [weights[t] for t in tokens & strong]
            first, second, third = [*sorted(found, reverse=True)[:3], 0.0, 0.0, 0.0][:3]
            out.append((first, second + third))
        return out

    def scores(self, texts: list[str]) -> list[float]:
        u, v, w = self.beta
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, u * a + v * b + w)))) for a, b in self.evidence(texts)]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def _mapped(docs: DataFrame, model: Model, schema, of) -> DataFrame:
    """``of(model, batch)`` for each bounded batch of ``docs`` (text and others)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        own.start()
        try:
            for batch in text_batches(batches):
                yield of(own, batch)
        finally:
            own.start()  # a worker keeps the broadcast, but not what it remembers

    return docs.mapInArrow(run, schema)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _evidence(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """``column`` and the evidence a, b of each row of ``docs``."""
    kind = docs.schema[column].dataType.simpleString()

    def of(own: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = own.evidence(_texts(batch))
        return pa.RecordBatch.from_arrays([batch.column(column), *(pa.array([x[k] for x in found], pa.float64()) for k in (0, 1))], [column, "a", "b"])

    return _mapped(docs.select(column, "text"), model, f"{column} {kind}, a double, b double", of)


def curve(rows: DataFrame) -> tuple[float, ...]:
    """Coefficients of a logistic curve through all ``rows`` (toxic, a, b), the last for a constant, by Newton steps with a small penalty.

    Equal rows are counted once; a step's sums are whole numbers of 2^-40, so their order is of no account.
    """
    equal = written(rows.groupBy("toxic", "a", "b").agg(F.count("*").alias("n")), "toxicity-equal")
    beta = np.zeros(3)
    upper = np.triu_indices(3)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, a, b, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("toxic", "a", "b", "n"))
            x = np.column_stack([a, b, np.ones(len(a))])
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            terms = [n * p * (1 - p) * x[:, i] * x[:, j] for i, j in zip(*upper, strict=True)] + [n * (label - p) * x[:, i] for i in range(3)]
            whole = [str(sum(map(int, np.rint(np.ldexp(t, 40)).tolist()))) for t in terms]
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.list_(pa.string()))], ["sums"])

    for _ in range(50):
        found = [[int(v) for v in r.sums] for r in equal.mapInArrow(sums, "sums array<string>").collect()]
        if not found:
            break
        total = np.array([sum(v) / 2**40 for v in zip(*found, strict=True)])
        square = np.zeros((3, 3))
        square[upper] = total[:6]
        square = np.triu(square) + np.triu(square, 1).T
        step = np.linalg.solve(square + 0.1 * np.eye(3), total[6:] - 0.1 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    drop(equal)
    return tuple(map(float, beta))


def _known(labels: DataFrame, modulus: int, held: int) -> DataFrame:
    """doc_id, toxic of all rows to learn from; of two labels the higher counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    return known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def _learnt(docs: DataFrame, labels: DataFrame, modulus: int, held: int) -> tuple[Model, DataFrame]:
    """A model without its curve, and the rows (text, toxic) that it has learnt from, written."""
    known = _known(labels, modulus, held).hint("shuffle_hash")  # texts are dealt by id, not sorted
    rows = docs.select("doc_id", "text").where(remainder(F.col("doc_id"), modulus) != held).join(known, "doc_id")
    rows = written(rows.select("text", "toxic"), "toxicity-rows")
    characters = Characters(_trigrams(rows))
    return Model(characters, _weights(rows, characters)), rows


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> Model:
    """A model of all labelled rows whose id's crc32 leaves another remainder than ``held``; of two labels the higher counts."""
    model, rows = _learnt(docs, labels, modulus, held)
    model.beta = curve(_evidence(rows, model, "toxic"))
    drop(rows)
    return model


def scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text).

    Null and empty texts have no evidence and get the curve's lowest score; a null id counts as the empty id; repeated rows
    score alike; a text or token of any length is read whole, in time that grows with its length; other columns are ignored, whatever
    their names; without labels every score is one half; no rows give no rows. The evidence of all rows is found once: that of the
    labelled ones gives the curve.
    """
    model, rows = _learnt(docs, labels, modulus, held)
    drop(rows)
    found = written(_evidence(docs, model, "doc_id"), "toxicity-evidence")
    u, v, w = curve(found.join(_known(labels, modulus, held), "doc_id").select("toxic", "a", "b"))
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), u * F.col("a") + v * F.col("b") + w))
    found = found.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), (1 / (1 + F.exp(-x))).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged."""
    def keep(own: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([x < THRESHOLD for x in own.scores(_texts(batch))], pa.bool_()))

    return _mapped(docs, train(docs, labels), docs.schema, keep)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
