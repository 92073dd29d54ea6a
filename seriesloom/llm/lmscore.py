"""Operator 4, language-model scores by subword lattice likelihood.

A word's probability is the sum over all ways to cut it into pieces of an
existing vocabulary, each way weighted by the product of its pieces' scores; the
sum is taken by a forward recursion in log space, for many words of one length at
once (a word beyond ``LONG_WORD`` characters alone, at 16 bytes a character). The
vocabulary's own order starts the scores, and expectation-maximisation over every
distinct training word (forward-backward counts, one row a piece from each task) fits
them. Characters without a piece are spelled by byte pieces.

A word known from training is one arc more over its whole lattice: counts less a
discount D, estimated from the words seen once and twice, with the discounted mass
given to the pieces:  P(w) = max(c - D, 0) / N + (D V / N) P_pieces(w). A word's first
piece starts with a mark that no other has, so the pieces' words sum to 1; ``END`` of
that is the end's, which is no word.

The counts are a table as large as the corpus asks. The ``FREQUENT`` commonest
words, a fixed number, are broadcast and settle most tokens in the pass over the
texts; all other words meet the table in a join, with each text's repeats added up.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import keyed, slices, stored

FREQUENT = 200_000
ROUNDS = 2
END = 1e-3
LONG_WORD = 400
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARK = "▁"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered, as UTF-8."""
    return (text or "").encode().lower().split()


class Lattice:
    """A piece vocabulary with log scores, and sums over all segmentations."""

    def __init__(self, pieces: list[str], byte_of: dict[int, int], logp: np.ndarray):
        """byte_of: the piece that spells each byte value; its own text does not
        match in words."""
        self.logp = np.asarray(logp, float)
        self.bytes = np.array([byte_of[b] for b in range(256)])
        spelled = set(byte_of.values())
        self.by_length: dict[int, tuple] = {}
        lengths = defaultdict(list)
        for i, p in enumerate(pieces):
            if i not in spelled and p and math.isfinite(self.logp[i]):
                lengths[len(p)].append(i)
        for n, ids in lengths.items():
            keys = np.array([self._hash(pieces[i]) for i in ids], np.uint64)
            bits = max(8, 5 + len(ids).bit_length())
            slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
            first = np.full(1 << bits, -1, np.int64)
            first[slot[::-1]] = np.arange(len(ids))[::-1]  # the earliest of a slot
            rest = np.flatnonzero(first[slot] != np.arange(len(ids)))
            order = rest[np.argsort(keys[rest])]
            self.by_length[n] = (np.array(ids), keys, bits, first, keys[order], order)
        self.longest = max(self.by_length, default=1)
        self.known = {pieces[i]: i for ids in lengths.values() for i in ids}

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def _find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces of n characters, and which pieces."""
        ids, keys, bits, first, others, order = self.by_length[n]
        at = first[(h >> np.uint64(64 - bits)).astype(np.int64)]
        hit = (at >= 0) & (keys[at] == h)
        if len(others):
            k = np.minimum(np.searchsorted(others, h), len(others) - 1)
            late = others[k] == h
            at = np.where(late, order[k], at)
            hit |= late
        rows = np.flatnonzero(hit)
        return rows, ids[at[rows]]

    def _arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None, np.ndarray]]:
        """(end, length, rows, pieces or None for spelled characters, log scores)."""
        b, size = codes.shape
        prefix = np.zeros((size + 1, b), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _BASE + codes[:, i] + np.uint64(1)
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.longest, _BASE))])
        for end in range(1, size + 1):
            for n in range(1, min(end, self.longest) + 1):
                if n in self.by_length:
                    rows, ids = self._find(n, prefix[end] - prefix[end - n] * power[n])
                else:
                    rows, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(rows):
                    yield end, n, rows, ids, self.logp[ids]
                if n == 1 and len(rows) < b:
                    out = np.ones(b, bool)
                    out[rows] = False
                    rows = np.flatnonzero(out)
                    chars, back = np.unique(codes[rows, end - 1], return_inverse=True)
                    cost = np.array([self.logp[self._spell(int(c))].sum() for c in chars])
                    yield end, 1, rows, None, cost[back]

    def _spell(self, char: int) -> np.ndarray:
        return self.bytes[list(chr(char).encode("utf-8", "surrogatepass"))]

    def _steps(self, text: str, end: int) -> list[tuple[int, int | None, float]]:
        """What can end at a place of one text: length, piece or None for a spelled
        character, log score."""
        out = []
        for n in self.by_length:
            if n <= end and (i := self.known.get(text[end - n : end])) is not None:
                out.append((n, i, float(self.logp[i])))
        if text[end - 1] not in self.known:
            out.append((1, None, float(self.logp[self._spell(ord(text[end - 1]))].sum())))
        return out

    def _forward(self, text: str) -> array:
        alpha = array("d", [0.0])
        for end in range(1, len(text) + 1):
            ways = [alpha[end - n] + cost for n, _, cost in self._steps(text, end)]
            top = max(ways, default=-math.inf)
            alpha.append(top + math.log(sum(math.exp(w - top) for w in ways)) if top > -math.inf else top)
        return alpha

    def _expected_alone(self, word: str, counts: np.ndarray) -> None:
        text = _MARK + word
        alpha = self._forward(text)
        if alpha[-1] == -math.inf:
            return
        beta = array("d", [-math.inf]) * (len(text) + 1)
        beta[-1] = 0.0
        for end in range(len(text), 0, -1):
            for n, i, cost in self._steps(text, end):
                low, high = sorted((beta[end - n], beta[end] + cost))
                beta[end - n] = high + math.log1p(math.exp(low - high)) if low > -math.inf else high
                use = math.exp(alpha[end - n] + cost + beta[end] - alpha[-1])
                if i is not None:
                    counts[i] += use
                else:
                    np.add.at(counts, self._spell(ord(text[end - 1])), use)

    def _grouped(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length at a time: their numbers and code points."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            end = int(np.searchsorted(sizes[order], size, side="right"))
            end = min(end, at + max(1, 400_000 // (size + 1)))
            some = order[at:end]
            text = "".join(_MARK + words[i] for i in some)
            yield some, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size + 1).astype(np.uint64)
            at = end

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, all segmentations summed."""
        out = np.zeros(len(words))
        for i in [i for i, w in enumerate(words) if len(w) > LONG_WORD]:
            out[i] = self._forward(_MARK + words[i])[-1]
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for some, codes in self._grouped([words[i] for i in short]):
            some = np.array(short)[some]
            alpha = np.full((codes.shape[1] + 1, len(some)), -np.inf)
            alpha[0] = 0
            for end, n, rows, _, cost in self._arcs(codes):
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - n, rows] + cost)
            out[some] = alpha[-1]
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """Expected uses of each piece over the words' segmentations."""
        counts = np.zeros(len(self.logp))
        for word in words:
            if len(word) > LONG_WORD:
                self._expected_alone(word, counts)
        for _, codes in self._grouped([w for w in words if len(w) <= LONG_WORD]):
            size = codes.shape[1]
            arcs = list(self._arcs(codes))
            alpha, beta = np.full((size + 1, len(codes)), -np.inf), np.full((size + 1, len(codes)), -np.inf)
            alpha[0], beta[-1] = 0, 0
            for end, n, rows, _, cost in arcs:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - n, rows] + cost)
            for end, n, rows, _, cost in reversed(arcs):
                beta[end - n, rows] = np.logaddexp(beta[end - n, rows], beta[end, rows] + cost)
            for end, n, rows, ids, cost in arcs:
                with np.errstate(invalid="ignore"):
                    use = np.nan_to_num(np.exp(alpha[end - n, rows] + cost + beta[end, rows] - alpha[-1, rows]))
                if ids is not None:
                    counts += np.bincount(ids, use, len(counts))
                else:
                    for c, u in zip(codes[rows, end - 1].tolist(), use.tolist(), strict=True):
                        np.add.at(counts, self._spell(int(c)), u)
        return counts


def starting_lattice(model_file: str) -> Lattice:
    """The pieces of a sentencepiece model; scores that fall with its ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_of = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
    scores = np.array([sp.get_score(i) for i in range(n)])
    weight = 1 / (1 + np.maximum(0, -scores))
    for i in range(n):
        if sp.is_control(i) or sp.is_unknown(i) or _MARK in pieces[i][1:]:
            weight[i] = 0
        elif sp.is_byte(i):
            weight[i] = 1e-4
    with np.errstate(divide="ignore"):
        return Lattice(pieces, byte_of, np.log(weight / weight.sum()))


def _piece_names(model_file: str) -> tuple[list[str], dict[int, int]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return pieces, {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined up to about ``rows`` rows or ``size`` bytes, so that there
    are many words of each length at once."""
    held, n, total = [], 0, 0
    for batch in slices(batches, rows):
        held.append(batch)
        n, total = n + batch.num_rows, total + batch.nbytes
        if n >= rows or total >= size:
            yield pa.concat_batches(held)
            held, n, total = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def word_counts(docs: DataFrame, text_col: str = "text", most: int = 400_000) -> DataFrame:
    """``(word, c)``: every word of the texts and how often it occurs. Tasks add
    up their own rows, ``most`` distinct words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
        for batch in slices(batches, 1000, "text"):
            seen.update(chain.from_iterable(map(words_of, batch.column(0).to_pylist())))
            if len(seen) > most:
                yield out()
                seen = Counter()
        yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    counts: DataFrame  # (word, c), as large as the vocabulary
    n_docs: int
    tokens: int
    types: int
    discount: float
    logp: np.ndarray
    model_file: str

    def lattice(self) -> Lattice:
        return Lattice(*_piece_names(self.model_file), self.logp)

    def spelled(self, lattice: Lattice, words: list[str]) -> np.ndarray:
        """Natural log of what the pieces give to each word."""
        return lattice.log_marginals(words) + math.log1p(-END)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def mixed(self, c: np.ndarray, log_pieces: np.ndarray) -> np.ndarray:
        """log10 of the probability of words with counts c and log scores."""
        if not self.tokens:
            return log_pieces / math.log(10)
        share = self.discount * self.types / self.tokens
        known = np.maximum(c - self.discount, 0) / self.tokens
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(known), math.log(share) + log_pieces) / math.log(10)

    def end(self) -> tuple[float, float]:
        """Base and mixed score of the end of a text."""
        c = np.array([float(self.n_docs)])
        return float(self.base(c)[0]), float(self.mixed(c, np.array([math.log(END)]))[0])


def train(docs: DataFrame, model_file: str, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Count the words of ``docs`` and fit the pieces' scores to them."""
    counts = stored(word_counts(docs, text_col), "words")
    n_docs = docs.count()
    row = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once"), F.sum((F.col("c") == 2).cast("long")).alias("twice")).first()
    once, twice = row.once or 0, row.twice or 0
    discount = min(0.9, max(0.3, once / (once + 2 * twice))) if once + twice else 0.5
    lattice = starting_lattice(model_file)
    logp = lattice.logp

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Lattice(*_piece_names(model_file), shared.value)
        total = np.zeros(len(now.logp))
        for batch in gathered(batches):
            total += now.expected([w.decode() for w in batch.column(0).to_pylist()])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    for _ in range(rounds if row.v else 0):
        shared = docs.sparkSession.sparkContext.broadcast(logp)  # one number a piece
        uses = np.where(np.isfinite(logp), 1e-2, 0.0)
        for r in counts.select("word").mapInArrow(expected, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r.piece] += r.uses
        with np.errstate(divide="ignore"):
            logp = np.log(uses / (uses.sum() + 1))
    return Model(counts, n_docs, (row.n or 0) + n_docs, row.v + (n_docs > 0), discount, logp, model_file)


def commonest(counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The rows of the commonest words of a bounded length, at most about ``frequent``.

    A level of counts, a few hundred rows, is found above which there are at most that
    many; of the level that overflows, the share that fits."""
    level, rows = F.floor(16 * F.log2("c")), counts.where(F.octet_length("word") <= 64)
    keep, room = F.lit(False), frequent
    for r in sorted(rows.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        fits = min(1.0, max(0, room) / r["count"])
        if fits == 1.0:  # with all levels above it: one comparison, however many they are
            keep = level >= r["level"]
        else:
            part = F.xxhash64("word").bitwiseAND(F.lit((1 << 40) - 1)) < int(0.99 * fits * (1 << 40))
            keep = keep | ((level == r["level"]) & part)
        room -= r["count"]
        if room <= 0:
            break
    return rows.where(keep)


class _Codes(dict):
    def __missing__(self, key):
        return -1


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, base_score, score.

    Tokens are the words and one end. Null counts as empty: the end alone.
    Repeated and null ids keep a row each; an empty table gives no rows. Other
    columns are not read. With nothing to learn from, scores come from the
    vocabulary's order alone.
    """
    spark = docs.sparkSession
    top = commonest(model.counts, frequent).toArrow()
    top = top.sort_by([("c", "descending"), ("word", "ascending")])
    words = top["word"].to_pylist()
    c = top["c"].to_numpy().astype(float)
    mixed = model.mixed(c, model.spelled(model.lattice(), [w.decode() for w in words])) if words else np.zeros(0)
    table = spark.sparkContext.broadcast((words, model.base(c), mixed))
    plain = Model(None, model.n_docs, model.tokens, model.types, model.discount, model.logp, model.model_file)
    numbers = spark.sparkContext.broadcast(plain)
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", "rid").select("rid", "text")
    kind = rows.schema["rid"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, mix = table.value
        code = _Codes(zip(known, range(len(known)), strict=True))
        base, mix = np.append(base, 0.0), np.append(mix, 0.0)
        end_base, end_mix = numbers.value.end()
        has_end = int(numbers.value.n_docs > 0)
        for batch in slices(batches, 500, "text"):
            split = [words_of(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            codes = np.fromiter(map(code.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            who = np.repeat(np.arange(len(split)), sizes)
            n = len(split)
            sums = [np.bincount(who, x, n) for x in (base[codes], mix[codes], codes >= 0)]
            at, late, times = [], [], []
            if (codes < 0).any():
                pairs = Counter(zip(who[codes < 0].tolist(), compress(chain.from_iterable(split), (codes < 0).tolist()), strict=True))
                at, late = [p[0] for p in pairs], [p[1] for p in pairs]
                times = list(pairs.values())
            rid = batch.column(0).take(pa.array([*range(n), *at], pa.int64()))
            k = len(at)
            full = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(k, kind)])
            yield pa.RecordBatch.from_arrays(
                [rid, full(sizes + 1, pa.int64()), full(sums[2].astype(np.int64) + has_end, pa.int64()), full(sums[0] + end_base, pa.float64()), full(sums[1] + end_mix, pa.float64()), pa.array([None] * n + late, pa.binary()), pa.array([None] * n + times, pa.int64())],
                names=["rid", "n_tokens", "n_known", "base_score", "score", "word", "times"],
            )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lattice = numbers.value, numbers.value.lattice()
        for batch in gathered(batches):
            coded = batch.column(1).dictionary_encode()
            found, back = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            times, c = (np.nan_to_num(batch.column(i).to_numpy(zero_copy_only=False).astype(float)) for i in (2, 3))
            log_pieces = model.spelled(lattice, [w.decode() for w in found])[back]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(len(c), pa.int64()), pa.array((times * (c > 0)).astype(np.int64)), pa.array(times * model.base(c)), pa.array(times * model.mixed(c, log_pieces))], names=["rid", "n_tokens", "n_known", "base_score", "score"])

    sums = f"rid {kind}, n_tokens long, n_known long, base_score double, score double"
    passed = stored(rows.mapInArrow(first, f"{sums}, word binary, times long"), "passed")
    late = passed.where("word IS NOT NULL").select("rid", "word", "times").join(model.counts, "word", "left").select("rid", "word", "times", "c").mapInArrow(second, sums)
    total = passed.where("word IS NULL").select("rid", "n_tokens", "n_known", "base_score", "score").unionByName(late)
    total = total.groupBy("rid").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    name = F.col(f"rid.{rows.schema['rid'].dataType.names[0]}") if kind.startswith("struct") else F.col("rid")
    return total.select(name.alias("doc_id"), "n_tokens", "n_known", "base_score", "score")
