"""Operator 5, packing: concatenate all documents' ids and cut fixed windows.

Pass one turns each text into token ids, once, and writes them with their
partition's number and the ids before them in that partition. The partition
totals, one number a partition, are summed to global offsets. Pass two reads the
ids again and cuts every document where a multiple of the window length falls;
each piece is a boundary record. No row changes partition, so nothing is
shuffled but one total for each partition.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import slices, stored

WINDOW = 4096
END_ID = 2
#: Words a worker remembers at most; the memory bound of pass one.
REMEMBERED = 800_000
#: Marks whose run after a word's letters is a unit of its own to the tokenizer.
MARKS = string.punctuation.replace("'", "")

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts, equal to the tokenizer's own, from remembered words.

    The tokenizer drops white space and never merges across it, so a text's ids
    are its words' ids in turn. Words are UTF-8 bytes between ASCII white space
    with A-Z lowered; how other letters are lowered stays the tokenizer's affair.
    Words of letters only, with or without closing marks, are encoded many at a
    time; others one by one. When too many are remembered, those seen once go.
    """

    def __init__(self, path: str, limit: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.kind = np.uint16 if len(self.closes) <= 1 << 16 else np.uint32
        self.code: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, self.kind)
        self.ends = np.zeros(1 << 17, np.int64)
        self.uses = np.zeros(1 << 17, np.int64)
        self.n = 0

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, start = self.n, int(self.ends[self.n])
        while start + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.flat[start : start + len(ids)] = ids
        self.ends[first + 1 : first + 1 + len(words)] = start + np.cumsum(lengths)
        self.code.update(zip(words, range(first, first + len(words)), strict=True))
        self.n += len(words)

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one after another, and how many each has."""
        starts = self.ends[codes]
        lengths = self.ends[codes + 1] - starts
        before = np.cumsum(lengths) - lengths
        return self.flat[np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - before, lengths)], lengths

    def _forget(self) -> None:
        keep = np.flatnonzero(self.uses[: self.n] > 1)
        if len(keep) > self.limit // 2:
            keep = keep[np.argsort(-self.uses[keep], kind="stable")[: self.limit // 2]]
        words = np.array(list(self.code), dtype=object)[keep].tolist()  # a dict keeps its order, which is the codes'
        ids, lengths = self._gather(keep)
        uses = self.uses[keep]
        self.code, self.n = {}, 0
        self.uses[:] = 0
        self._add(words, ids, lengths)
        self.uses[: len(keep)] = uses

    def _raw(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn_letters(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self._raw(" ".join(some)), self.kind)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) == len(some) and (not len(stops) or stops[-1] == len(ids)):
                self._add([w.encode() for w in some], ids, np.diff(stops, prepend=0))
            else:  # a letter that normalises to more than letters
                self._learn_any(some)

    def _learn_any(self, words: list[str]) -> None:
        each = [self._raw(w) for w in words]
        self._add([w.encode() for w in words], np.array([i for e in each for i in e], self.kind), np.array([len(e) for e in each], np.int64))

    def _learn(self, words: list[bytes]) -> None:
        plain, cores, marks, odd = [], [], [], []
        for raw in words:
            w = raw.decode()
            if w.isalpha():
                plain.append(w)
                continue
            core = w.rstrip(MARKS)
            if core.isalpha():
                cores.append(core)
                marks.append(w[len(core) :])
            else:
                odd.append(w)
        known = self.code
        self._learn_letters(plain)
        self._learn_letters([c for c in dict.fromkeys(cores) if c.encode() not in known])
        self._learn_any([m for m in dict.fromkeys(marks) if m.encode() not in known])
        self._learn_any([w for w in odd if w.encode() not in known])
        if cores:
            pairs = np.array([known[x.encode()] for pair in zip(cores, marks, strict=True) for x in pair], np.int64)
            ids, lengths = self._gather(pairs)
            whole = [(c + m).encode() for c, m in zip(cores, marks, strict=True)]
            self._add(whole, ids, lengths.reshape(-1, 2).sum(axis=1))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's number of ids."""
        if self.n > self.limit:
            self._forget()
        split = [t.encode().lower().split() for t in texts]
        new = set(chain.from_iterable(split)).difference(self.code)
        if new:
            self._learn(sorted(new))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self.uses[: self.n] += np.bincount(codes, minlength=self.n)
        flat, lengths = self._gather(codes)
        edges = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(edges)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(pid, doc_id, local_start, n, ids)``: ids packed as little-endian
    unsigned 16- or 32-bit numbers, ending in ``end_id``."""
    schema = f"pid int, doc_id {docs.schema[id_col].dataType.simpleString()}, local_start long, n long, ids binary"
    kind = pa.int64() if docs.schema[id_col].dataType.simpleString() == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 400, "text", 2_000_000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            flat, counts = encode(texts)
            ends = np.cumsum(counts)
            blobs = [np.append(flat[e - c : e], encode.kind(end_id)).tobytes() for e, c in zip(ends, counts, strict=True)]
            n = counts + 1
            local = at + np.cumsum(n) - n
            at += int(n.sum())
            ids = batch.column(0) if kind is None else batch.column(0).cast(kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), pid, np.int32)), ids, pa.array(local), pa.array(n), pa.array(blobs, pa.binary())], names=["pid", "doc_id", "local_start", "n", "ids"]
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack all documents into gapless sequences of ``window`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``keep_ids`` the piece's ids. Every sequence is
    full but the last, so at most one is padded (``padded_length``).

    A null or empty text is one end id. Repeated doc_ids are packed row by row.
    A null doc_id stays null. An empty table gives no rows. Columns other than
    the two named are not read.
    """
    spark = docs.sparkSession
    rows = stored(token_rows(docs, tokenizer, end_id, id_col, text_col), "ids")
    totals = rows.groupBy("pid").agg(F.sum("n").alias("n")).orderBy("pid").collect()  # one number a partition
    bases, at = {}, 0
    for r in totals:
        bases[r.pid] = at
        at += r.n
    bases = spark.sparkContext.broadcast(bases)
    from tokenizers import Tokenizer

    size = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if keep_ids:
        names.append("ids")
        schema += ", ids array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000, "ids", 8_000_000):
            pid, local, n = (batch.column(i).to_numpy() for i in (0, 2, 3))
            base = np.array([bases.value[p] for p in pid], np.int64) + local
            blobs = batch.column(4).to_pylist()
            row, start, length, crc, seq, off, kept = [], [], [], [], [], [], []
            for i, blob in enumerate(blobs):
                ids = np.frombuffer(blob, f"<u{size}").astype("<u4")
                g, m, s = int(base[i]), int(n[i]), 0
                while s < m:
                    take = min(m - s, window - (g + s) % window)
                    row.append(i)
                    start.append(s)
                    length.append(take)
                    crc.append(zlib.crc32(ids[s : s + take].tobytes()))
                    seq.append((g + s) // window)
                    off.append((g + s) % window)
                    if keep_ids:
                        kept.append(ids[s : s + take].astype(np.int32))
                    s += take
            columns = [batch.column(1).take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, n[row] if row else [], seq, off)]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, schema)


def padded_length(tokens: int, window: int = WINDOW) -> int:
    """Length a sequence of ``tokens`` ids is padded to: the window, or the next
    power of two where that is shorter, as for the last sequence."""
    return min(window, 1 << max(0, tokens - 1).bit_length())
