"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Tokenising: texts are split at ASCII white space, which the tokenizer drops and no
token spans, so a worker encodes each distinct word once and then looks it up. Only a document's pieces (lengths, checksums) leave that pass.

Packing needs only how many pieces there are of each length, a table of at most
``capacity`` rows. On it the driver (1) fixes piece sets that dominate every
alternative for their largest piece, as often as the counts allow, and removes
them, until nothing more is dominated; (2) packs the remaining lengths best-fit, the
longest first, whole groups of equal sequences at a time. The result is a plan of
intervals of ranks for each length; it grows with the number of lengths (at most 64
rows for each, asserted), not of documents. Pieces get their rank within a length by distributed running counts and
look their place up.

Defined results: null and empty texts are one piece of the closing id alone;
documents longer than the capacity are cut, only they; repeated rows are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .prefix import running
from .store import materialize
from .textops import buffers, hold, slice_rows, slices

CAPACITY = 2048
WORDS_HELD = 1_000_000  # about 250 MB for each worker; beyond it a worker starts afresh
ENDINGS = b".,!?;:"


LETTERS = re.compile("[a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+").fullmatch


def _printable() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


class Encoder:
    """Ids of white-space separated words, each distinct one encoded once.

    Where the file's own steps are lower-casing, splitting letters from the rest and the
    byte-level alphabet, a word of Latin-1 letters goes straight to its model, as no
    other step would change it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(Path(path).read_text())
        kinds = [x["type"] for key, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (steps.get(key) or {}).get(inner, [])]
        split = json.dumps(steps.get("pre_tokenizer"))
        self.direct = kinds == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and r"|[\\p{L}]+|" in split and '"use_regex": false' in split
        self.alphabet = _printable()
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.size = array("I"), array("q"), array("i")

    def _add(self, word: bytes, ids) -> None:
        self.known[word] = len(self.begin)
        self.begin.append(len(self.ids))
        self.size.append(len(ids))
        self.ids.extend(ids)

    def _learn(self, words: set[bytes]) -> None:
        """Encode new words. One that ends in a letter or digit and a run of ``ENDINGS`` is
        what its two parts are, as the tokenizer always splits there."""
        parts, plain = {}, set()
        for w in words:
            stem = w.rstrip(ENDINGS)
            if stem != w and stem[-1:].isalnum():
                parts[w] = stem, w[len(stem) :]
                plain.update(parts[w])
            else:
                plain.add(w)
        new = []
        tokens = self.tokenizer.model.tokenize
        for w in plain:
            if w in self.known:
                continue
            s = w.decode()
            if not (self.direct and LETTERS(s)):
                new.append(w)
                continue
            ids = [t.id for t in tokens(s if s.isascii() else s.lower().encode().decode("latin-1").translate(self.alphabet))]
            self._add(w, ids)
        for lo in range(0, len(new), 5000):
            some = new[lo : lo + 5000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self._add(w, e.ids)
        held, begin, size, known = self.ids, self.begin, self.size, self.known
        for w, (one, two) in parts.items():
            i, j = known[one], known[two]
            a, b = begin[i], begin[j]
            self._add(w, held[a : a + size[i]] + held[b : b + size[j]])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by id 0, and the texts' offsets in them."""
        words: list[bytes] = []
        counts = []
        for t in texts:
            # the tokenizer lowers case, but finds its special tokens before that
            w = (t if b"<|" in t else t.lower()).split()
            counts.append(len(w))
            words += w
        if len(self.known) > WORDS_HELD:
            self.clear()
        get = self.known.get
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lost = [words[k] for k in missing.tolist()]
            self._learn(set(lost))
            at[missing] = [get(w) for w in lost]
        counts = np.array(counts, dtype=np.int64)
        ids, begin, size = (np.frombuffer(x, t) for x, t in ((self.ids, np.uint32), (self.begin, np.int64), (self.size, np.int32))) if self.known else (np.zeros(0, np.uint32),) * 3
        sizes = size[at].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat(begin[at] - (ends - sizes), sizes) + np.arange(total)] if total else np.zeros(0, np.uint32)
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]  # ids before each text
        return np.insert(flat, upto[1:], 0).astype("<u4"), upto + np.arange(len(upto))


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


hold(_encoder.cache_clear)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(it: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)  # kept for the worker's next tasks of this operator
    for batch in it:
        data, offsets = buffers(batch.column(1))
        doc_ids = batch.column(0)
        for lo, hi in slices(offsets):
            part, places = slice_rows(data, offsets, lo, hi)
            raw = part.tobytes()
            ids, at = encoder.encode([raw[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)])
            size = np.diff(at)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            begin = (at[:-1][row] + start).tolist()
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(begin, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=PIECES)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_pieces, path=path, capacity=capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


Group = tuple[int, dict[int, int]]  # how many equal sequences, and what each holds: length -> times


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Fix sets that dominate all others holding their largest piece; returns them and the counts left.

    For the largest piece j with r = capacity - j left over, no feasible set holding j
    is better than (a) j alone if nothing fits, (b) j and a piece of exactly r, (c) j and
    the largest piece that fits if no two fit together, (d) j and the two largest pieces
    if these fit together and no three pieces do. Pieces for which no rule holds are set
    aside; every rule is tried again whenever the counts changed below them.
    """
    left = {k: n for k, n in counts.items() if n}
    fixed: list[Group] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                r = capacity - j
                rest = left | {j: left[j] - 1}
                fits = sorted(k for k, n in rest.items() if n and k <= r)
                if not fits:
                    take, times = {j: 1}, left[j]
                elif fits[-1] == r:
                    take = {j: 2} if r == j else {j: 1, r: 1}
                    times = left[j] // 2 if r == j else min(left[j], left[r])
                else:
                    small = [k for k in fits for _ in range(min(3, rest[k]))][:3]
                    large = [k for k in reversed(fits) for _ in range(min(2, rest[k]))][:2]
                    if len(small) == 1 or sum(small[:2]) > r:
                        take = {j: 1, large[0]: 1} if large[0] != j else {j: 2}
                        times = min(left[j], left[large[0]]) if large[0] != j else left[j] // 2
                    elif len(large) == 2 and sum(large) <= r and (len(small) < 3 or sum(small) > r):
                        take = {j: 1}
                        for k in large:
                            take[k] = take.get(k, 0) + 1
                        times = min(left[k] // m for k, m in take.items())  # what is left fits no better
                    else:
                        break
                if times < 1:
                    break
                for k, m in take.items():
                    left[k] -= m * times
                    if not left[k]:
                        del left[k]
                fixed.append((times, take))
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing over counts: equal sequences are held, split and filled as groups."""
    open_: dict[int, list[Group]] = {}  # by room left
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                room, times, held = capacity, -(-n // (capacity // size)), {}
            else:
                times, held = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // size
            whole = min(times, n // each)
            if whole:
                open_.setdefault(room - each * size, []).append((whole, held | {size: each}))
                n -= whole * each
                times -= whole
            if times and n:
                open_.setdefault(room - n * size, []).append((1, held | {size: n}))
                n = 0
                times -= 1
            if times and held:
                open_.setdefault(room, []).append((times, held))
    return [g for groups in open_.values() for g in groups]


def lay_out(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The plan, rows (length, first rank, times in a sequence, first sequence, offset) by length and rank; and the sequences."""
    fixed, left = reduce_dominated(counts, capacity)
    next_rank = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for times, held in fixed + best_fit(left, capacity):
        offset = 0
        for size in sorted(held, reverse=True):
            m = held[size]
            rows.append((size, next_rank[size], m, sequence, offset))
            next_rank[size] += m * times
            offset += m * size
        sequence += times
    assert next_rank == counts, "the plan places every piece once"
    assert len(rows) <= 64 * (len(counts) + 1), "the plan grows with the lengths, not with the pieces"
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), sequence


def _place(it: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    rows = table.value
    span = int(rows[:, 1].max()) + 1 if len(rows) else 1
    keys = rows[:, 0] * span + rows[:, 1]
    for batch in it:
        length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
        i = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
        # a rank may pass the largest first rank of any length; the last interval then holds it
        first, times, sequence, offset = rows[i, 1], rows[i, 2], rows[i, 3], rows[i, 4]
        k = rank - first
        out = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "_rank"]
        names = [name for name in batch.schema.names if name != "_rank"]
        yield pa.RecordBatch.from_arrays([*out, pa.array(sequence + k // times), pa.array(offset + k % times * length)], names=[*names, "sequence_id", "offset"])


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = found.sparkSession
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table, _ = lay_out(counts, capacity)
    ranked = running(found, "length", ["doc_id", "piece", "ids_crc32"], F.lit(1).cast("long"), "_rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id bigint, offset bigint"
    return ranked.select(*found.columns, "_rank").mapInArrow(partial(_place, table=spark.sparkContext.broadcast(table)), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(materialize(pieces(docs, path, capacity, doc_id, text), "pieces"), capacity)


def tokenizer_path() -> str:
    """Where the public tokenizer's file lies on this installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
