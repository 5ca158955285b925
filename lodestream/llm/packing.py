"""Best-fit packing of documents into sequences by sum of squares.

N(g) is the number of open sequences with g free tokens. Each piece, longest first, goes where the sum of
N(g)^2 becomes smallest, a new sequence being one of the choices; this keeps many different gaps open, so
that later pieces fill sequences to the brim. Full pieces of ``capacity`` tokens are sequences by themselves.

Spark tokenises in one pass, writes the pieces' sizes (not their tokens) and deals them by hash into groups of
about ``group_pieces``; each group packs alone and leaves about one sequence that isn't full. The number of
groups follows the number of pieces, so no task grows with the input.

Defined results: null text is empty and gives one piece with the end mark alone; repeated rows are packed once
each; ties are broken by doc_id, piece and content; an empty table gives no rows. Input columns other than the
id and the text are not carried.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import written

CAPACITY = 4096
END = 1
GROUP_PIECES = 8192
CACHED_WORDS = 200_000  # of either generation: some 40 MB
ODD_SPACE = "\x1c\x1d\x1e\x1f"  # white space to Python only
STOPS = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([!-/:-@\[-`{-~]+)(?=\s|$)")
#: Bytes as the characters of byte-level vocabularies: printable ones stand for themselves, the others from U+0100 on, in order.
PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
PROBE = "the\xe9\xdf\xff rainforest \xe8\xe0\xf8 \xb5\xaa\xba zzqxjkwv"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts.

    The vocabulary's pre-tokenizer never joins characters across white space, so the ids of a text are those of
    its space-separated chunks in a row; chunks met before come from a cache of bounded size. A text that may hold
    an added token's literal, such as ``<|endoftext|>``, is encoded whole and as it is. A word of lower-case Latin-1
    letters alone is one pre-token and normal as it stands, so the vocabulary's model gets it directly.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        # the tokenizer looks for added tokens before it lower-cases and splits
        self.added = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # a vocabulary of another kind gets no word directly
        self.direct = b"".join(map(self._direct, PROBE.split())) == np.array(self.tokenizer.encode(PROBE, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks = [self._chunks(t) for t in texts]
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        fresh, whole = [], []
        for w in set(chain.from_iterable(chunks)):
            if w not in self.young:
                if w in self.old:
                    self.young[w] = self.old[w]
                elif self._is_whole(w):
                    whole.append(w)
                elif self.direct and w.isalpha() and w.islower() and (w.isascii() or max(w) <= "\xff"):
                    self.young[w] = self._direct(w)
                else:
                    fresh.append(w)
        for w in whole:
            self.young[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        self._learn(fresh)
        for own in chunks:
            yield b"".join(map(self.young.__getitem__, own))
        for w in whole:  # whole texts do not recur as words do
            del self.young[w]

    def _learn(self, words: list[str]) -> None:
        """Encode the words in one go, a space between any two; where each one's ids end is read from the offsets."""
        if not words:
            return
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        first = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        cuts = np.searchsorted(first, starts) * 4
        raw = ids.tobytes()
        for w, a, b in zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.young[w] = raw[a:b]

    def _direct(self, word: str) -> bytes:
        """The ids of a word of lower-case Latin-1 letters."""
        own = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
        return np.array([t.id for t in self.model.tokenize(own)], "<u4").tobytes()

    def _is_whole(self, chunk: str) -> bool:
        return any(x in chunk for x in self.added) or any(c in chunk for c in ODD_SPACE)

    def _chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self._is_whole(text):
            return [text]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        # Latin-1 is composed already and has one lower case, and letters never share a token with a sign after them:
        # fewer different chunks, the same ids
        return STOPS.sub(r" \1", text.lower()).split()


@functools.cache
def _tokenizer(path: str):  # noqa: ANN202
    """One a Python worker: some 30 MB, of no growth. The words met are kept by each task alone."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = Encoder(tokenizer)  # ends with the task, as do the words it keeps
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for doc, ids in zip(part["doc_id"].to_pylist(), encoder.ids(part["text"].to_pylist()), strict=True):
                    ids += end
                    for k in range(0, len(ids) // 4, capacity):
                        own = ids[4 * k : 4 * (k + capacity)]
                        for name, v in (("doc_id", doc), ("piece", k // capacity), ("start", k), ("length", len(own) // 4), ("ids_crc32", zlib.crc32(own))):
                            rows[name].append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(tokenised, PIECES)


def sum_of_squares(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each size in the order given; sizes are 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)  # N(g); a full sequence is no longer open
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    grown = 2 * count + 1  # what one more sequence with gap g adds; none at 0
    grown[0] = 0
    lost = np.full(capacity + 1, 1 << 40, np.int64)  # what one less adds; not possible if there is none
    out, used = [], 0
    for s in sizes:
        change = lost[s:] + grown[: capacity + 1 - s]
        k = int(change.argmin())
        if open_at[s + k] and change[k] <= grown[capacity - s]:
            gap, seq = s + k, open_at[s + k].pop()
            count[gap] -= 1
            grown[gap] = 2 * count[gap] + 1
            lost[gap] = 1 - 2 * count[gap] if count[gap] else 1 << 40
        else:
            gap, seq, used = capacity, used, used + 1
        out.append((seq, capacity - gap))
        if rest := gap - s:
            open_at[rest].append(seq)
            count[rest] += 1
            grown[rest], lost[rest] = 2 * count[rest] + 1, 1 - 2 * count[rest]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset."""
    groups = max(1, math.ceil(pieces.where(F.col("length") < capacity).count() / group_pieces))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        seq, offset = zip(*sum_of_squares(pdf["length"].tolist(), capacity), strict=True)
        return pdf.assign(sequence_id=pdf["group"].to_numpy() + groups * np.array(seq, np.int64), offset=np.array(offset, np.int64)).drop(columns="group")

    rest = pieces.where(F.col("length") < capacity).withColumn("group", deal).groupBy("group").applyInPandas(packed, PACKED)
    full = pieces.where(F.col("length") >= capacity)
    # below 0, so apart from the others; the id is unique within a job's rows
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return full.unionByName(rest)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(written(cut(docs, tokenizer, doc_id, text, capacity), "pieces"), capacity, group_pieces)
