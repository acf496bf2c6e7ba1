"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

Method: a text's characters are the first symbols, each linked to its
neighbours.  A heap holds every adjacent pair that the vocabulary joins, by the
piece's rank (best score first) and place.  The lowest is popped, its right
symbol is unlinked, and the pairs with the new neighbours go on the heap; a
popped pair that has changed since is passed over.  The count is the initial
symbols minus the merges: no identifier is ever made.  A character that the
vocabulary lacks counts as many symbols as it has UTF-8 bytes.

Texts repeat words, so the merging runs once per distinct segment and worker.
A segment is a run of spaces with the word behind it.  That is exact because no
piece of the vocabulary has a space behind another character, and characters
that no longer piece holds (line breaks, digits) stand alone.  ``Vocabulary``
checks both on the model file and refuses one where they do not hold.

Defined cases: a null or empty text has no tokens; begin, end and other control
pieces inside a text are ordinary text, as the library reads them; a text is
read in windows of ``WINDOW`` characters cut between segments, whatever its
length, and one endless word costs n log n; repeated rows and repeated or null
ids are rows like any other; an empty table gives no rows; other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm.common import whole
from seatflow.llm.textvec import process_memory

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"  # how pieces write a space
WINDOW = 1 << 20
MEMO = 1 << 20  # segments remembered before the memory starts afresh
MEMO_CHARS = 64  # longer segments are counted each time
NORMAL = 1  # type number of an ordinary piece in the model file


def model_file(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Ranks of the joined pieces and the characters known, from a
    sentencepiece byte-pair model with byte fallback, identity normalisation
    and kept white space."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        special = [p for p in model.pieces if p.type not in (1, 2, 3, 6)]
        if (train.model_type != train.BPE or not train.byte_fallback or special or norm.name != "identity"
                or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or train.treat_whitespace_as_suffix):
            raise ValueError("only byte-pair models with byte fallback and unchanged text are counted")
        self.prefix = " " if norm.add_dummy_prefix else ""
        pieces = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        place = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in pieces.items() if len(p) > 1}
        self.known = {p for p in pieces if len(p) == 1}
        joined = {c for p in self.rank for c in p}
        if joined - self.known or any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces that hold unknown characters or a space behind another character")
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) != " " and chr(c) not in joined)
        self.segment = re.compile(f"[ {SPACE}]*[^ {SPACE}{alone}]+|[ {SPACE}]+|[{alone}]" if alone else
                                  f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")

    def count(self, segment: str) -> int:
        """Symbols left after all merges of one segment."""
        s = segment.replace(" ", SPACE)
        rank, known = self.rank, self.known
        symbols = sum(1 if c in known else len(c.encode()) for c in s)
        n = len(s)
        end = list(range(1, n + 1))  # of the symbol that starts at i; 0 once it is merged away
        left = list(range(-1, n - 1))
        heap = [(rank[s[i:i + 2]], i, i + 2) for i in range(n - 1) if s[i:i + 2] in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if mid == 0 or mid >= n or end[mid] != stop:
                continue  # one of the two is no longer what it was
            end[i], end[mid] = stop, 0
            merges += 1
            if stop < n:
                left[stop] = i
                r = rank.get(s[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := left[i]) >= 0:
                r = rank.get(s[j:stop])
                if r is not None:
                    heapq.heappush(heap, (r, j, stop))
        return symbols - merges


class Counter(dict):
    """Segment -> tokens, filled as segments are first met."""

    def __init__(self, path: str):
        self.words = Vocabulary(path)

    def __missing__(self, segment: str) -> int:
        n = self.words.count(segment)
        if len(segment) <= MEMO_CHARS:
            self[segment] = n
        return n

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > MEMO:
            self.clear()
        total, at, tail = 0, 0, self.words.prefix
        while at < len(text):
            found = self.words.segment.findall(tail + text[at:at + WINDOW])
            at += WINDOW
            # the last two segments may go on in the next window (a run of spaces, then its word)
            tail = "".join(found[-2:]) if at < len(text) else ""
            total += sum(map(self.__getitem__, found[:-2] if tail else found))
        return total


def counter(path: str) -> Counter:
    """One per worker process and file."""
    held = process_memory().setdefault("token_counters", {})
    if path not in held:
        held[path] = Counter(path)
    return held[path]


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``
    tokens) of every document."""
    path = model or model_file()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path).tokens
        for b in batches:
            n = [tokens(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", whole(F.col("text")).alias("text")).withColumn(
        "n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
