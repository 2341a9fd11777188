"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. Texts are split by the tokenizer's pattern; each piece is encoded by itself. A sequence of tokens is
the BPE encoding of its bytes exactly when every two neighbours are, that is when merging the two tokens' bytes
by rank gives back the two tokens. So BPE is a finite-state relation: a state of the nondeterministic
transducer is the last finished token and a node of the prefix tree of all tokens; a byte moves down the tree,
and a node that is a token may be finished if it fits the last one. Each prefix of a piece has one encoding
only, so the determinised state after some bytes is a short list of hypotheses (last finished token, node of
the tree), and exactly one token ends with each byte. Walking back over the ends gives the tokens; what all
hypotheses share is emitted, after a lookahead that the longest token bounds, so that memory stays bounded in
pieces of any length. States and transitions are made when a piece first needs them and kept in a table of
bounded size, which is dropped and grown again when full, as are the encodings of frequent pieces.
A piece that is a token as a whole is that token, and tokens that merging can't reach are no states.

Decoding. Bytes of tokens pass an incremental UTF-8 machine. For each token and each state of the machine the
state after the token is computed once; where whole characters end, text can be handed out.

Defined results: a null text counts as empty and has no tokens; texts of any length are encoded whole;
repeated rows are each returned; an empty table gives an empty result; other columns are ignored. Special
tokens don't exist: their strings are ordinary text. Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import give_back, keep, ship_file, ship_package

#: Entries of the caches of a worker, each of some hundred bytes at most.
MAX_PIECES = 200_000
MAX_STATES = 200_000
#: Bytes of a piece after which its decided tokens are emitted.
LOOK_BACK = 4096
#: Longer pieces are encoded each time anew.
MAX_CACHED_PIECE = 64


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each token, by rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[k] for k in range(len(ranks))]


class Transducer:
    """Encodes pieces of bytes; made from the ranks alone."""

    def __init__(self, vocabulary: list[bytes], max_states: int = MAX_STATES):
        self.vocabulary = vocabulary
        self.lengths = [len(t) for t in vocabulary]
        self.rank = {t: k for k, t in enumerate(vocabulary)}
        self.max_states = max_states
        self._bits = len(vocabulary).bit_length()
        self._fits: dict[int, bool] = {}
        self._edges: dict[int, tuple | None] = {}
        #: The prefix tree: child by (node, byte), token of a node, and whether a node has children.
        self._child: dict[int, int] = {}
        self._token_at, self._inner = [-1], [True]
        for k, t in enumerate(vocabulary):
            node = 0
            for b in t:
                nxt = self._child.get(node << 8 | b)
                if nxt is None:
                    nxt = self._child[node << 8 | b] = len(self._token_at)
                    self._token_at.append(-1)
                    self._inner.append(False)
                    self._inner[node] = True
                node = nxt
            self._token_at[node] = k
        self._reset()

    def _reset(self) -> None:
        #: A state's hypotheses as last token, node, last token, node and so on; the root hypothesis is the last.
        self._states: list[tuple[int, ...]] = [(-1, 0)]
        self._number = {self._states[0]: 0}
        #: From state and byte to the state after it and the token that ends there.
        self._moves: dict[int, int] = {}

    def merges(self, data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """Merging by rank, lowest and leftmost first, which defines the encoding: the parts at the end, and each merge's rank with the outer parts after it."""
        parts, done = [data[k : k + 1] for k in range(len(data))], []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            done.append((best, parts[0], parts[-1]))
        return parts, done

    def _history(self, token: int) -> tuple | None:
        """Ranks of the token's own merges with its first and last parts meanwhile; None if merging can't reach it."""
        if token not in self._edges:
            data = self.vocabulary[token]
            parts, done = self.merges(data)
            self._edges[token] = ([(done[k][0] if k < len(done) else None, *((done[k - 1][1:]) if k else (data[:1], data[-1:]))) for k in range(len(done) + 1)],) if len(parts) == 1 else None
        return self._edges[token]

    def fits(self, left: int, right: int) -> bool:
        """May right follow left? left is -1 at the start: then right must be its own encoding.

        Both merge by themselves, the lower rank first, until a pair across their border would come first.
        """
        if left < 0:
            return self._history(right) is not None
        key = left << self._bits | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._history(left) is not None and self._history(right) is not None and self._apart(self._edges[left][0], self._edges[right][0])
        return known

    def _apart(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            (own_left, _, x), (own_right, y, _) = left[i], right[j]
            across = self.rank.get(x + y)
            if across is not None and (own_left is None or across < own_left) and (own_right is None or across <= own_right):
                return False
            if own_left is None and own_right is None:
                return True
            if own_right is None or own_left is not None and own_left <= own_right:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> int:
        """Determinise one transition: the state after it and the one token that ends there."""
        hypotheses, key, token = self._states[state], [], -1
        for k in range(0, len(hypotheses), 2):
            node = self._child.get(hypotheses[k + 1] << 8 | byte)
            if node is None:
                continue
            last = hypotheses[k]
            if token < 0 <= self._token_at[node] and self.fits(last, self._token_at[node]):
                token = self._token_at[node]
            if self._inner[node]:
                key += (last, node)
        if token < 0:
            raise ValueError("no token sequence: the vocabulary must hold all single bytes")
        after = (*key, token, 0)
        number = self._number.get(after)
        if number is None:
            number = self._number[after] = len(self._states)
            self._states.append(after)
        move = self._moves[state << 8 | byte] = number << self._bits | token
        return move

    def _decided(self, ends: list[int], state: int) -> int:
        """How many bytes all hypotheses of the state agree on: the last common border of their tokens."""
        starts = [len(ends) - 1 - self._depth(node) for node in self._states[state][1::2]]
        borders = None
        for at in starts:
            chain = set()
            while at > 0:
                chain.add(at)
                at -= self.lengths[ends[at]]
            borders = chain if borders is None else borders & chain
        return max(borders, default=0)

    def _depth(self, node: int) -> int:
        if not hasattr(self, "_depths"):
            self._depths = {0: 0}
            for key, nxt in self._child.items():  # parents come before children
                self._depths[nxt] = self._depths[key >> 8] + 1
        return self._depths[node]

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self._reset()
        out: list[int] = []
        bits, mask, get, step = self._bits, (1 << self._bits) - 1, self._moves.get, self._step
        state, ends = 0, [-1]  # ends: the token that ends after so many bytes
        for byte in piece:
            move = get(state << 8 | byte)
            if move is None:
                move = step(state, byte)
            state = move >> bits
            ends.append(move & mask)
            if len(ends) > LOOK_BACK:
                k = self._decided(ends, state)
                out += self._back(ends, k)
                ends = [-1, *ends[k + 1 :]]
        return out + self._back(ends, len(ends) - 1)

    def _back(self, ends: list[int], at: int) -> list[int]:
        tokens = []
        while at > 0:
            tokens.append(ends[at])
            at -= self.lengths[ends[at]]
        tokens.reverse()
        return tokens


# --- decoding -----------------------------------------------------------------------------------------------

#: States of the UTF-8 machine: 0 between characters; 1, 2, 3 more bytes wanted; 4 to 7 the bounded second bytes; 8 broken.
BROKEN = 8


def utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return 4 if byte == 0xE0 else 5 if byte == 0xED else 2
        if 0xF0 <= byte <= 0xF4:
            return 6 if byte == 0xF0 else 7 if byte == 0xF4 else 3
        return BROKEN
    low, high, then = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}.get(state, (1, 0, BROKEN))
    return then if low <= byte <= high else BROKEN


class StreamingDecoder:
    """Decodes token ids as they come; feed() returns the text of all whole characters so far."""

    def __init__(self, vocabulary: list[bytes]):
        self.vocabulary = vocabulary
        self.table = np.empty((BROKEN + 1, len(vocabulary)), np.uint8)
        step = [[utf8_step(s, b) for b in range(256)] for s in range(BROKEN + 1)]
        for k, token in enumerate(vocabulary):
            for start in range(BROKEN + 1):
                s = start
                for b in token:
                    s = step[s][b]
                self.table[start, k] = s
        self.reset()

    def reset(self) -> None:
        self.state, self.rest = 0, b""

    def states(self, ids: np.ndarray, state: int = 0) -> int:
        """The machine's state after ids; runs of whole characters are passed over at once."""
        at, alone = 0, self.table[0][ids]
        odd = np.flatnonzero(alone)
        while True:
            if state == 0:
                k = int(np.searchsorted(odd, at))
                if k == len(odd):
                    return 0
                at = int(odd[k])
            if at >= len(ids) or state == BROKEN:
                return state
            state = int(self.table[state, ids[at]])
            at += 1

    def feed(self, ids: Iterable[int]) -> str:
        ids = np.fromiter(ids, np.int64)
        self.state = self.states(ids, self.state)
        data = self.rest + b"".join(map(self.vocabulary.__getitem__, ids.tolist()))
        if self.state == BROKEN:
            raise ValueError("the ids are not UTF-8")
        keep = 0
        if self.state:  # back to the lead byte of the unfinished character
            keep = next(k for k in range(1, 5) if data[-k] >= 0xC0)
        self.rest = data[len(data) - keep :]
        return data[: len(data) - keep].decode()

    def finish(self) -> None:
        if self.state:
            raise ValueError("the ids end within a character")


# --- over tables --------------------------------------------------------------------------------------------


class _Pieces(dict):
    """From a piece to its ids as bytes; bounded."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= MAX_CACHED_PIECE:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Transducer, decoder and caches of one worker process."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = read_ranks(path)
        self.pieces = _Pieces(Transducer(self.vocabulary))
        self.decoder = StreamingDecoder(self.vocabulary)
        self.split = regex.compile(pattern)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, a megabyte's pieces at a time."""
        of, parts = self.pieces.__getitem__, []
        if len(text) < 1 << 20:
            parts.append(b"".join(map(of, self.split.findall(text))))
        else:
            buffer: list[bytes] = []
            for m in self.split.finditer(text):
                buffer.append(of(m[0]))
                if len(buffer) > 1 << 18:
                    parts.append(b"".join(buffer))
                    buffer = []
            parts.append(b"".join(buffer))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, checked to be whole UTF-8 characters."""
        if self.decoder.states(ids):
            raise ValueError("the ids are not whole UTF-8 characters")
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this process, made once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
        keep("byte_bpe", _codecs.clear)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids, an array of token ids, for each row of docs (doc_id, text); a null text has none."""
    ship_package(docs.sparkSession)
    file = ship_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(SparkFiles.get(file), pattern)
        for b in batches:
            ids = [bpe.encode(t.as_py() or "") for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text for each row of encoded (doc_id, ids)."""
    ship_package(encoded.sparkSession)
    file = ship_file(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(SparkFiles.get(file), pattern)
        for b in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int64)).decode() for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, and ids if asked for, for each row of docs (doc_id, text): encoded, then decoded from the ids."""
    ship_package(docs.sparkSession)
    file = ship_file(docs.sparkSession, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(SparkFiles.get(file), pattern)
        decimal = [str(k) for k in range(len(bpe.vocabulary))]
        for b in batches:
            n, of_ids, of_text, kept = [], [], [], []
            for t in b["text"]:
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            out = [b["doc_id"], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)
        give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
