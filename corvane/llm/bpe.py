"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes if and only if each token encodes itself and each two neighbours
encode, together, to themselves. So each prefix of a word has one last token, and that depends on a few places back
only: on those from which a token may still run on. A state is those places: for each, the node of the token trie that
it has reached and the last token before it. A transition outputs the last token of the prefix read so far; where no
place but the newest is left, what stands before is settled and is emitted. Tokens have a longest, so that comes after
bounded lookahead. States and their byte transitions are made when first met and kept (up to a bound; then the tables
start afresh, as lazy automata do).
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import CACHED


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge(ranks: dict[bytes, int], word: bytes, below: int = 1 << 62) -> list[int]:
    """Plain BPE by pairs of a rank under below: the lowest rank first, of equal ones the leftmost. Takes tokens apart once."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and r < below and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    MAX_STATES = 250_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()  # nodes that have children
        nodes = 1
        for t, r in ranks.items():
            node = 0
            for b in t:
                nxt = self.child.get(node * 256 + b)
                if nxt is None:
                    nxt, nodes = nodes, nodes + 1
                    self.child[node * 256 + b] = nxt
                    self.inner.add(node)
                node = nxt
            self.token_at[node] = r
        self.length = {r: len(t) for t, r in ranks.items()}
        self.SEAM = max(ranks.values(), default=0) + 2
        self.halves: dict[int, tuple[int, int]] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state: its places, oldest first, each as trie node * SEAM + 1 + the last token before it (0: none).
        self.keys: list[tuple[int, ...]] = [(0,)]
        self.number = {self.keys[0]: 0}
        #: By state, its moves: byte -> next state, last token of the prefix, the next state's moves, whether that has one place.
        self.moves: list[dict[int, tuple]] = [{}]
        self.fits: dict[int, bool] = {}

    def _halves(self, t: int) -> tuple[int, int]:
        """The two tokens that t is last merged from; t twice if it is a single byte, (-1, -1) if merges never make it."""
        got = self.halves.get(t)
        if got is None:
            word = self.bytes_of[t]
            if len(word) == 1:
                got = (t, t)
            else:
                parts = merge(self.ranks, word, t)
                got = tuple(parts) if len(parts) == 2 else (-1, -1)
            self.halves[t] = got
        return got

    def _fit(self, a: int, b: int) -> bool:
        """Does token b stand after token a? Both merge trees are taken apart along the seam, the later merge first. If the
        two pieces that meet there are a pair that merges before both pieces have been merged away, b doesn't."""
        ranks, bytes_of = self.ranks, self.bytes_of
        until_a = until_b = 1 << 62  # when, as a rank, the piece at the seam goes into a larger one
        while True:
            r = ranks.get(bytes_of[a] + bytes_of[b])
            # At equal ranks the leftmost pair merges first: left of the seam lies what takes a away, right of it what takes b.
            if r is not None and r < until_a and r <= until_b:
                return False
            # Take apart the piece that was made later; a single byte was there from the start.
            born_a, born_b = (a if len(bytes_of[a]) > 1 else -1), (b if len(bytes_of[b]) > 1 else -1)
            if born_a < 0 and born_b < 0:
                return True
            if born_a >= born_b:
                until_a, a = a, self._halves(a)[1]
            else:
                until_b, b = b, self._halves(b)[0]

    def _state(self, key: tuple[int, ...]) -> int:
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return to

    def _move(self, state: int, byte: int) -> tuple:
        child, inner, token_at, fits, seam = self.child, self.inner, self.token_at, self.fits, self.SEAM
        live, ended = [], -1
        for place in self.keys[state]:
            node = child.get((place // seam) * 256 + byte)
            if node is None:
                continue
            before = place % seam
            if node in inner:
                live.append(node * seam + before)
            if ended < 0 and node in token_at:
                t = token_at[node]
                ok = fits.get(before * seam + t)
                if ok is None:
                    ok = fits[before * seam + t] = self._halves(t)[0] >= 0 and (not before or self._fit(before - 1, t))
                if ok:
                    ended = t
        if ended < 0:
            raise ValueError(f"no token covers byte {byte}")
        live.append(ended + 1)  # the root: a token may start here
        to = self._state(tuple(live))
        got = self.moves[state][byte] = (to, ended, self.moves[to], len(live) == 1)
        return got

    def _settle(self, lasts: list[int]) -> list[int]:
        """The tokens of a prefix, from the last token of each of its prefixes."""
        out, i = [], len(lasts)
        while i:
            t = lasts[i - 1]
            out.append(t)
            i -= self.length[t]
        out.reverse()
        return out

    #: Bytes after which the tables' size is looked at.
    LOOK = 4096

    def feed(self, piece: bytes, state: int, lasts: list[int]) -> tuple[list[int], int]:
        """Tokens that piece settles, and the next state; lasts, what is not settled yet, is changed. A token is settled where no place but the last is left: from
        there on, nothing can change what stands before. That is at most as far ahead as tokens overlap. Tables that have outgrown MAX_STATES start afresh, within a word too."""
        out: list[int] = []
        for lo in range(0, len(piece), self.LOOK):
            if len(self.keys) > self.MAX_STATES:
                key = self.keys[state]
                self._reset()
                state = self._state(key)
            moves = self.moves[state]
            for byte in piece[lo : lo + self.LOOK] if lo or len(piece) > self.LOOK else piece:
                state, t, moves, settled = moves.get(byte) or self._move(state, byte)
                if not settled:
                    lasts.append(t)
                elif lasts:
                    lasts.append(t)
                    out += self._settle(lasts)
                    lasts.clear()
                else:
                    out.append(t)
        return out, state

    def stream(self, pieces):
        """Tokens of a word that comes in pieces."""
        state, lasts = 0, []
        for piece in pieces:
            out, state = self.feed(piece, state, lasts)
            yield from out
        yield from self._settle(lasts)

    def run(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        if whole is not None:  # a word that is a token is that token, whether merges reach it or not
            return (whole,)
        lasts: list[int] = []
        out, _ = self.feed(word, 0, lasts)
        return (*out, *self._settle(lasts)) if lasts else tuple(out)


class _Words(dict):
    """Ids of words met lately: two generations, so that frequent words stay when the newer one is full."""

    MAX = 200_000

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.MAX:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.transducer.run(word.encode())
        if len(word) <= CACHED:
            self[word] = ids
        return ids


class Utf8Stream:
    """Incremental UTF-8: feed(bytes) gives the text that is complete; finish() the rest. The state is the start of a
    sequence that has not ended (three bytes at most). What is not UTF-8 becomes U+FFFD."""

    def __init__(self):
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                if (2 if b < 0xE0 else 3 if b < 0xF0 else 4) > back:
                    cut = len(data) - back
                break
            if b < 0x80:
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open.decode("utf-8", "replace"), b""
        return rest


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words = _Words(Transducer(ranks))
        self.find = regex.compile(pattern).findall
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.names = [str(i) for i in range(size)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.find(text))))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_stream(self, ids, step: int = 4096):
        """Text, piece by piece."""
        s = Utf8Stream()
        for i in range(0, len(ids), step):
            yield s.feed(self.decode_bytes(ids[i : i + step]))
        yield s.finish()


_ready: dict[str, ByteBPE] = {}


def _tokenizer(name: str, data: bytes, pattern: str) -> ByteBPE:
    """One for each worker process, so that its tables stay warm from task to task."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = ByteBPE(read_ranks(data), pattern)
    return _ready[name]


def _over_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    """row(tokenizer, text) -> the columns after doc_id. The vocabulary, of fixed size, is broadcast."""
    with open(ranks_path, "rb") as f:
        data = f.read()
    name = hashlib.sha256(data + pattern.encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def work(batches):
        t = _tokenizer(name, sent.value, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 256):
                rows = [row(t, x or "") for x in texts[lo : lo + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 256], *map(pa.array, zip(*rows, strict=True))], schema=arrow)

    out = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return out.mapInArrow(work, schema)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>. A null or empty text has no ids; repeated rows repeat."""
    return _over_texts(docs, ranks_path, pattern, id_col, text_col, "doc_id bigint, ids array<int>", lambda t, x: (t.encode(x),))


def _digests(t: ByteBPE, text: str) -> tuple[int, str, str]:
    ids = t.encode(text)
    decoded = hashlib.sha256()
    for piece in t.decode_stream(ids):
        decoded.update(piece.encode())
    return len(ids), hashlib.sha256(",".join(map(t.names.__getitem__, ids)).encode()).hexdigest(), decoded.hexdigest()


def round_trips(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; a null text is empty, an empty one has no token. Rows that repeat are encoded alike,
    texts of any length whole; an empty table gives an empty one; further columns of any name aren't read."""
    return _over_texts(docs, ranks_path, pattern, id_col, text_col, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests)
