"""Byte-level BPE as a lazily determinised finite-state transducer.

Encoding.  A text is cut by the tokenizer's pattern, and each piece is fed byte by
byte to a transducer.  The merges are compiled into two things.  One is an automaton
over bytes that knows all tokens ending at a position: a token may begin at every
byte, a deterministic state is the set of all that have begun, and states and
transitions are built the first time they are reached.  The other says which token may follow
which: two tokens may be neighbours only if BPE, run on the bytes of the two, gives
exactly those two, and a sequence all of whose neighbours may be is the BPE result.
So exactly one token can end at a position, and the one before it is known.  Tokens
are emitted as soon as all those that could still begin agree on them; the lookahead
is bounded by the tokens' length, not the piece's.  Texts go through in blocks, and equal stretches of a
block are encoded once, all of them byte by byte in step.  Moves and token pairs are remembered up to fixed
numbers, until the task ends, so memory stays bounded whatever the texts hold.

Decoding.  Ids become bytes; an incremental UTF-8 state machine passes whole
characters on and keeps the start of a split one for the next chunk.

Null text counts as empty and empty text has no tokens; special tokens do not exist, their strings are
ordinary text.  Repeated rows give repeated results.  Unknown ids are an error.
Columns beyond those named are dropped from results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from modgauge.llm.text import blocks, flat

# Bounds on what a task remembers: token pairs and moves of the transducer.
MAX_PAIRS = 500_000
MAX_MOVES = 500_000

# Longer pieces are encoded one by one.
LONGEST = 64

# Bytes of a piece after which finished tokens are emitted.
LOOKAHEAD = 512

# Bytes of text whose equal stretches are encoded once.
ENCODE_BYTES = 2 << 20

# Bytes that go through the decoder at a time.
DECODE_BYTES = 1 << 16

Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """Token bytes and ids of a rank file: base64, space, id on every line."""
    with open(path, "rb") as lines:
        fields = (line.split() for line in lines)
        return {base64.b64decode(f[0]): int(f[1]) for f in fields if f}


def merged(piece: bytes, ranks: Ranks, below: int = 1 << 62) -> list[bytes]:
    """Plain BPE: join the neighbours of the lowest rank, leftmost first, by merges under `below`."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min(
            (ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)
        )
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """The lazily built automaton over one vocabulary."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.words = {rank: word for word, rank in ranks.items()}
        # Trie as one dict: node and byte to node; node 0 is the root.
        self.next_node: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                key = node << 8 | byte
                if key not in self.next_node:
                    self.next_node[key] = nodes
                    nodes += 1
                node = self.next_node[key]
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        # A state is the tuple of trie nodes of all begun tokens, longest first.  The
        # longest determines the others, so there are no more states than nodes.
        self.states: list[tuple[int, ...]] = [()]
        self.numbers: dict[tuple[int, ...], int] = {(): 0}
        self.moves: dict[int, int] = {}
        # Tokens that end in a state, longest first, with their lengths.
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.longest = max(map(len, ranks), default=1)
        self.sizes = np.zeros(max(self.words, default=0) + 1, np.int64)
        self.sizes[list(self.words)] = [len(word) for word in self.words.values()]

    def _build_move(self, state: int, byte: int) -> int:
        onward = (self.next_node.get(n << 8 | byte) for n in (*self.states[state], 0))
        key = tuple(n for n in onward if n is not None)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            tokens = (self.token_at[n] for n in key if n in self.token_at)
            whole = (t for t in tokens if merged(self.words[t], self.ranks) == [self.words[t]])
            self.ends.append([(t, len(self.words[t])) for t in whole])
        if len(self.moves) >= MAX_MOVES:
            self.moves.clear()
        self.moves[state << 8 | byte] = number
        return number

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives `token`; None for a single byte."""
        if token not in self.splits:
            word = self.words[token]
            parts = merged(word, self.ranks, token) if len(word) > 1 else []
            self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if parts else None
        return self.splits[token]

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both tokens gives these two.

        The merges of both are undone, the latest first, as far as they touch the border.  If ever the two
        tokens at the border could have merged before the merge undone last, BPE would have done that.
        Of equal merges the left one comes first.
        """
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = known = self._holds_apart(left, right)
        return known

    def _holds_apart(self, a: int, b: int) -> bool:
        words, ranks = self.words, self.ranks
        limit = 1 << 62
        while True:
            if ranks.get(words[a] + words[b], 1 << 62) < limit:
                return False
            left, right = self._split(a), self._split(b)
            if left is None and right is None:
                return True
            # The left token's own merge happens before an equal one on the right.
            if right is None or left is not None and a > b:
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        # The piece as one token wins, as in the library whose ids are wanted.
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        words, ends, moves, pairs = self.words, self.ends, self.moves, self.pairs.get
        out: list[int] = []
        last = [-1]  # the token that ends at each position; None where none can
        state, emits = 0, LOOKAHEAD + self.longest
        at = 0
        for byte in piece:
            at += 1
            move = moves.get(state << 8 | byte)
            state = self._build_move(state, byte) if move is None else move
            found = None
            for token, size in ends[state]:
                if size >= at:
                    if size == at and last[0] == -1:  # the first token of all
                        found = token
                        break
                    if size > at:  # it began before what has been emitted
                        continue
                before = last[at - size]
                if before is None:
                    continue
                valid = pairs(before << 32 | token)
                if valid or valid is None and self._may_follow(before, token):
                    found = token
                    break
            last.append(found)
            if at >= emits:
                last = self._emit(last, out)
                at = len(last) - 1
        self._path(last, len(last) - 1, out)
        return out

    def _moved(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states that follow, each distinct move looked up or built once."""
        keys, place = np.unique(states << 8 | byte, return_inverse=True)
        known = self.moves.get
        found = [known(k) for k in keys.tolist()]
        for i, move in enumerate(found):
            if move is None:
                found[i] = self._build_move(int(keys[i]) >> 8, int(keys[i]) & 255)
        return np.array(found, np.int64)[place]

    def _hold_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, place = np.unique(left << 32 | right, return_inverse=True)
        known = self.pairs.get
        found = [known(k) for k in keys.tolist()]
        for i, valid in enumerate(found):
            if valid is None:
                found[i] = self._may_follow(int(keys[i]) >> 32, int(keys[i]) & 0xFFFFFFFF)
        return np.array(found, bool)[place]

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of pieces of LONGEST bytes at most, which take each byte in step.

        As encode_piece; as the pieces are short, tokens are emitted at their ends.
        """
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-lengths, kind="stable")  # those that go on stand first
        width = int(lengths.max(initial=0))
        table = np.zeros((n, width), np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        rows = np.repeat(np.arange(n), lengths)
        table[rows, np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = data
        table, lengths = table[order], lengths[order]
        last = np.full((n, width + 1), -2, np.int64)  # -2: no token can end here
        last[:, 0] = -1
        state = np.zeros(n, np.int64)
        for at in range(1, width + 1):
            going = int(np.searchsorted(-lengths, -at, "right"))
            state = self._moved(state[:going], table[:going, at - 1])
            distinct, place = np.unique(state, return_inverse=True)
            ending = [self.ends[i] for i in distinct.tolist()]
            open_ = np.arange(going)
            for nth in range(max(map(len, ending), default=0)):
                token, size = np.array([e[nth] if nth < len(e) else (-1, 0) for e in ending], np.int64).T
                token, size = token[place[open_]], size[place[open_]]
                open_, token, size = (x[token >= 0] for x in (open_, token, size))
                before = last[open_, at - size]
                fits = before == -1
                asked = np.flatnonzero(before >= 0)
                fits[asked] = self._hold_apart(before[asked], token[asked])
                last[open_[fits], at] = token[fits]
                open_ = open_[~fits]
                if not len(open_):
                    break
        if (last[np.arange(n), lengths] == -2).any():
            raise ValueError("the vocabulary lacks some single bytes")
        # Walk back from the ends, one token a step.
        walked, at, live = [], lengths.copy(), np.flatnonzero(lengths)
        while len(live):
            token = last[live, at[live]]
            walked.append((live, token))
            at[live] -= self.sizes[token]
            live = live[at[live] > 0]
        row = np.concatenate([r for r, _ in walked]) if walked else np.zeros(0, np.int64)
        step = np.repeat(np.arange(len(walked)), [len(r) for r, _ in walked])
        token = np.concatenate([t for _, t in walked]) if walked else np.zeros(0, np.int64)
        original = order[row]
        sorted_ = np.lexsort((-step, original))
        ends = np.concatenate([[0], np.cumsum(np.bincount(original, minlength=n))])
        return token[sorted_].astype(np.int32), ends.astype(np.int64)

    def _path(self, last: list, end: int, out: list[int], start: int = 0) -> None:
        """Append the tokens between two positions."""
        tokens = []
        while end > start:
            if last[end] is None:
                raise ValueError("the vocabulary lacks some single bytes")
            tokens.append(last[end])
            end -= len(self.words[last[end]])
        out += reversed(tokens)

    def _emit(self, last: list, out: list[int]) -> list:
        """Emit what all live positions agree on; the rest of `last`."""
        live = {i for i in range(len(last) - self.longest, len(last)) if last[i] is not None}
        while len(live) > 1:  # step back from the furthest until they meet
            furthest = max(live)
            live.remove(furthest)
            live.add(furthest - len(self.words[last[furthest]]))
        at = live.pop()
        if at:
            self._path(last, at, out)
        return last[at:]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids, pa.int32()))


def _flat_lists(lists: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of lists without nulls that begin at their first value."""
    ends = lists.offsets.to_numpy(zero_copy_only=False)
    return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


class Codec:
    """Encoder and decoder over whole texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.words = self.transducer.words
        self.cut = regex.compile(pattern).findall
        slots = range(len(self.transducer.sizes))
        self.decimals = pa.array([b"%d " % i for i in slots], pa.large_binary())
        self.bytes_of = pa.array([self.words.get(i, b"") for i in slots], pa.large_binary())

    def forget(self) -> None:
        """Drop what was remembered; the vocabulary and its states stay."""
        self.transducer.pairs.clear()
        self.transducer.moves.clear()

    def _encode_pieces(self, pieces: list[bytes]) -> pa.LargeListArray:
        """Ids of every piece; equal pieces are encoded once."""
        coded = pa.array(pieces, pa.binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        rank = self.transducer.ranks.get
        known = [rank(piece) for piece in distinct]
        short = [i for i, r in enumerate(known) if r is None and len(distinct[i]) <= LONGEST]
        ids, ends = self.transducer.encode_many([distinct[i] for i in short])
        parts, counts = [ids], np.ones(len(distinct), np.int64)
        # Where each piece's ids begin among those of the short, the known and the long ones.
        begin = np.zeros(len(distinct), np.int64)
        begin[short], counts[short] = ends[:-1], np.diff(ends)
        whole = [i for i, r in enumerate(known) if r is not None]
        begin[whole] = len(ids) + np.arange(len(whole))
        parts.append(np.array([known[i] for i in whole], np.int32))
        size = len(ids) + len(whole)
        for i, piece in enumerate(distinct):
            if len(piece) > LONGEST and known[i] is None:
                found = np.array(self.transducer.encode_piece(piece), np.int32)
                begin[i], counts[i] = size, len(found)
                parts.append(found)
                size += len(found)
        stops = np.concatenate([[0], np.cumsum(counts)])
        place = np.arange(stops[-1]) - np.repeat(stops[:-1] - begin, counts)
        return _lists(np.concatenate(parts)[place], stops).take(coded.indices)

    def _cut_up(self, texts: list[str]) -> pa.LargeListArray:
        """Ids of texts that are cut by the pattern alone."""
        cut = [self.cut(text) for text in texts]
        ids, ends = _flat_lists(self._encode_pieces([p.encode() for pieces in cut for p in pieces]))
        return _lists(ids, ends[np.cumsum([0, *map(len, cut)])])

    def _stretches(self, stretches: list[bytes]) -> pa.LargeListArray:
        """Ids of stretches that each follow a space: one text, in which that space begins a piece."""
        pieces = self.cut(b"".join([b" " + s for s in stretches]).decode("utf-8", "replace"))
        ids, ends = _flat_lists(self._encode_pieces([p.encode() for p in pieces]))
        first = np.flatnonzero([p[0] == " " for p in pieces]) if pieces else np.zeros(0, np.int64)
        return _lists(ids, ends[np.append(first, len(pieces))])

    @staticmethod
    def _stays(stretch: bytes) -> bool:
        """Whether a text may not be cut at the space before a stretch."""
        text = stretch.decode("utf-8", "replace")
        return not text or text[0].isspace() or text[-1].isspace()

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends by text) of a block of texts.

        A space between two other characters always begins a piece, so texts
        are cut there first, and equal stretches of the block are encoded once.  Runs of white space belong
        together; a text with such a run at a space is cut by the pattern alone.
        """
        texts = len(offsets) - 1
        space = np.flatnonzero(data == 0x20)
        held = data[data != 0x20]
        # A stretch begins with each text and after each space; in `held` there are no spaces.
        before = np.searchsorted(space, offsets)
        counts = 1 + np.diff(before)
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(texts), counts)
        follows = np.ones(len(owner), bool)
        follows[first] = False
        starts = np.empty(len(owner) + 1, np.int64)
        starts[:-1][first] = offsets[:-1] - before[:-1]
        starts[:-1][follows] = space + 1 - np.arange(1, len(space) + 1)
        starts[-1] = len(held)
        stretches = pa.Array.from_buffers(
            pa.large_binary(), len(owner), [None, pa.py_buffer(starts), pa.py_buffer(held)]
        )
        coded = stretches.filter(pa.array(follows)).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary.to_pylist()
        stays = np.array([self._stays(s) for s in distinct], bool)
        whole = np.zeros(texts, bool)  # cut by the pattern alone
        whole[owner[follows][stays[which]]] = True
        view, heads = memoryview(data), stretches.take(pa.array(first)).to_pylist()
        for i in range(texts):
            head = heads[i].decode("utf-8", "replace")
            if whole[i] or counts[i] > 1 and (not head or head[-1].isspace()):
                whole[i] = True
                head = bytes(view[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")
            heads[i] = head
        kept = np.flatnonzero(~stays)
        values = pa.concat_arrays(
            [
                _lists(np.zeros(0, np.int32), np.zeros(2, np.int64)),
                self._stretches([distinct[i] for i in kept.tolist()]),
                self._cut_up(heads),
            ]
        )
        place = np.zeros(len(distinct), np.int64)
        place[kept] = 1 + np.arange(len(kept))
        number = np.zeros(len(owner), np.int64)
        number[follows] = np.where(whole[owner[follows]], 0, place[which])
        number[first] = 1 + len(kept) + np.arange(texts)
        ids, ends = _flat_lists(values.take(pa.array(number)))
        return ids, ends[np.append(first, len(owner))]

    def encode(self, text: str) -> list[int]:
        """Token ids of one text."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_block(data, np.array([0, len(data)]))[0].tolist()

    def _joined(self, table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        joined, stops = flat(table.take(pa.array(ids)))
        return memoryview(joined), stops[ends]

    def decimals_of(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(bytes, ends by text): the ids as decimals, each with a space after it."""
        return self._joined(self.decimals, ids, ends)

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(bytes, ends by text): the bytes that the ids stand for."""
        return self._joined(self.bytes_of, ids, ends)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Texts of successive chunks of ids; a split character waits for its end."""
        machine = Utf8Machine()
        for ids in chunks:
            yield machine.feed(self.decode_bytes(ids))
        yield machine.finish()


class Utf8Machine:
    """Incremental UTF-8: whole characters go on, the start of a split one waits."""

    def __init__(self):
        self.pending = b""

    @staticmethod
    def _complete(data: bytes) -> int:
        """Length of the part of `data` that ends with a whole character."""
        for back in range(1, min(4, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # first byte of the last character
                needs = 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return len(data) - back if needs > back else len(data)
        return len(data)

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        at = self._complete(data)
        self.pending = data[at:]
        return data[:at].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and vocabulary."""
    return Codec(path, pattern)


def _id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def _encoded(column: pa.Array, own: Codec) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, ends) of a column, a block of rows at a time."""
    data, offsets = flat(column)
    for first, last in blocks(offsets, ENCODE_BYTES):
        start, end = offsets[first], offsets[last]
        yield first, last, *own.encode_block(data[start:end], offsets[first : last + 1] - start)


def encode(docs: DataFrame, path: str, pattern: str, key: Column, text: Column) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text; a null text has none.

    `path` names the rank file, which every executor must hold at that place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        try:
            for batch in batches:
                for first, last, ids, ends in _encoded(batch.column(1), own):
                    keys = batch.column(0).slice(first, last - first)
                    yield pa.RecordBatch.from_arrays([keys, _id_lists(ids, ends)], ["doc_id", "ids"])
        finally:
            own.forget()

    return docs.select(key.cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>"
    )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text): the texts of encoded rows, through the UTF-8 state machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = []
            for ids in batch.column("ids"):
                ids = ids.as_py() or []
                chunks = (ids[i : i + 4096] for i in range(0, len(ids), 4096))
                found.append("".join(own.decode_stream(chunks)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(
    docs: DataFrame, path: str, pattern: str, with_ids: bool = False, place: str | None = None
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, place]) of every whole text.

    Encodes each text and decodes the ids again in the same task.  `place` names a
    bigint column that is handed through.
    """
    extra = [*(["ids"] if with_ids else []), *([place] if place else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        try:
            for batch in batches:
                for first, last, ids, ends in _encoded(batch.column(1), own):
                    yield rows(batch.slice(first, last - first), ids, ends, own)
        finally:
            own.forget()

    def rows(batch: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray, own: Codec) -> pa.RecordBatch:
        (decimals, cuts), (back, stops) = own.decimals_of(ids, ends), own.decoded(ids, ends)
        n, encoded, decoded = batch.num_rows, [], []
        for start, end in zip(cuts[:n].tolist(), cuts[1:].tolist(), strict=True):
            # Without the space after the last id.
            encoded.append(hashlib.sha256(decimals[start : max(start, end - 1)]).hexdigest())
        for start, end in zip(stops[:n].tolist(), stops[1:].tolist(), strict=True):
            machine, digest = Utf8Machine(), hashlib.sha256()
            for at in range(start, end, DECODE_BYTES):
                digest.update(machine.feed(bytes(back[at : min(at + DECODE_BYTES, end)])).encode())
            digest.update(machine.finish().encode())
            decoded.append(digest.hexdigest())
        columns = [
            batch.column(0),
            pa.array(np.diff(ends), pa.int64()),
            pa.array(encoded, pa.string()),
            pa.array(decoded, pa.string()),
        ]
        if with_ids:
            columns.append(_id_lists(ids, ends))
        columns += batch.columns[2:]
        return pa.RecordBatch.from_arrays(
            columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *extra]
        )

    handed = [F.col(place).cast("bigint").alias(place)] if place else []
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text"), *handed).mapInArrow(
        run,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        + (", ids array<int>" if with_ids else "")
        + (f", `{place}` bigint" if place else ""),
    )
