"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.tokens import chunks, text_buffer

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is divided before merges; no merge goes over a piece's edge.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond a piece that can still move its end: a contraction has three.
SEEN = 3
FEED = 1 << 19
BATCH_BYTES = 4 << 20
NONE = np.int64(1 << 40)


@dataclass
class Merges:
    """A merge list: left, right and result by merge, in order of priority; and each token's bytes."""

    left: np.ndarray
    right: np.ndarray
    result: np.ndarray
    token_bytes: list[bytes]
    byte_ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.byte_ids = np.full(256, -1, np.int64)
        for i, b in enumerate(self.token_bytes):
            if len(b) == 1:
                self.byte_ids[b[0]] = i
        key = self.left.astype(np.int64) << 32 | self.right
        self._order = np.argsort(key, kind="stable")
        self._keys = np.append(key[self._order], np.iinfo(np.int64).max)
        self._rank = np.append(self._order, NONE)
        self._table = self._fill()

    def _fill(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Hash table of pairs with a bounded number of probes: slot of key k at probe i is (hash + i) modulo its size."""
        bits = max(8, (4 * len(self.left)).bit_length())
        slots, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE)
        todo, probe = np.arange(len(self._keys) - 1), 0
        while len(todo):
            at = (self._hash(self._keys[todo], bits) + probe) & ((1 << bits) - 1)
            free = slots[at] < 0
            at, own = at[free], todo[free]
            _, first = np.unique(at, return_index=True)
            slots[at[first]], ranks[at[first]] = self._keys[own[first]], self._rank[own[first]]
            todo = np.setdiff1d(todo, own[first], assume_unique=True)
            probe += 1
        self._bits = bits
        return slots, ranks, probe

    @staticmethod
    def _hash(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Priority of merging a with b; NONE where they don't merge."""
        slots, ranks, probes = self._table
        key = a << 32 | b
        at = self._hash(key, self._bits)
        found = slots[at]
        out = np.where(found == key, ranks[at], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(1, probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self._bits) - 1)
            found = slots[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    @cached_property
    def lookahead(self) -> int:
        """A number of bytes that suffices: with so many of a text given, from a token's first byte on, its first token is
        that of every continuation.

        reach[t] bounds the bytes after token t on which it can depend that t is formed, given all to its left: at each
        merge (x, v) on t's right edge, v may be taken instead by an earlier merge (v, c), which depends on c's bytes and on
        the reach of c. claim[v] is the most of those over the merges (v, .) so far; priorities only fall along such a chain,
        so one pass over the list, in order, computes both. Once formed, t can still be taken by any merge (t, c).
        """
        size = [len(b) for b in self.token_bytes]
        reach, claim = [0] * len(size), [0] * len(size)
        for u, v, t in zip(self.left.tolist(), self.right.tolist(), self.result.tolist()):
            reach[t] = max(reach[t], reach[v], claim[v])
            claim[u] = max(claim[u], size[v] + reach[v])
        return max((s + max(r, c) for s, r, c in zip(size, reach, claim)), default=1)

    def encode_many(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each of many short strings (ends: where each ends in data), and how many each has.

        In each round every string that isn't done merges its pair of the best priority, at all places from left to right.
        """
        n = len(ends)
        size = np.diff(np.append(0, ends))
        count = np.zeros(n, np.int64)
        out_word, out_place, out_token = [], [], []
        sym = self.byte_ids[data]
        if len(sym) and sym.min() < 0:
            raise ValueError("the vocabulary lacks single bytes that the text has")
        word = np.repeat(np.arange(n), size)
        rank = np.full(len(sym), NONE)
        if len(sym):
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
        while len(sym):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(begin, len(word)))
            best = np.minimum.reduceat(rank, begin)
            done = best == NONE
            if done.any():
                over = np.repeat(done, length)
                out_word.append(word[over])
                out_token.append(sym[over])
                count[word[begin[done]]] = length[done]
                keep = ~over
                sym, word, rank = sym[keep], word[keep], rank[keep]
                best, length = best[~done], length[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, length)
            # overlapping places of one pair (as in aaa) are taken alternately from the left
            clash = hit[1:] & hit[:-1]
            if clash.any():
                at = np.flatnonzero(hit)
                fresh = np.append(True, (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]]))
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            else:
                at = np.flatnonzero(hit)
            sym[at] = self.result[rank[at]]
            rank[at] = -1
            rank[at[at > 0] - 1] = -2
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            # pairs that changed: a merged token with the next, and what is before it with the merged token
            redo = np.flatnonzero(rank < 0)
            last = redo == len(sym) - 1
            nxt = np.minimum(redo + 1, len(sym) - 1)
            same = ~last & (word[nxt] == word[redo])
            rank[redo] = NONE
            redo, nxt = redo[same], nxt[same]
            rank[redo] = self.rank(sym[redo], sym[nxt])
        words = np.concatenate(out_word) if out_word else np.zeros(0, np.int64)
        tokens = np.concatenate(out_token) if out_token else np.zeros(0, np.int64)
        return tokens[np.argsort(words, kind="stable")].astype(np.int32), count

    def encode_bytes(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        return self.encode_many(np.frombuffer(piece, np.uint8), np.array([len(piece)]))[0].tolist()

    def stable(self, piece: bytes, over: bool) -> tuple[list[int], int]:
        """Tokens of a piece whose bytes go on unless it is over, as far as they are final, and how many bytes those have.

        Works on windows of a few lookaheads: a token is final if as many bytes as the lookahead, counted from its first, are
        there. What follows it is encoded as if it began there, since tokens of a text's end don't depend on those before.
        """
        ahead, width, out, at = self.lookahead, 8 * self.lookahead, [], 0
        while at < len(piece):
            whole = over and at + width >= len(piece)
            if not over and len(piece) - at < 2 * ahead:
                break
            window = piece[at : at + width]
            moved = 0
            for token in self.encode_bytes(window):
                if not whole and moved + ahead > len(window):
                    break
                out.append(token)
                moved += len(self.token_bytes[token])
            at += moved
        return out, at


def read_merges(path: str = VOCABULARY) -> Merges:
    """The merge list of a rank file (a line for each token: its bytes in base 64, and its rank).

    A token's merge is the pair that it falls into when it is encoded with the tokens of lesser rank alone.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        tokens[rank] = piece
    left, right, result = [], [], []
    for rank, piece in enumerate(tokens):
        if len(piece) < 2:
            continue
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            best = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, 0))
            if best[0] >= rank:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            left.append(ranks[parts[0]])
            right.append(ranks[parts[1]])
            result.append(rank)
    return Merges(np.array(left, np.int64), np.array(right, np.int64), np.array(result, np.int64), tokens)


def encode_pieces(merges: Merges, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many pieces, one after the other, and how many each has; equal ones are encoded once, long ones in windows."""
    coded = pa.array(pieces, pa.large_string()).dictionary_encode()
    data, ends = text_buffer(coded.dictionary)
    begin = np.append(0, ends[1:-1]) if len(ends) > 1 else ends[:0]
    long = np.flatnonzero(np.diff(ends) > 8 * merges.lookahead)
    if len(long):
        each: list[np.ndarray] = []
        short = np.setdiff1d(np.arange(len(ends) - 1), long)
        part = np.concatenate([data[begin[i] : ends[i + 1]] for i in short]) if len(short) else data[:0]
        tokens, size = merges.encode_many(part, np.cumsum(np.diff(ends)[short]))
        edges, known = np.append(0, np.cumsum(size)), dict(zip(short.tolist(), range(len(short))))
        for i in range(len(ends) - 1):
            each.append(tokens[edges[k] : edges[k + 1]] if (k := known.get(i)) is not None else np.array(merges.stable(data[begin[i] : ends[i + 1]].tobytes(), True)[0], np.int32))
        tokens, size = np.concatenate(each), np.array([len(x) for x in each])
    else:
        tokens, size = merges.encode_many(data, ends[1:])
    index = coded.indices.to_numpy(zero_copy_only=False)
    first, own = (np.cumsum(size) - size)[index], size[index]
    total = np.cumsum(own)
    return tokens[np.repeat(first - (total - own), own) + np.arange(total[-1] if len(total) else 0)], own


class Encoder:
    """Encodes a text that comes in parts: feed() returns the tokens that are final, finish() the rest.

    move() is the transducer's step: it takes characters and emits pieces that are final, and, of a piece that goes on, the
    tokens that are stable. Steps of many encoders share one call of encode_pieces.

    Keeps no more than a part and a few lookaheads, also inside a piece without end.
    """

    def __init__(self, merges: Merges, pieces: str | regex.Pattern = PIECES) -> None:
        self.merges, self.pattern, self.rest = merges, regex.compile(pieces) if isinstance(pieces, str) else pieces, ""

    def feed(self, part: str) -> list[int]:
        self.rest += part
        return self._move(False)

    def finish(self) -> list[int]:
        return self._move(True)

    def _move(self, over: bool) -> list[int]:
        pieces, more = self.move("", over)
        return encode_pieces(self.merges, pieces)[0].tolist() + more

    def move(self, part: str, over: bool) -> tuple[list[str], list[int]]:
        """Final pieces of the text so far, and stable tokens of the one after them, once `part` has come."""
        text = self.rest + part if self.rest else part
        if over:
            self.rest = ""
            return self.pattern.findall(text), []
        done, final, held = 0, [], None
        for found in self.pattern.finditer(text):
            if found.end() + SEEN > len(text):
                held = found
                break
            final.append(found.group())
            done = found.end()
        out: list[int] = []
        limit = 8 * self.merges.lookahead
        if held is not None and len(inside := text[held.start() : max(held.start(), held.end() - SEEN)].encode()) > limit:
            tokens_, moved = self.merges.stable(inside, False)
            # a cut inside a character would leave text that isn't valid
            while tokens_ and moved < len(inside) and inside[moved] & 0xC0 == 0x80:
                moved -= len(self.merges.token_bytes[tokens_.pop()])
            out += tokens_
            done = held.start() + len(inside[:moved].decode())
        self.rest = text[done:]
        return final, out


class Decoder:
    """Tokens to text: feed() returns the characters that are complete, finish() U+FFFD for what isn't.

    The state is what is there of a character that isn't complete: three bytes at most. Bytes that are no UTF-8 become
    U+FFFD, one for each maximal beginning of a character.
    """

    def __init__(self, merges: Merges) -> None:
        self.merges, self.state = merges, b""

    @staticmethod
    def open_bytes(data: bytes) -> int:
        """How many bytes at the end begin a character that may still become complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            second = data[-back + 1] if back > 1 else None
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            return back if second is None or low <= second <= high else 0
        return 0

    def feed(self, tokens: list[int]) -> str:
        return self.push(b"".join(self.merges.token_bytes[t] for t in tokens))

    def push(self, data: bytes) -> str:
        """As feed(), of the tokens' bytes."""
        data = self.state + data
        cut = len(data) - self.open_bytes(data)
        self.state = data[cut:]
        return data[:cut].decode(errors="replace")

    def finish(self) -> str:
        data, self.state = self.state, b""
        return data.decode(errors="replace")


def encode_batch(merges: Merges, texts: pa.Array, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, one after the other, and how many each has.

    Each text goes through an Encoder, FEED characters at a time. The final pieces of all texts are encoded together, and
    whenever as many as a batch's worth are there.
    """
    done: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    pieces: list[str] = []
    count: list[int] = []
    who: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pieces:
            tokens, size = encode_pieces(merges, pieces)
            done.append(tokens)
            owner.append(np.repeat(np.repeat(np.array(who), np.array(count)), size))
        pieces.clear(), count.clear(), who.clear()
        held = 0

    values = texts.to_pylist()
    for i, text in enumerate(values):
        if not text:
            continue
        coder = Encoder(merges, pattern)
        for k in range(0, len(text), FEED):
            found, more = coder.move(text[k : k + FEED] if len(text) > FEED else text, k + FEED >= len(text))
            pieces += found
            count.append(len(found))
            who.append(i)
            held += FEED if len(text) > FEED else len(text)
            if more or held >= 4 * FEED:
                flush()
            if more:
                done.append(np.array(more, np.int32))
                owner.append(np.full(len(more), i))
    flush()
    tokens = np.concatenate(done) if done else np.zeros(0, np.int32)
    return tokens, np.bincount(np.concatenate(owner), minlength=len(values)) if done else np.zeros(len(values), np.int64)


def decoded_bytes(merges: Merges, tokens: np.ndarray, table: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bytes of many tokens; table and edges: all tokens' bytes, one after the other."""
    size = (edges[1:] - edges[:-1])[tokens]
    total = np.cumsum(size)
    return table[np.repeat(edges[tokens] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]


def same_text(merges: Merges, data: np.ndarray, text: str) -> bool:
    """Whether a Decoder makes the text of its tokens' bytes; it takes them FEED at a time and keeps none of what it gave."""
    machine, at = Decoder(merges), 0
    for k in range(0, len(data), FEED):
        part = machine.push(data[k : k + FEED].tobytes())
        if text[at : at + len(part)] != part:
            return False
        at += len(part)
    return at == len(text) and not machine.finish()


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """(doc_id, tokens, n_tokens, n_bytes, exact) of every row: its tokens, and whether decoding them gives its text.

    The vocabulary file is read by the driver alone; its merge list, of fixed size, is broadcast. A null text has null
    tokens, 0 n_tokens and n_bytes, and null exact; an empty one has no tokens. Rows without doc_id and repeated rows are
    handled like others. An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_merges(vocabulary))
    names = ["doc_id", "tokens", "n_tokens", "n_bytes", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, pattern = sent.value, regex.compile(pieces)
        table = np.frombuffer(b"".join(merges.token_bytes), np.uint8)
        edges = np.append(0, np.cumsum([len(b) for b in merges.token_bytes]))
        for batch in chunks(batches, most=BATCH_BYTES):
            texts = batch.column("text")
            tokens, count = encode_batch(merges, texts, pattern)
            _, at = text_buffer(texts)
            back = decoded_bytes(merges, tokens, table, edges)
            ends = np.append(0, np.cumsum((edges[1:] - edges[:-1])[tokens]))[np.append(0, np.cumsum(count))]
            exact = np.array([t is None or same_text(merges, back[a:b], t) for t, a, b in zip(texts.to_pylist(), ends[:-1].tolist(), ends[1:].tolist())], bool)
            nulls = texts.is_null().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.append(0, np.cumsum(count)).astype(np.int32), mask=np.append(nulls, False)) if nulls.any() else pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int32())), pa.array(count, pa.int32()), pa.array(np.diff(at), pa.int64()), pa.array(exact, mask=nulls)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int, n_bytes long, exact boolean")


def decoded(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, tokens); null tokens give a null text.

    Bytes that are no UTF-8 become U+FFFD. Null or unknown tokens in a list raise an error. An empty table gives an empty
    result; other columns are ignored.
    """
    sent = rows.sparkSession.sparkContext.broadcast(read_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for tokens in batch.column("tokens").to_pylist():
                if tokens is None:
                    texts.append(None)
                    continue
                machine = Decoder(sent.value)
                texts.append("".join([machine.feed(tokens[k : k + FEED]) for k in range(0, len(tokens), FEED)]) + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string")
