"""BPE as a streaming transducer with bounded lookahead, and incremental decoding.

A merge list has a *sufficient lookahead*: however a text goes on, a token boundary that lies that many symbols before
the end of what has been read can't change any more. Two runs over texts with a common prefix differ first at the end
of the prefix; the difference moves left only through a chain of merges of increasing rank, in which each merge's
right part is the previous one's left part (that part is taken in one run and still free in the other). The longest
such chain, in symbols, is the lookahead; one pass over the merges from last to first finds it.

The encoder therefore keeps at most block + lookahead symbols, emits the stable tokens and goes on behind them: a
boundary of the final tokens splits the text into two parts that are tokenised independently.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces

END = "</w>"
_BREAK = re.compile(rb"[\t-\r ]")
#: White space, or where a word ends whatever surrounds it: between an ASCII letter or digit and a digit, and between a full-width
#: stop or comma and an ideograph or kana. None of these is changed by, or changes, a character beside it.
_TURN = re.compile(rb"[\t-\r ]|(?<=[0-9A-Za-z])(?=[0-9])|(?<=\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9f])(?=\xe4[\xb8-\xbf]|[\xe5-\xe9]|\xe3\x81[\x82-\xbf])")
SPACES = r"\t-\r\x85\p{Z}"


def byte_letters() -> list[str]:
    """The printable letter of each byte: Latin-1's printable characters stand for themselves, the others move up from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = (chr(256 + i) for i in range(256))
    return [chr(b) if b in own else next(moved) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], symbols) -> int:
    """Symbols that suffice to make a boundary final; ``symbols(token)`` is a token's length in symbols."""
    best: dict[str, int] = {}
    most = 0
    for u, v in reversed(merges):  # from the last rank to the first: ``best`` has only later merges
        reach = symbols(u) + best.get(u, 0)
        if reach > best.get(v, 0):
            best[v] = reach
        most = max(most, reach + symbols(v))
    return most


NEVER = 1 << 60


class _Known(dict):
    """Ids of pieces seen so far; at ``keep`` entries the young generation becomes the old one, so memory is bounded."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """A BPE vocabulary file of the tokenizers library: word ends marked, lower case, white space dropped."""

    def __init__(self, content: str, keep: int = 100_000):
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.added).items()}
        self.packed = {t: i.to_bytes(4, "little") for t, i in (self.ids | self.added).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.lookahead = lookahead(pairs, self.symbols)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # an added token that holds such an end of a word could be cut by it
        self.turns = not any(_TURN.search(t.encode()) for t in self.added)
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        self.known = _Known(self._piece, keep)

    @staticmethod
    def symbols(token: str) -> int:
        return len(token) - (len(END) if token.endswith(END) and len(token) > len(END) else 0)

    # -- encoding

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges of a run of symbols, lowest rank first, leftmost first."""
        if len(symbols) > 64:
            return self._merge_long(symbols)
        rank = self.rank.get
        ranks = [rank(p, NEVER) for p in zip(symbols, symbols[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), NEVER)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), NEVER)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        rank, n = self.rank, len(symbols)
        part: list[str | None] = list(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, u, v = heapq.heappop(heap)
            j = after[i]
            if part[i] != u or j < 0 or part[j] != v:
                continue
            part[i], part[j] = u + v, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, part[a], part[b]))
        return [p for p in part if p is not None]

    def transduce(self, symbols: Iterable[str], block: int = 4096) -> Iterator[str]:
        """Tokens of one word's symbols (any number, the last with its word end), emitted as soon as they are stable."""
        symbols, most = iter(symbols), block + self.lookahead
        held = list(islice(symbols, most + 1))
        while len(held) > most:
            at, limit = 0, len(held) - self.lookahead
            for t in self.merge(list(held)):
                if at + self.symbols(t) > limit:
                    break
                at += self.symbols(t)
                yield t
            del held[:at]
            more = list(islice(symbols, max(block, most + 1 - len(held))))
            if not more:
                break
            held += more
        yield from self.merge(held)

    def _word(self, word: str) -> bytes:
        raw, letters, packed = word.encode(), self.letters, self.packed
        if len(raw) <= 64:
            symbols = [letters[b] for b in raw]
            symbols[-1] += END
        else:  # as they are needed
            last = len(raw) - 1
            symbols = (letters[b] + (END if i == last else "") for i, b in enumerate(raw))
        return b"".join([packed[t] for t in self.transduce(symbols)])

    def _plain(self, text: str) -> bytes:
        plain = text.isascii()
        if not plain:
            # a capital sigma is lowered without regard to its place in the word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        words = self.words.findall(text.lower())
        if len(words) == 1 or not plain:
            return b"".join(map(self._word, words))
        return b"".join([self._word(w) if w == text else self.known[w.encode()] for w in words])

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if not self.special or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at: m.start()]), self.packed[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text as little-endian uint32."""
        return b"".join(self.stream(text))

    def stream(self, text: bytes, block: int = 1 << 20) -> Iterator[bytes]:
        """Ids of a text, block by block. White space always ends a word, so pieces between it stand alone, and blocks are
        cut there. Where a block has none, it is cut at another end of a word that no context can undo (``_TURN``); only a
        longer run of letters, or of marks, is a block of its own, whose symbols the transducer takes one by one."""
        at = 0
        while at < len(text):
            upto = min(at + block, len(text))
            cut = _BREAK.search(text, upto, upto + block)
            if cut:
                end = cut.start()
            elif upto + block >= len(text):
                end = len(text)
            else:
                turn = _TURN.search(text, upto) if self.turns else _BREAK.search(text, upto)
                end = turn.start() if turn else len(text)
            yield b"".join(map(self.known.__getitem__, text[at:end].split()))
            at = end


class Decoder:
    """Ids to text, a piece at a time, as an incremental byte-to-text state machine.

    A token stands for bytes; what it leaves unfinished of a character is the state, beside whether anything came before.
    A file without a decoder joins its tokens by spaces as they are written (``raw`` False); with ``raw`` the letters are
    turned back into the text's own bytes and word ends into spaces.
    """

    def __init__(self, vocabulary: Vocabulary, raw: bool = False):
        byte = {letter: bytes([b]) for b, letter in enumerate(vocabulary.letters)}

        def own(token: str) -> bytes:
            word = token.endswith(END) and len(token) > len(END)
            return b"".join(byte.get(c, c.encode()) for c in (token[: -len(END)] if word else token)) + (b" " if word else b"")

        tokens = vocabulary.tokens
        write = own if raw else str.encode
        self.table = [write(tokens.get(i, "")) for i in range(max(tokens) + 1)]
        self.known = np.zeros(len(self.table), bool)
        self.known[list(tokens)] = True
        self.between = b"" if raw else b" "
        self.reset()

    def feed(self, ids: np.ndarray) -> str:
        """The text that these ids complete."""
        ids = ids[(ids < len(self.table))]
        ids = ids[self.known[ids]]
        if not len(ids):
            return ""
        text = self.between.join(map(self.table.__getitem__, ids.tolist()))
        if self.started:
            text = self.between + text
        self.started = True
        return self.characters.decode(text)

    def finish(self) -> str:
        """What is left of a character that never ended, as replacement characters; then the state is fresh."""
        left = self.characters.decode(b"", final=True)
        self.reset()
        return left

    def reset(self) -> None:
        self.started, self.characters = False, codecs.getincrementaldecoder("utf-8")("replace")


@lru_cache(2)
def _load(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Vocabulary(f.read())


def _ship(docs: DataFrame, vocabulary: str) -> str:
    """Gives every executor the vocabulary file (a fixed few MB)."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    return vocabulary.rsplit("/", 1)[-1]


def encode_documents(docs: DataFrame, vocabulary: str, decode: bool = True, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and (``decode``) decoded_sha256 of every row; ``with_ids`` adds the ids.

    Map-only; texts go through in blocks, so that beside one Arrow batch memory is bounded by a block (or a longer word),
    one word's lookahead buffer and a bounded word cache; only ``with_ids`` holds a text's ids. Null and empty texts have no
    tokens. Rows, repeated or not, of whatever id, each get their result; columns not in ``keep`` play no part.
    """
    name = _ship(docs, vocabulary)
    slim = docs.select(*keep, "text")
    extra = (["decoded_sha256"] if decode else []) + (["ids"] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _load(name)
        d = Decoder(v)
        for b in pieces(batches):
            n, shas, decoded, every = [], [], [], []
            for text in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist():
                many, sha, back, parts = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in v.stream(text or b""):
                    sha.update(ids)
                    many += len(ids) // 4
                    if with_ids:
                        parts.append(ids)
                    if decode:
                        a = np.frombuffer(ids, "<u4")
                        for i in range(0, len(a), 65_536):
                            back.update(d.feed(a[i: i + 65_536]).encode())
                n.append(many)
                shas.append(sha.hexdigest())
                if with_ids:
                    every.append(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                if decode:
                    back.update(d.finish().encode())
                    decoded.append(back.hexdigest())
            cols = [pa.array(n, pa.int64()), pa.array(shas, pa.string())]
            cols += [pa.array(decoded, pa.string())] if decode else []
            cols += [pa.array(every, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*keep, "n_tokens", "ids_sha256", *extra])

    schema = slim.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string")
    schema = schema.add("decoded_sha256", "string") if decode else schema
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema
    return slim.mapInArrow(run, schema)
