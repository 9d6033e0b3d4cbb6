"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Encoding.  A text is read as a stream of units that end where no later text can change the tokens
before them (a single space or newline between visible characters, else a pre-token), some 65,000
characters at a time.  Inside a unit the merge list is run on windows: ``lookahead`` is a number of bytes, computed from the merge list,
beyond which text cannot change a token boundary, so tokens that end that far before the window's end
are emitted and the window moves on from the last emitted boundary.  ``encode_decode_digests`` feeds ids to
the digest and the decoder as they come.  Beside the text itself, state is one stretch, one window
and a bounded memo, however long the text or a single run of letters is.

Why ``lookahead`` suffices.  Text to the right of a point can change a merge on its left only through
a chain of merges, each of which takes or leaves the first symbol of the one to its right and comes
later in the merge list.  ``sufficient_lookahead`` is the longest such chain, in bytes.

Null and empty texts have no tokens.  Strings of added tokens in a text become those tokens, as the
tokenizers library does by default.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: White space by Unicode's White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The pre-token pattern published with byte-level BPE vocabularies.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Characters of a text that are split at a time.
STRETCH = 1 << 16
#: Memo entries kept by each worker, of each kind of unit.
MEMO_ENTRIES = 150_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    return letters


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes of right context that decide a token boundary: the longest chain of merges that hand a change leftwards."""
    reach: dict[bytes, int] = {}  # by prefix of a right part: the longest chain, in bytes, that later merges carry on
    most = 0
    for left, right in reversed(merges):
        here = len(left) + reach.get(left, 0)
        most = max(most, here + len(right))
        for k in range(1, len(right) + 1):
            p = right[:k]
            if here > reach.get(p, 0):
                reach[p] = here
    return most


class Vocabulary:
    """Merges, ids and added tokens of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.rank = {(self.ids[a], self.ids[b]): r << 20 | self.ids[a + b] for r, (a, b) in enumerate(self.merges)}
        self.of_byte = [self.ids[bytes([b])] for b in range(256)]
        self.lookahead = sufficient_lookahead(self.merges)


class _Memo(dict):
    """Bounded: once full, further units are worked out each time."""

    def __init__(self, work, room: int):
        super().__init__()
        self.work, self.room = work, room

    def __missing__(self, key):
        out = self.work(key)
        if len(self) < self.room and len(key) <= 64:
            self[key] = out
        return out


class Encoder:
    """The streaming transducer: ``pieces`` yields id bytes (little-endian unsigned 32-bit) as they become stable."""

    def __init__(self, vocab: Vocabulary, window: int | None = None, room: int = MEMO_ENTRIES):
        import regex

        self.v = vocab
        self.window = max(window or 4096, 2 * vocab.lookahead + 2)
        self.pretoken = regex.compile(PRETOKEN)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(vocab.added, key=len, reverse=True))) + ")") if vocab.added else None
        self.odd = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
        self.word = _Memo(self._pretoken, room)
        self.first = _Memo(self._unit, room)
        self.spaced = _Memo(self._spaced, room)
        self.newline = self._pretoken("\n")

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one window: the lowest-ranked, leftmost pair is merged first."""
        ids = [self.v.of_byte[b] for b in raw]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, none = self.v.rank.get, 1 << 60
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i, new = ranks.index(best), best & 0xFFFFF
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.v.rank
        after, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r >> 20, i, ids[i], ids[i + 1], r & 0xFFFFF) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                prev[k] = i
                if (r := rank.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (r >> 20, i, new, ids[k], r & 0xFFFFF))
            h = prev[i]
            if h >= 0 and (r := rank.get((ids[h], new))) is not None:
                heapq.heappush(heap, (r >> 20, h, ids[h], new, r & 0xFFFFF))
        return [x for x in ids if x >= 0]

    def _run(self, text: str, at: int, stop: int):
        """Ids of one pre-token, window by window; only one window of it is held."""
        import array

        raw = b""
        while True:
            while len(raw) <= self.window and at < stop:
                part = text[at : min(stop, at + self.window)]
                raw += part.encode("utf-8")
                at += len(part)
            if len(raw) <= self.window:
                yield array.array("I", self.merge(raw)).tobytes()
                return
            out, end = array.array("I"), 0
            for t in self.merge(raw[: self.window]):
                n = len(self.v.bytes_of[t])
                if end + n > self.window - self.v.lookahead:
                    break
                out.append(t)
                end += n
            yield out.tobytes()
            raw = raw[end:]

    def _pretoken(self, s: str) -> bytes:
        return b"".join(self._run(s, 0, len(s)))

    def _spaced(self, s: str) -> bytes:
        """A space and then ``s``; letters with at most one mark behind them need no pattern."""
        if s.isalpha():
            return self._pretoken(" " + s)
        if s[-1] in ".,;:!?" and s[:-1].isalpha():
            return self.spaced[s[:-1]] + self.word[s[-1]]
        return self._unit(" " + s)

    def _unit(self, s: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.pretoken.findall(s)))

    def simple(self, text: str) -> bool:
        """Whether each space or newline starts a unit that nothing later can reach."""
        return not (self.odd.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"))

    def _plain(self, text: str):
        """Text without added tokens."""
        if not self.simple(text):
            yield from self._by_pattern(text, 0, len(text))
            return
        # each space or newline starts a unit that nothing later can reach: stretches of whole units
        spaced, at = self.spaced.__getitem__, 0
        while at < len(text):
            end = len(text)
            if end - at > STRETCH:
                end = max(text.rfind(" ", at + 1, at + STRETCH), text.rfind("\n", at + 1, at + STRETCH))
                if end < 0:  # one long unit
                    ends = [x for x in (text.find(" ", at + 1), text.find("\n", at + 1)) if x > 0]
                    end = min(ends, default=len(text))
                    yield from self._by_pattern(text, at, end)
                    at = end
                    continue
            for i, line in enumerate(text[at:end].split("\n")):
                if i:
                    yield self.newline
                head, *rest = line.split(" ")
                if head:  # empty where a stretch starts with a separator
                    yield self.first[head]
                yield b"".join(map(spaced, rest))
            at = end

    def _by_pattern(self, text: str, at: int, stop: int):
        size = STRETCH
        while at < stop:
            limit, was = min(stop, at + size), at
            for m in self.pretoken.finditer(text, at, limit):
                if m.end() > limit - 2 and limit < stop:
                    break  # it could still grow, or turn into a contraction
                at = m.end()
                if at - m.start() > 64:
                    yield from self._run(text, m.start(), at)
                else:
                    yield self.word[m.group()]
            size = STRETCH if at > was else 2 * size

    def pieces(self, text: str):
        if not text:
            return
        for i, part in enumerate(self.added.split(text) if self.added and any(s in text for s in self.v.added) else (text,)):
            if i % 2:
                yield self.v.added[part].to_bytes(4, "little")
            elif part:
                yield from self._plain(part)

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.pieces(text or ""))


class LibraryEncoder(Encoder):
    """The same units, memo and windows; the tokenizers library merges the pre-tokens that fit in a window."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.letter = {b: c for c, b in byte_letters().items()}
        self.space = self.letter[ord(" ")]
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(257)]
        super().__init__(vocabulary(path), room=400_000)

    def _pretoken(self, s: str) -> bytes:
        if len(s) > 64:
            return super()._pretoken(s)
        tokens = self.model.tokenize(s.encode("utf-8").decode("latin-1").translate(self.letter))
        return self.packs[len(tokens)](*[t.id for t in tokens])

    def _spaced(self, s: str) -> bytes:
        if s.isascii() and s.isalpha() and len(s) <= 64:  # ASCII letters stand for themselves
            tokens = self.model.tokenize(self.space + s)
            return self.packs[len(tokens)](*[t.id for t in tokens])
        return super()._spaced(s)


    def encode_all(self, texts: list, most: int = 12_000_000) -> list:
        """The ids of each text as numpy arrays; simple texts are split together, and each of their distinct units is looked up once."""
        import numpy as np

        out: list = [None] * len(texts)
        some, size = [], 0
        for i, text in enumerate(texts):
            if not text or not self.simple(text) or any(s in text for s in self.v.added):
                out[i] = np.frombuffer(self.encode(text), "<u4")
                continue
            some.append(i)
            size += len(text)
            if size >= most:
                self._together(texts, some, out)
                some, size = [], 0
        if some:
            self._together(texts, some, out)
        return out

    def _together(self, texts, some, out) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # a unit behind a newline, or at the start of a text, begins with a newline; others followed a space
        units = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in some], pa.large_string()), " ")
        coded = units.flatten().dictionary_encode()
        known = self._units(coded.dictionary.to_pylist())
        n = np.fromiter(map(len, known), np.int32, len(known)) // 4
        flat, start = np.frombuffer(b"".join(known), "<u4"), np.cumsum(n, dtype=np.int32) - n
        at = coded.indices.to_numpy()
        each = n[at]
        end = np.cumsum(each, dtype=np.int32)  # ``most`` keeps this small
        place = np.arange(end[-1], dtype=np.int32)
        place += np.repeat(start[at] - end + each, each)
        ids = flat[place]
        stops = end[units.offsets.to_numpy()[1:] - 1]
        for i, a, b in zip(some, [0, *stops[:-1].tolist()], stops.tolist()):
            out[i] = ids[a + 1 : b]  # without the newline of the text's start

    def _units(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units of simple texts."""
        spaced, first, newline, word = self.spaced, self.first, self.newline, self.word
        tokenize, packs, space, room = self.model.tokenize, self.packs, self.space, self.spaced.room - len(self.spaced)
        out, get = [], spaced.get
        for u in units:
            if (found := get(u)) is not None:
                out.append(found)
                continue
            end = ""
            if u[-1] in ".,;:!?" and len(u) > 1:  # the mark behind a word is a pre-token of its own
                u, end = u[:-1], u[-1]
            if u.isalpha() and len(u) <= 64:
                if (found := get(u)) is None:
                    tokens = tokenize(space + (u if u.isascii() else u.encode("utf-8").decode("latin-1").translate(self.letter)))
                    found = packs[len(tokens)](*[t.id for t in tokens])
                    if room > 0:
                        spaced[u] = found
                        room -= 1
                out.append(found + word[end] if end else found)
            elif u[0] == "\n":
                out.append(newline + first[u[1:] + end])
            else:
                out.append(spaced[u + end])
        return out


class Decoder:
    """Ids to text, a block at a time: a byte-to-text state machine that holds at most one unfinished character."""

    def __init__(self, vocab: Vocabulary, block: int = 8192):
        self.table, self.block = vocab.bytes_of, block

    def stream(self):
        """A function from further ids to further text; with None it gives what is left at the end."""
        import numpy as np

        state = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.table.__getitem__

        def feed(ids: bytes | None) -> str:
            if ids is None:
                return state.decode(b"", True)
            return state.decode(b"".join(map(get, np.frombuffer(ids, "<u4").tolist())))

        return feed

    def pieces(self, ids: bytes):
        feed = self.stream()
        for i in range(0, len(ids), 4 * self.block):
            yield feed(ids[i : i + 4 * self.block])
        yield feed(None)

    def decode(self, ids: bytes) -> str:
        return "".join(self.pieces(ids))


_HELD: dict[str, Vocabulary] = {}
_ENCODERS: dict[str, Encoder] = {}
_LIBRARY_ENCODERS: dict[str, LibraryEncoder] = {}


def vocabulary(path: str) -> Vocabulary:
    """Of this process: vocabularies are installed files, read once by each worker."""
    if path not in _HELD:
        _HELD[path] = Vocabulary(path)
    return _HELD[path]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary(path))
    return _ENCODERS[path]


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _LIBRARY_ENCODERS:
        _LIBRARY_ENCODERS[path] = LibraryEncoder(path)
    return _LIBRARY_ENCODERS[path]


def encode_decode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids, and return the digests of both.

    One row for each input row (repeated rows stay), in the input's partitions: no shuffle.  Null and
    empty texts: no tokens, digests of nothing.  Other columns are not read.
    """

    def work(batches):
        import hashlib

        import pyarrow as pa

        enc = encoder(path)
        dec = Decoder(enc.v)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                h, g, count = hashlib.sha256(), hashlib.sha256(), 0
                feed, held, size = dec.stream(), [], 0
                for ids in enc.pieces(text.as_py() or ""):
                    held.append(ids)
                    size += len(ids)
                    if size >= STRETCH:
                        h.update(ids := b"".join(held))
                        g.update(feed(ids).encode("utf-8"))
                        count, held, size = count + size // 4, [], 0
                h.update(ids := b"".join(held))
                g.update((feed(ids) + feed(None)).encode("utf-8"))
                count += size // 4
                n.append(count)
                ids_sha.append(h.hexdigest())
                text_sha.append(g.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(work, schema)
