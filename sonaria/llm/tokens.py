"""Token ids of many texts at once, exactly as the tokenizer gives them.

A byte-level BPE splits a text into pieces by a pattern and merges inside each
piece only, so equal pieces have equal ids. Piece bounds are found with array
operations, every distinct piece goes through the tokenizer once, and the ids
are gathered. The bounds are computed here for texts whose characters are all
below U+0280; a text with any other character goes through the tokenizer whole.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from sonaria.llm.arrays import BYTE_VALUES, Rolling

#: The pattern whose pieces this module knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = range(4)
LIMIT = 0x280


def _kind(c: int) -> int:
    if c in (0x20, 0x85, 0xA0) or 9 <= c <= 13:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)


KINDS = np.array([_kind(c) for c in range(LIMIT)], np.uint8)


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin; all characters must be below U+0280."""
    n = len(buf)
    wide = buf.astype(np.int32)
    nxt = np.append(wide[1:], 0)
    lead = buf >= 0xC0
    tail = (buf & 0xC0) == 0x80
    kind = KINDS[np.where(lead, (wide & 31) << 6 | nxt & 63, np.where(tail, 0, wide))]
    at = np.flatnonzero(tail)
    kind[at] = kind[at - 1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge = edge[:n] & True
    before = np.concatenate([[255], kind[:-1]]).astype(np.uint8)
    before[edge] = 255
    start = (kind != before) & ~tail
    space = kind == SPACE
    # A run of spaces that something follows gives up its last character: a blank to what follows, another alone.
    last = space & np.append(~space[1:], True) & ~np.append(edge[1:], True)
    first_of_last = np.flatnonzero(last & ~tail)
    start[first_of_last] = True
    two = np.flatnonzero(last & tail)
    start[two - 1] = True
    blank = first_of_last[buf[first_of_last] == 0x20]
    start[blank + 1] = False
    # 's 't 'm 'd 're 've 'll where a piece begins with the apostrophe.
    q = np.flatnonzero((buf == 0x27) & start)
    if len(q):
        padded = np.concatenate([buf, [0, 0, 0]])
        text_end = offsets[np.searchsorted(offsets, q, "right")]
        a, b = padded[q + 1], padded[q + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (q + 1 < text_end)
        pair = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (q + 2 < text_end)
        size = np.where(one, 2, np.where(pair, 3, 0))
        hit = size > 0
        start[q[hit] + 1] = False
        after = q[hit] + size[hit]
        inner = after < text_end[hit]
        after = after[inner]
        start[after[(kind[after] == LETTER)]] = True
    return np.flatnonzero(start)


class Encoder:
    """ids(buf, offsets): (all ids, where each text's ids begin).

    The ids of pieces already met are kept, sorted by the pieces' hashes, up to KNOWN pieces. What was met last is in a
    short table of its own, which joins the long one when it has LATEST rows, so that the long one is seldom moved.
    """

    KNOWN, LATEST = 1 << 20, 1 << 16

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.forget()

    @classmethod
    @functools.cache
    def at(cls, path: str) -> Encoder:
        """One for each worker process."""
        return cls(path)

    def forget(self) -> None:
        self.tables = [self._empty(), self._empty()]
        self.known = np.zeros(0, np.uint32)
        self.added: list[np.ndarray] = []
        self.end = self.filled = 0

    @staticmethod
    def _empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate(x)[order] for x in zip(a, b, strict=True))

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each is known, where its ids begin, how many they are)."""
        found, begin, size = np.zeros(len(names), bool), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for known, b, n in self.tables:
            if len(known):
                k = np.minimum(np.searchsorted(known, names), len(known) - 1)
                hit = known[k] == names
                found |= hit
                begin[hit], size[hit] = b[k[hit]], n[k[hit]]
        return found, begin, size

    def learn(self, names: np.ndarray, pieces: list[bytes]) -> None:
        """Pieces in lines meet the tokenizer in one call: a line's end is a piece and a token of its own."""
        apart = [k for k, p in enumerate(pieces) if p.isspace() or b"\n" in p or b"\xc2\x85" in p or b"\xc2\xa0" in p]
        alone = dict(zip(apart, self.whole([pieces[k].decode() for k in apart]), strict=True))
        inline = [p for k, p in enumerate(pieces) if k not in alone]
        ids = self.whole([b"\n".join([*inline, b""]).decode()])[0] if inline else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(inline):
            raise ValueError("this tokenizer doesn't keep lines apart")
        size = np.empty(len(pieces), np.int64)
        begin = np.empty(len(pieces), np.int64)
        mask = np.ones(len(pieces), bool)
        mask[apart] = False
        first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        base = self.end
        begin[mask], size[mask] = base + first, ends - first
        at = base + len(ids)
        for k, x in alone.items():
            begin[k], size[k] = at, len(x)
            at += len(x)
        self.end = at
        self.added += [ids, *alone.values()]
        latest = self._merged(self.tables[1], (names, begin.astype(np.int32), size.astype(np.int32)))
        if len(latest[0]) >= self.LATEST:
            self.tables = [self._merged(self.tables[0], latest), self._empty()]
        else:
            self.tables[1] = latest

    def all_known(self) -> np.ndarray:
        """The ids of all known pieces."""
        if self.added:
            if self.end > len(self.known):
                room = np.empty(self.end + (1 << 18), np.uint32)
                room[: self.filled] = self.known[: self.filled]
                self.known = room
            for x in self.added:
                self.known[self.filled : self.filled + len(x)] = x
                self.filled += len(x)
            self.added = []
        return self.known

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        far = np.concatenate([[0], np.cumsum(buf >= 0xC0 + (LIMIT >> 6))])[offsets]
        plain = np.diff(far) == 0
        if plain.all():
            return self._plain(buf, offsets)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
        rest = np.flatnonzero(~plain)
        for k, x in zip(rest, self.whole([buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in rest]), strict=True):
            out[k] = x
        some = np.flatnonzero(plain)
        if len(some):
            b = np.concatenate([buf[offsets[i] : offsets[i + 1]] for i in some])
            ids, of = self._plain(b, np.concatenate([[0], np.cumsum(np.diff(offsets)[some])]))
            for k, i in enumerate(some):
                out[i] = ids[of[k] : of[k + 1]]
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)

    def _plain(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start = piece_starts(buf, offsets)
        end = np.append(start[1:], len(buf))
        name = Rolling(BYTE_VALUES[0][buf], 0).span(start, end)
        _, first, number = np.unique(name, return_index=True, return_inverse=True)
        if len(self.tables[0][0]) > self.KNOWN:
            self.forget()
        distinct_names = name[first]
        found, at, size = self.find(distinct_names)
        new = np.flatnonzero(~found)
        if len(new):
            data = buf.tobytes()
            self.learn(distinct_names[new], [data[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            _, at, size = self.find(distinct_names)
        many = size[number]
        upto = np.concatenate([[0], np.cumsum(many)])
        gather = np.repeat(at[number] - upto[:-1], many) + np.arange(upto[-1])
        return self.all_known()[gather], upto[np.searchsorted(start, offsets)]
