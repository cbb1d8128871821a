"""Exact encoding with a public tokenizer, remembered per white-space piece.

A tokenizer whose pre-tokenizer never joins characters across a space gives the
same ids for a text as for its pieces one after the other.  Words repeat, so a
worker encodes each distinct piece once and looks the rest up: the pieces' hashes
come from prefix sums over a whole batch, a table gives each piece's run of ids,
and the runs are gathered at once.  Texts where white space touches white space, or
that hold the string of an added token, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from tokentally.llm.shared import BYTE_CODES, mix64, per_process, powers

_TOUCHING = re.compile(r"\s\s")
#: A letter run and one of these are always pre-tokens of their own.
_MARKS = frozenset(".,;:!?")
_END = 0xFF  # a byte that no UTF-8 text holds


class Runs:
    """Runs of ids by 64-bit key: open addressing, grown and probed by whole arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.bits, self.n = 16, 0
        self.keys, self.rows = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)
        self.own = np.zeros(1 << 15, np.uint64)  # each row's key
        self.start, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.ids, self.used = np.zeros(1 << 17, np.uint32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        row = self.rows[at]
        left = np.flatnonzero((row >= 0) & (self.keys[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.rows) - 1)
            r = self.rows[at]
            row[left] = r
            on = (r >= 0) & (self.keys[at] != keys[left])
            left, at = left[on], at[on]
        return row

    def _place(self, rows: np.ndarray) -> None:
        left, at = rows, self._slot(self.own[rows])
        while len(left):
            free = self.rows[at] < 0
            self.rows[at[free]] = left[free]
            won = free & (self.rows[at] == left)
            self.keys[at[won]] = self.own[left[won]]
            left, at = left[~won], (at[~won] + 1) & (len(self.rows) - 1)

    def add(self, keys: np.ndarray, runs: list[bytes]) -> None:
        """New distinct keys and their runs (unsigned 32-bit bytes)."""
        k, flat = len(keys), np.frombuffer(b"".join(runs), "<u4")
        while len(self.own) < self.n + k:
            self.own, self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.own, self.start, self.size))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        sizes = np.fromiter(map(len, runs), np.int64, k) // 4
        new = slice(self.n, self.n + k)
        self.own[new], self.size[new], self.start[new] = keys, sizes, self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + k, self.used + len(flat)
        if 2 * self.n > len(self.rows):
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._place(np.arange(self.n, dtype=np.int32))
        else:
            self._place(np.arange(self.n - k, self.n, dtype=np.int32))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' runs end to end, and where each ends."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(self.start[rows] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], ends


class PieceEncoder:
    """ids as little-endian unsigned 32-bit bytes; ``limit`` bounds the pieces that are remembered."""

    def __init__(self, path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.kind = "space-led"
        elif set(kinds) <= {"NFC", "Replace", "Lowercase"} and "Replace" in kinds and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed":
            self.kind = "space-free"
        else:
            self.kind = "whole"
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        edge = (lambda t: t.startswith(("Ġ", "Ċ"))) if self.kind == "space-led" else (lambda t: t.endswith("</w>"))
        self.edge = np.zeros(self.size, dtype=bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if edge(t)]] = True
        self.known = Runs()

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], lead: str, edges: np.ndarray | None = None) -> list[bytes]:
        """As _alone of ``lead`` plus each piece, in one call: the ids tell where a piece begins or ends.

        A piece led by a space (or a newline) begins with the only id whose token
        starts with that mark.  Without a lead, ``edges`` tells how many ids of
        each piece end a word.  Should the counts differ, each piece is encoded alone.
        """
        if not pieces:
            return []
        ids = np.asarray(self.tokenizer.encode_batch_fast([lead + (lead or " ").join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(self.edge[ids])
        if lead and len(at) == len(pieces):
            ends = np.append(at[1:], len(ids))
        elif not lead and len(at) == edges.sum() and at[-1] == len(ids) - 1:
            ends = at[np.cumsum(edges) - 1] + 1
        else:
            return self._alone([lead + p for p in pieces])
        raw, start, out = ids.tobytes(), 0, []
        for end in (4 * ends).tolist():
            out.append(raw[start:end])
            start = end
        return out

    def _learn(self, pieces: list[str], kinds: np.ndarray) -> list[bytes]:
        """Runs of new pieces; kinds: 0 led by a space, 1 first of a text, 2 beginning with a newline."""
        out: list[bytes | None] = [None] * len(pieces)

        def put(at: list[int], runs: list[bytes]) -> None:
            for i, r in zip(at, runs, strict=True):
                out[i] = r

        for a in range(0, len(pieces), 20_000):
            some = range(a, min(a + 20_000, len(pieces)))
            if self.kind == "space-led":
                led = [i for i in some if kinds[i] == 0 and pieces[i]]
                put(led, self._joined([pieces[i] for i in led], " "))
                lines = [i for i in some if kinds[i] == 2 and len(pieces[i]) > 1]
                put(lines, self._joined([pieces[i][1:] for i in lines], "\n"))
            else:
                count = {i: 1 if pieces[i].isalpha() else 2 if pieces[i][-1:] in _MARKS and pieces[i][:-1].isalpha() else 0 for i in some}
                plain = [i for i in some if count[i]]
                put(plain, self._joined([pieces[i] for i in plain], "", np.array([count[i] for i in plain])))
            rest = [i for i in some if out[i] is None]
            put(rest, self._alone([" " + pieces[i] if self.kind == "space-led" and kinds[i] == 0 else pieces[i] for i in rest]))
        return out

    def _part(self, raw: list[bytes]) -> list[bytes]:
        """The ids of some texts, all safe to cut at spaces."""
        joined = b"\xff".join(raw) + b"\xff"
        b = np.frombuffer(joined, dtype=np.uint8)
        cut = np.flatnonzero((b == 32) | (b == 10) | (b == _END))
        what = b[cut]
        led = self.kind == "space-led"
        first = np.concatenate([[0], cut[:-1] + 1])
        kinds = np.zeros(len(cut), dtype=np.int8)
        if led:  # a newline belongs to the piece that it begins
            kinds[1:][what[:-1] == 10] = 2
            kinds[1:][what[:-1] == _END] = 1
            kinds[0] = 1
            first -= kinds == 2
        up, down = powers(len(b) + 1)
        with np.errstate(over="ignore"):
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[b] * up[: len(b)], dtype=np.uint64)])
            keys = mix64((prefix[cut] - prefix[first]) * down[first] + (cut - first).astype(np.uint64) + ((kinds == 1).astype(np.uint64) << np.uint64(40)), 6)
        rows = self.known.find(keys)
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            new, at = np.unique(keys[miss], return_index=True)
            at = miss[at]
            self.known.add(new, self._learn([joined[i:j].decode("utf-8", "surrogatepass") for i, j in zip(first[at].tolist(), cut[at].tolist(), strict=True)], kinds[at]))
            rows[miss] = self.known.find(keys[miss])
        ids, ends = self.known.gather(rows)
        data, start, out = ids.tobytes(), 0, []
        for end in (4 * ends[what == _END]).tolist():
            out.append(data[start:end])
            start = end
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text counts as empty."""
        if self.known.n > self.limit:
            self.known.clear()
        out: list[bytes] = [b""] * len(texts)
        some: list[int] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> None:
            for i, data in zip(some, self._part(raw) if raw else [], strict=True):
                out[i] = data
            some.clear(), raw.clear()

        for i, t in enumerate(texts):
            t = t or ""
            if self.kind == "whole" or _TOUCHING.search(t) or any(a in t for a in self.added):
                out[i] = self._alone([t])[0]
                continue
            some.append(i)
            raw.append(t.encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            if size > 1_000_000:  # parts of about a megabyte bound the memory
                flush()
                size = 0
        flush()
        return out


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for the vocabulary file at ``path``."""
    return per_process(("encoder", path), lambda: PieceEncoder(path))
