"""Token counts by prefix dynamic programming.

For a byte-level BPE the encoding of a prefix ends in exactly one token t whose own start is again the end
of a prefix, with t and the token before it a pair that the merges leave as it is. So, walking one byte at a time,
count[i] = count[i - len(t)] + 1 for the only t that fits, and the table holds the exact count of every prefix.
Texts are first cut by the vocabulary's pre-tokenizer; a word's table is kept and used again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import input_columns

#: The byte-level pre-tokenizer's pattern, with Unicode's white space written out.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Strings whose counts a worker keeps.
MEMO_WORDS, MEMO_CHUNKS = 1_000_000, 1_500_000
#: Bytes of text whose new words are learnt together.
GROUP_BYTES = 4_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Counts(dict):
    """Counts by string, found on first use; starts anew when it is full, which costs time only."""

    def __init__(self, find, most: int):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, s: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[s] = self.find(s)
        return n


class PrefixTable:
    """Exact token counts of all prefixes of texts, for one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        raw = lambda s: bytes(of[c] for c in s)
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.specials}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.splits = {a + b: (a, b, r) for (a, b), r in self.ranks.items()}
        self.spines: dict[int, tuple[list, list]] = {}
        self.each = regex.compile(PATTERN).finditer
        self.find = find = regex.compile(PATTERN).findall
        self.counts = counts = _Counts(lambda w: self.word(w.encode())[-1], MEMO_WORDS)
        odd = lambda c: not c or c[0].isspace() or c[-1].isspace()  # noqa: E731  runs of white space are cut by what follows them
        self.chunks = _Counts(lambda c: -(1 << 60) if odd(c) else sum(counts[w] for w in find(" " + c)), MEMO_CHUNKS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE of a short byte string; only pairs of tokens are put through it."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            pair = (parts[at], parts[at + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _spine(self, t: int) -> tuple[list, list]:
        """Right and left edge of a token while it is built: (symbol, rank of the merge that ends it)."""
        if t not in self.spines:
            both = []
            for side in (1, 0):
                sym, end, out = self.bytes_of[t], 1 << 60, []
                while True:
                    out.append((sym, end))
                    if sym not in self.splits:
                        break
                    *parts, end = self.splits[sym]
                    sym = parts[side]
                both.append(out)
            self.spines[t] = (both[0], both[1])
        return self.spines[t]

    def _pair(self, a: int, b: int) -> bool:
        """Whether no merge ever joins the right edge of a with the left edge of b. At equal ranks the leftmost merge comes first."""
        if (known := self.fits.get((a, b))) is None:
            rank, known = self.ranks.get, True
            for x, x_end in self._spine(a)[0]:
                for y, y_end in self._spine(b)[1]:
                    r = rank((x, y))
                    if r is not None and r < x_end and r <= y_end:
                        known = False
                        break
                if not known:
                    break
            self.fits[a, b] = known
        return known

    def _alone(self, a: int) -> bool:
        if (known := self.whole.get(a)) is None:
            known = self.whole[a] = len(self.merge(self.bytes_of[a])) == 1
        return known

    def word(self, word: bytes) -> list[int]:
        """count[i] for each prefix word[:i] of one pre-token."""
        count, last = [0] * (len(word) + 1), [-1] * (len(word) + 1)
        self._extend(word, 1, count, last)
        return count

    def _extend(self, word: bytes, start: int, count: list[int], last: list[int]) -> None:
        """Fills count and last from prefix length start on; what lies before holds already."""
        ids, fits, longest = self.ids.get, self.fits.get, self.longest
        for i in range(start, len(word) + 1):
            for at in range(i - 1, max(0, i - longest) - 1, -1):
                t = ids(word[at:i])
                if t is not None:
                    ok = fits((last[at], t)) if at else self._alone(t)
                    if self._pair(last[at], t) if ok is None else ok:
                        count[i], last[i] = count[at] + 1, t
                        break

    def learn(self, texts: list[str]) -> None:
        """Fills the kept counts for all new strings of these texts at once: in sorted order a word shares the table of
        the prefix that it has in common with the one before."""
        chunks, counts, find = self.chunks, self.counts, self.find
        if len(chunks) > MEMO_CHUNKS // 2:
            chunks.clear()
        new = set().union(*(t.split(" ") for t in texts))
        parts = {c: (" " + c,) if c.isalpha() else find(" " + c) for c in new if c not in chunks and 0 < len(c) < 64}
        words = {w.encode(): w for ws in parts.values() for w in ws if w not in counts}
        if len(counts) + len(words) > MEMO_WORDS:
            counts.clear()
            words = {w.encode(): w for ws in parts.values() for w in ws}
        before, count, last = b"", [0] * 257, [-1] * 257
        for w in sorted(words):
            k = 0
            for x, y in zip(w, before):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                k += 1
            self._extend(w, k + 1, count, last)
            counts[words[w]] = count[len(w)]
            before = w
        for c, ws in parts.items():
            if not (c[0].isspace() or c[-1].isspace()):
                chunks[c] = sum(map(counts.__getitem__, ws))

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pre-tokens in order, found as they are asked for; True for a special token's string, which the library counts as
        one."""
        for k, part in enumerate(self.cut.split(text) if self.cut and any(s in text for s in self.specials) else [text]):
            if k % 2:
                yield part, True
            else:
                yield from ((m.group(), False) for m in self.each(part))

    def total(self, text: str) -> int:
        if self.cut is not None and any(s in text for s in self.specials):
            return sum(1 if special else self.counts[w] for w, special in self.pieces(text))
        first, *rest = text.split(" ")  # single spaces: each belongs to what follows it, and no piece crosses one
        n = sum(map(self.chunks.__getitem__, rest))
        if n < 0 or first[-1:].isspace():
            return sum(map(self.counts.__getitem__, self.find(text)))
        return n + sum(map(self.counts.__getitem__, self.find(first)))

    def prefixes(self, text: str) -> np.ndarray:
        """count of text[:i], exact as if that prefix had been encoded alone, for i = 0..len(text) code points."""
        out, base, at = np.zeros(len(text) + 1, np.int32), 0, 0
        plain = lambda s: sum(self.counts[x] for x in self.find(s))
        run, run_base = "", 0  # white space just before, which a prefix may cut another way
        for w, special in self.pieces(text):
            if special:
                for i in range(1, len(w)):
                    out[at + i] = run_base + plain(run + w[:i])
                out[at + len(w)] = base + 1
            elif w.isspace():
                for i in range(1, len(w) + 1):
                    out[at + i] = run_base + plain(run + w[:i])
                out[at + len(w)] = run_base + plain(run + w)
            elif w[0] == "'":
                for i in range(1, len(w) + 1):
                    out[at + i] = base + plain(w[:i])
            else:
                table = np.asarray(self.word(w.encode()), np.int32)
                ends = np.arange(1, len(w) + 1) if w.isascii() else np.cumsum([len(c.encode()) for c in w])
                out[at + 1 : at + 1 + len(w)] = base + table[ends]
                if w[0] == " ":
                    out[at + 1] = run_base + plain(run + " ")
            at += len(w)
            if special:
                base += 1
            else:
                base += self.counts[w]
            if not special and w.isspace():
                run += w
            else:
                run, run_base = "", base
        return out

    def fit(self, text: str, limit: int) -> int:
        """Code points of the longest prefix that takes at most limit tokens, read off the tables, not re-encoded."""
        base, at, best, run, run_base = 0, 0, 0, "", 0
        for w, special in self.pieces(text):
            n = 1 if special else self.counts[w]
            if base + n > limit or run:
                ok = np.flatnonzero(self.prefixes(run + w) + run_base <= limit)
                best = max(best, at - len(run) + int(ok[-1]) if len(ok) else 0)
            elif base + n <= limit:
                best = at + len(w)
            base, at = base + n, at + len(w)
            if base > limit and not w.isspace():
                break
            run, run_base = (run + w, run_base) if not special and w.isspace() else ("", base)
        return best


_open: dict[str, PrefixTable] = {}


def opened(path: str) -> PrefixTable:
    """One table per worker and file."""
    if path not in _open:
        _open[path] = PrefixTable(path)
    return _open[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), fit_chars (code points of the longest prefix within limit).

    A null text is empty: 0 tokens, not over the limit. Repeated rows and null ids give a row each. Any other column is
    left out. tokenizer: path of a byte-level BPE file, on every executor. One pass, no shuffle; a worker holds one text
    at a time besides its Arrow batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = opened(tokenizer)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            n, fit, size = [], [], [x.as_buffer().size for x in texts]
            at = 0
            while at < len(ids):  # some MB at once
                to, mass = at + 1, size[at]
                while to < len(ids) and mass + size[to] <= GROUP_BYTES:
                    mass += size[to]
                    to += 1
                group = texts.slice(at, to - at).to_pylist()
                t.learn(group)
                for s in group:
                    n.append(t.total(s))
                    fit.append(len(s) if n[-1] <= limit else t.fit(s, limit))
                at = to
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return input_columns(docs, text, key).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, counts array<int>: the whole table, counts[i] = tokens of the first i code points. Null text: [0]."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = opened(tokenizer)
        for b in batches:
            for i, x in zip(b.column("doc_id"), b.column("text"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([t.prefixes(x.as_py())], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return input_columns(docs, text, key).mapInArrow(fill, "doc_id long, counts array<int>")
