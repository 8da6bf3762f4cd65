"""Byte-pair encoding and decoding by backtracking over Aho-Corasick longest matches.

Encoding a piece looks for the chain of tokens that the merge rules would leave. At each position the
automaton gives the longest vocabulary entry that starts there; a token may follow its predecessor only if
the pair-compatibility table says that the merge rules would never have crossed their border. If it may
not, the next shorter prefix token is tried, and when none is left the chain backtracks by one token. A bit
for each byte position marks ends already found hopeless, so every position is given up at most once and the
whole is linear in the piece. Decoding copies from one byte string through a table of token offsets.

Defined results: a null or empty text has no ids and decodes to the empty text. Rows with equal texts get
equal ids. Lone surrogates cannot occur in Spark strings. Added tokens (such as ``<|endoftext|>``) inside a
text are matched first, as the public library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from topicloom.llm.common import bound_batches

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes (about) that each generation of a worker's memo of stretches holds, and entries of the memo of pairs.
MEMO_BYTES, MEMO_PAIRS = 36 << 20, 200_000
#: Characters of a text that are encoded at a time, so a very long text needs little more than itself.
BLOCK = 1 << 18
_BORDER = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: A space that belongs to a run of white space in a way that splitting at it would change.
_RUN = re.compile(r"\s (?=\s|\Z)")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Backtracker:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.token: list[bytes] = [b""] * self.size
        for b, i in vocab.items():
            self.token[i] = b
        for s, i in self.added.items():
            self.token[i] = s.encode()
        # merge rules: rank of each pair, and how each merged token came about
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order = [0] * self.size
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            x, y = vocab[raw(a)], vocab[raw(b)]
            z = vocab[raw(a) + raw(b)]
            self.rank[x << 32 | y] = n
            self.parts.setdefault(z, (x, y))
            self.order[z] = n + 1
        self.trie = ahocorasick.Automaton()
        for b, i in vocab.items():
            self.trie.add_word(b.decode("latin-1"), i)
        self.trie.make_automaton()
        self.ids = vocab
        self.shorter = self._prefixes()
        self.length = [len(t) for t in self.token]
        self.digits = [str(i) for i in range(self.size)]
        #: Tokens that the merge rules build from their own bytes: a piece that is one of these is just it.
        self.whole = {b: i for b, i in vocab.items() if self.order[i] or len(b) == 1}
        # decoding: one byte string and the offset of each token in it
        self.bytes = b"".join(self.token)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in self.token])]).astype(np.int64)
        self.pairs: dict[int, bool] = {}
        self.memo = _Memo(self._chunk)
        self.split = regex.compile(PIECES)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _prefixes(self) -> list[int]:
        """For each token the longest other token that it starts with, or -1."""
        out = [-1] * self.size
        for b, i in self.ids.items():
            for n in range(len(b) - 1, 0, -1):
                if (j := self.ids.get(b[:n])) is not None:
                    out[i] = j
                    break
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge rules leave a and b side by side when they meet only each other."""
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self._compatible(a, b)
        return ok

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 60
        left, right = a, b
        while True:
            n = self.rank.get(left << 32 | right)
            if n is not None and n + 1 < limit:
                return False
            # undo the later of the two outer merges and look at the tokens that then touch
            if self.order[left] > self.order[right]:
                limit = self.order[left]
                left = self.parts[left][1]
            elif self.order[right]:
                limit = self.order[right] + 1  # an equal merge further left comes first
                right = self.parts[right][0]
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """Token ids of one pre-token."""
        data = text.encode("utf-8")
        if (whole := self.whole.get(data)) is not None:
            return [whole]
        size, shorter, pairs = self.length, self.shorter, self.pairs
        longest = [-1] * len(data)
        for end, i in self.trie.iter(data.decode("latin-1")):  # ends ascend, so a later match is longer
            longest[end + 1 - size[i]] = i
        n, at, token, last = len(data), 0, longest[0], -1
        shut: set[int] = set()  # ends that no chain can go on from
        out: list[int] = []
        while True:
            while token >= 0:
                if at + size[token] not in shut:
                    if last < 0:
                        break
                    if (ok := pairs.get(last << 32 | token)) is None:
                        ok = self.compatible(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == n:
                    return out
                last, token = token, longest[at]
            else:
                shut.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = shorter[token]

    def _chunk(self, text: str) -> bytes:
        """Packed ids of a stretch that ends at a sure border."""
        if text < "\u0250" and (text[1:] if text[0] == " " else text).isalpha() and max(text) < "\u0250":
            return array("I", self.piece(text)).tobytes()  # letters only: one piece
        parts = self.split.findall(text)
        if len(parts) == 1:
            return array("I", self.piece(parts[0])).tobytes()
        return b"".join(map(self.memo.__getitem__, parts))

    def plain(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without added tokens, block by block; a block ends at a sure border."""
        at, n = 0, len(text)
        while at < n:
            cut = _BORDER.search(text, at + BLOCK) if n - at > BLOCK else None
            end = cut.start() if cut else n
            part = text[at:end] if at or end < n else text
            if _RUN.search(part):
                parts: list[str] = self.split.findall(part)
            else:
                first, *rest = part.split(" ")
                parts = [first] if first else []
                parts += [" " + r for r in rest]
            yield b"".join(map(self.memo.__getitem__, parts))
            at = end

    def packed(self, text: str | None) -> Iterator[bytes]:
        """Packed ids (32 bits each) of a text, in blocks."""
        text = text or ""
        if self.specials is None or not any(a in text for a in self.added):
            yield from self.plain(text)
            return
        for s in self.specials.split(text):
            if s in self.added:
                yield array("I", [self.added[s]]).tobytes()
            elif s:
                yield from self.plain(s)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.packed(text)), dtype=np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Gather the tokens' bytes through the offset table, in blocks that bound memory."""
        source, out = np.frombuffer(self.bytes, dtype=np.uint8), []
        for lo in range(0, len(ids), 1 << 16):
            part = ids[lo : lo + (1 << 16)].astype(np.int64)
            start, length = self.offset[part], self.offset[part + 1] - self.offset[part]
            where = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            out.append(source[where].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


class _Memo(dict):
    """Packed ids by stretch. Two generations of bounded size: when the young one is full it becomes the old one,
    and what is met again moves up, so frequent stretches stay and memory is bounded by bytes."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old, self.size = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if self.size > MEMO_BYTES:
                self.old, self.size = dict(self), 0
                self.clear()
            self[key] = got
            self.size += 190 + len(key) + len(got)
        return got


@lru_cache(maxsize=1)
def load(path: str) -> Backtracker:
    """One encoder for each worker process and vocabulary."""
    return Backtracker(path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and ``decoded`` string of every row; a narrow map, no shuffle."""
    path = path or default_vocabulary()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = load(path)
        for batch in batches:
            ids = [b.encode(t.as_py()) for t in batch.column(len(keep))]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), lists, pa.array([b.decode(i) for i in ids])], names=[*keep, "ids", "decoded"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{fields}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and whether decoding gave the text back (``exact``).

    The ids' digest is fed stretch by stretch, so a very long text needs little more than itself.
    """
    path = path or default_vocabulary()
    bound_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = load(path)
        for batch in batches:
            count, one, two, same = [], [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
                for block in b.packed(t):
                    own = np.frombuffer(block, dtype=np.uint32)
                    ids.update(("," if n and len(own) else "").encode() + ",".join(map(b.digits.__getitem__, own.tolist())).encode())
                    back.update(b.decode(own).encode())
                    n += len(own)
                count.append(n)
                one.append(ids.hexdigest())
                two.append(back.hexdigest())
                same.append(back.digest() == hashlib.sha256(t.encode()).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(same, pa.bool_())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
