"""Byte-level BPE over batches of texts, and the byte table that turns ids back into bytes.

``PieceEncoder`` gives exactly what ``Tokenizer.encode`` gives for each whole
text.  It encodes every distinct stretch between safe cuts once per worker: a
byte-level pattern never joins a space that stands before a visible character
to what is left of it, so a text may be cut there, and likewise around a single
line feed between visible characters.  All encoding is the tokenizers library's.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already

_SPACE = re.compile(r" (?=\S)")
_HEAD = "\0"


def _even(text: str) -> bool:
    """All white space is single spaces and single line feeds between visible characters."""
    flat = text.replace("\n", " ")
    return flat.isprintable() and "  " not in flat and flat[0] != " " and flat[-1] != " "


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ByteTable:
    """Bytes of every id, flat, for vectorised decoding."""

    def __init__(self, vocab: dict[str, int]):
        back = {c: b for b, c in enumerate(byte_chars())}
        size = max(vocab.values(), default=-1) + 1
        parts = [b""] * size
        for token, i in vocab.items():
            parts[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1] if size else np.zeros(0, np.int64)
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.start[ids], self.length[ids]).tobytes()


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[start:start + length]`` of every pair."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


def token_texts(table: ByteTable, ids) -> list[str]:
    """Text per id; a character split over several ids belongs to the id that completes it."""
    import codecs

    read = codecs.getincrementaldecoder("utf-8")("replace")
    out = [read.decode(table.decode(np.array([i]))) for i in ids]
    tail = read.decode(b"", True)
    if tail and out:
        out[-1] += tail
    return out


def character_offsets(text: str, byte_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens that end at ``byte_ends`` of the text's UTF-8.

    A token that holds part of a character spans that character.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    starts = np.concatenate([[0], byte_ends[:-1]]).astype(np.int64)
    if not len(byte_ends):
        return starts[:0], starts[:0]
    return char[starts], char[byte_ends - 1] + 1


class PieceEncoder:
    """Whole-text byte-level BPE with a bounded memory of the stretches it has seen."""

    def __init__(self, tokenizer, most_characters: int = 24_000_000):
        self.tokenizer = tokenizer
        self.table = ByteTable(tokenizer.get_vocab(with_added_tokens=True))
        self.most = most_characters
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.characters = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the number of each text's ids."""
        if self.characters > self.most:
            self._forget()
        parts: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        whole: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if _HEAD in text:
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            own = text.replace("\n", " \n").split(" ") if _even(text) else _SPACE.split(text)
            own[0] = _HEAD + own[0]
            sizes[i] = len(own)
            parts += own
        self._learn(set(parts).difference(self.known))
        which = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        count = self.count[which].astype(np.int64)
        ids = gather(self.flat, self.at[which], count)
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
        lengths = np.diff(bounds)
        if not whole:
            return ids, lengths
        runs = [whole[i] if i in whole else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(runs), np.array([len(r) for r in runs], np.int64)

    def _learn(self, new: set[str]) -> None:
        heads = [p for p in new if p[0] == _HEAD]
        lines = [p for p in new if p[0] == "\n"]
        words = [p for p in new if p[0] not in "\n\0"]
        for group, join in ((words, " "), (lines, "")):
            for lo in range(0, len(group), 512):
                some = group[lo:lo + 512]
                texts = [join + p for p in some]
                (done,) = self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)
                ids = np.array(done.ids, np.uint32)
                ends = np.cumsum([len(t.encode()) for t in texts])
                cuts = np.cumsum(self.table.length[ids])
                at = np.searchsorted(cuts, ends)
                if len(cuts) and at[-1] < len(cuts) and np.array_equal(cuts[at], ends):
                    self._keep(some, ids, np.diff(np.concatenate([[0], at + 1])))
                else:
                    self._apart(some, texts)
        self._apart(heads, [p[1:] for p in heads])

    def _apart(self, keys: list[str], texts: list[str]) -> None:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        runs = [x.ids for x in done]
        self._keep(keys, np.array([i for r in runs for i in r], np.uint32), np.array([len(r) for r in runs], np.int64))

    def _keep(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(keys) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.at[first:first + len(keys)] = self.used + np.cumsum(counts) - counts
        self.count[first:first + len(keys)] = counts
        self.known.update(zip(keys, range(first, first + len(keys))))
        self.used += len(ids)
        self.characters += sum(map(len, keys)) + 40 * len(keys)


def from_file(path: str):
    """A tokenizers file; strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def from_ranks(path: str, pattern: str):
    """A tokenizers model that merges by the ranks of a ``.tiktoken`` file, each match of ``pattern`` apart.

    Any two neighbours whose joined bytes have a rank may merge, lowest rank
    first, so every way to split a token in two known tokens is a merge.
    """
    import base64

    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_chars()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    spell = {t: "".join(shown[b] for b in t) for t in ranks}
    merges = [
        (spell[t[:i]], spell[t[i:]])
        for t, _ in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
    ]
    t = Tokenizer(models.BPE({spell[k]: r for k, r in ranks.items()}, merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return t


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(kind: str, *args: str) -> PieceEncoder:
    """One encoder per worker process, whatever the number of tasks it runs."""
    key = (kind, *args)
    if key not in _encoders:
        make: Callable = {"file": from_file, "ranks": from_ranks}[kind]
        _encoders[key] = PieceEncoder(make(*args))
    return _encoders[key]


def forget() -> None:
    """Drop this worker's encoders with all they have kept; the next task that encodes makes its own."""
    _encoders.clear()
