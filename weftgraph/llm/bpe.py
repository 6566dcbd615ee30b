"""Token ids exactly as the ``tokenizers`` library gives them, with far less text sent through it.

Two vocabularies are known by the shape of their file: byte-level BPE with a leading space (``byte``) and BPE with
word ends over lower-cased text (``word``). A text is cut at single spaces, where neither kind can have a token. A
bounded cache keeps the ids of pieces. A new piece that is a word, or a word and a mark, is one pre-token, or two, which
go to the library's merging model; other new pieces go to the library joined in one text, whose ids are told apart by
their lengths in bytes. A text with characters outside ``SAFE``, with a special token's string, or with a space beside
another blank goes to the library whole. Pieces are split, looked up and put together as arrays, not one by one.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workspace import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker keeps; a full cache starts anew. Pieces that the library gets as one text.
PIECES, JOINED = 600_000, 256
#: Pieces whose ids are copied at a time.
COPIED = 1 << 16
#: Bytes of texts that are encoded together, so that few distinct pieces are looked up twice; their pieces, as arrays,
#: take tens of times that.
TOGETHER = 1 << 20
#: Characters that both kinds treat alike on their own and beside others; a text with others is not cut.
SAFE = r"\t-\r -~\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}"
_ODD = {"word": rf"[^{SAFE}]|<\|", "byte": rf"[^{SAFE}]|<\||^ | $| [\t-\r ]|[\t-\r] "}
#: Line feeds that may be cut at are alone, inside a text.
_LINES = r"\n[\t-\r]|[\t-\r]\n|^\n|\n$"
#: Marks of a text's first piece and of a piece behind a line feed; none of them is safe, so no text has them.
_FIRST, _LINE = "\1", "\2"
_WORD = rf"^{_LINE}?\p{{L}}+[,.]?$"


def _byte_symbols() -> dict[int, int]:
    """Byte -> code point of the printable symbol that stands for it in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def _scalar(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


class _Table:
    """Known pieces, their token counts and, if kept, where their ids are in one growing array."""

    def __init__(self, with_ids: bool, pieces: list[str] = (), sizes: list[int] = ()):
        self.pieces, self.sizes = pa.array(pieces, pa.large_string()), np.array(sizes, np.int64)
        self.starts = np.zeros(len(self.sizes), np.int64) if with_ids else None
        self.ids = np.zeros(0, np.uint32)

    def add(self, pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        if self.starts is not None:
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.ids = np.append(self.ids, ids)
        self.pieces, self.sizes = pa.concat_arrays([self.pieces, pieces]), np.append(self.sizes, sizes)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces, -1 for those it lacks. Arrow hashes the new pieces, which are fewer than those known."""
        numbers = np.full(len(pieces), -1, np.int64)
        at = pc.fill_null(pc.index_in(self.pieces, value_set=pieces), -1).to_numpy()
        known = np.flatnonzero(at >= 0)
        numbers[at[known]] = known
        return numbers

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the ends, from 0 on, ids) of pieces by number, one after the other."""
        sizes = self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(ends[-1], np.uint32)
        for a in range(0, len(which), COPIED):
            b = min(a + COPIED, len(which))
            ids[ends[a] : ends[b]] = self.ids[np.repeat(self.starts[which[a:b]] - ends[a:b], sizes[a:b]) + np.arange(ends[a], ends[b])]
        return ends, ids


class Encoder:
    """Ids of one vocabulary file, given as its JSON text."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.loads(text)["model"]
        end = model.get("end_of_word_suffix") or ""
        self.kind = "word" if end else "byte"
        self.bytes = np.zeros(max(model["vocab"].values()) + 1, np.int64)  # one symbol of a token is one byte
        for token, i in model["vocab"].items():
            self.bytes[i] = len(token) - (len(end) if end and token.endswith(end) else 0)
        self.symbols = {b: chr(c) for b, c in _byte_symbols().items()}
        self.marks = {m: self._merged(self.symbols[ord(m)])[0] for m in "\n,."}
        self.seed: dict[str, int] = {}
        self.words = _Table(True)
        self.tables = {counts: _Table(not counts) for counts in (True, False)}

    # -- pieces

    def _merged(self, symbols: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(symbols)]

    def _words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, ids) of pieces that are letters alone, or with a line feed before or a mark behind them."""
        line, mark = (pc.match_substring_regex(pieces, p).to_numpy(zero_copy_only=False) for p in (rf"^{_LINE}", "[,.]$"))
        stems = pc.utf8_trim(pieces, _LINE + ",.")
        if self.kind == "word":
            stems = pc.utf8_lower(stems)
        else:
            stems = pc.binary_join_element_wise(pc.if_else(pa.array(line), _scalar(""), _scalar(self.symbols[32])), stems, _scalar(""))
        coded = stems.dictionary_encode()
        if len(self.words.pieces) + len(coded.dictionary) > PIECES:
            self.words = _Table(True)
        numbers = self.words.find(coded.dictionary)
        missing = numbers < 0
        new = coded.dictionary.filter(pa.array(missing))
        lead, symbols = self.symbols[32], self.symbols
        found = []
        for w in new.to_numpy(zero_copy_only=False).tolist():
            body = w[1:] if w[0] == lead else w
            found.append(self._merged(w if body.isascii() else w[: len(w) - len(body)] + "".join(map(symbols.__getitem__, body.encode()))))
        known = len(self.words.pieces)
        self.words.add(new, np.fromiter(map(len, found), np.int64, len(found)), np.array([i for own in found for i in own], np.uint32))
        numbers[missing] = known + np.arange(len(new))
        which = numbers[coded.indices.to_numpy()]
        ends, inner = self.words.gather(which)
        sizes = np.diff(ends) + line + mark
        stop = np.cumsum(sizes)
        ids = np.zeros(int(stop[-1]), np.uint32)
        own = np.ones(len(ids), bool)
        ids[(stop - sizes)[line]] = self.marks["\n"]
        ids[stop[mark] - 1] = np.where(pc.ends_with(pieces, ",").to_numpy(zero_copy_only=False)[mark], self.marks[","], self.marks["."])
        own[(stop - sizes)[line]] = own[stop[mark] - 1] = False
        ids[own] = inner
        return sizes, ids

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, ids) of texts that the library gets one by one."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.array([i for own in found for i in own], np.uint32)

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, ids) of pieces with no blank at an end, many of them in each text that the library gets."""
        line = pc.starts_with(pieces, _LINE)
        own = pc.binary_join_element_wise(pc.if_else(line, _scalar("\n"), _scalar(" ")), pc.replace_substring(pieces, _LINE, ""), _scalar(""))
        bounds = np.append(np.arange(0, len(own), JOINED), len(own))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), own), _scalar("")).to_pylist()
        lengths = pc.binary_length(own if self.kind == "byte" else pc.utf8_lower(pieces)).to_numpy()
        sizes, ids = np.zeros(len(own), np.int64), []
        for a, b, text, e in zip(bounds, bounds[1:], texts, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            found = np.array(e.ids, np.uint32)
            ends = np.concatenate([[0], np.cumsum(self.bytes[found])])
            places = np.searchsorted(ends, np.concatenate([[0], np.cumsum(lengths[a:b])]))
            if places[-1] == len(found) and (ends[places[1:]] == np.cumsum(lengths[a:b])).all():
                sizes[a:b] = np.diff(places)
            else:  # a token's length is not that of its text: one by one
                sizes[a:b], found = self._apart(own[a:b].to_pylist())
            ids.append(found)
        return sizes, np.concatenate(ids) if ids else np.zeros(0, np.uint32)

    def _learn(self, table: _Table, pieces: pa.Array) -> np.ndarray:
        """Add pieces to a table that lacks them; their numbers in it."""
        word = pc.match_substring_regex(pieces, _WORD).to_numpy(zero_copy_only=False)
        alone = pc.match_substring_regex(pieces, rf"^{_FIRST}|^[\t-\r ]|[\t-\r ]$").to_numpy(zero_copy_only=False) & (self.kind == "byte")
        numbers = np.zeros(len(pieces), np.int64)
        for which, get in ((word, self._words), (~word & ~alone, self._joined), (alone, self._lone)):
            if which.any():
                own = pieces.filter(pa.array(which))
                numbers[which] = len(table.pieces) + np.arange(len(own))
                table.add(own, *get(own))
        return numbers

    def _lone(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, ids) of a text's first pieces and of those that end in a blank."""
        return self._apart([p[1:] if p[0] == _FIRST else "\n" + p[1:] if p[0] == _LINE else " " + p for p in pieces.to_pylist()])

    def seed_lengths(self, lengths: dict[str, int]) -> None:
        """Lengths of frequent pieces, which ``counts`` then looks up without encoding them."""
        if self.seed != lengths:
            self.seed = lengths
            self.tables[True] = _Table(False, list(lengths), list(lengths.values()))

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Whether the library has to take a text whole."""
        return pc.match_substring_regex(texts, _ODD[self.kind]).to_numpy(zero_copy_only=False)

    def lengths(self, pieces: list[str]) -> list[int | None]:
        """Tokens of each piece between single blanks; None where only the whole text can tell."""
        own = pa.array(pieces, pa.large_string())
        odd = self.odd(own) | pc.match_substring_regex(own, r"^[\t-\r ]|[\t-\r ]$|^$").to_numpy(zero_copy_only=False)
        sizes = np.full(len(own), -1)
        sizes[~odd] = self._joined(own.filter(pa.array(~odd)))[0]
        return [None if n < 0 else n for n in sizes.tolist()]

    # -- texts

    def _split(self, texts: pa.Array) -> pa.Array:
        """Lists of the pieces of texts that are not odd."""
        if self.kind == "word":
            return pc.ascii_split_whitespace(texts)
        apart = pc.invert(pc.match_substring_regex(texts, _LINES))
        texts = pc.if_else(apart, pc.replace_substring(texts, "\n", " " + _LINE), texts)
        return pc.split_pattern(pc.binary_join_element_wise(_scalar(_FIRST), texts, _scalar("")), " ")

    def _together(self, texts: pa.Array, counts: bool) -> list:
        out: list = [0 if counts else b""] * len(texts)
        odd = self.odd(texts)
        plain = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy() > 0))
        if len(plain):
            split = self._split(texts.take(pa.array(plain)))
            cut = split.offsets.to_numpy() - split.offsets[0].as_py()
            coded = split.flatten().dictionary_encode()
            del split  # the pieces take several times the texts
            table, pieces = self.tables[counts], coded.dictionary
            numbers = table.find(pieces)
            missing = numbers < 0
            if missing.any():
                if len(table.pieces) + missing.sum() > PIECES:
                    seed = self.seed if counts else {}
                    table = self.tables[counts] = _Table(not counts, list(seed), list(seed.values()))
                    numbers = table.find(pieces)
                    missing = numbers < 0
                numbers[missing] = self._learn(table, pieces.filter(pa.array(missing)))
            which = numbers[coded.indices.to_numpy()]
            del coded, pieces, numbers
            if counts:
                cuts = np.concatenate([[0], np.cumsum(table.sizes[which])])[cut]
                for i, n in zip(plain.tolist(), np.diff(cuts).tolist()):
                    out[i] = n
            else:
                ends, ids = table.gather(which)
                raw, cuts = ids.astype("<u4", copy=False).view(np.uint8), ends[cut] * 4
                for i, a, b in zip(plain.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    out[i] = raw[a:b].tobytes()
        for i in np.flatnonzero(odd).tolist():
            ids = self.library.encode(texts[i].as_py(), add_special_tokens=False).ids
            out[i] = len(ids) if counts else np.array(ids, "<u4").tobytes()
        return out

    def _batch(self, texts: pa.Array | list[str | None], counts: bool) -> list:
        """By slices of about ``TOGETHER`` bytes: texts are whole, and a longer one is a slice of its own."""
        texts = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
        group = np.cumsum(pc.binary_length(texts).to_numpy()) // TOGETHER
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        out = []
        for a, b in zip(bounds, bounds[1:]):
            out += self._together(texts[a:b], counts)
            if texts[a:b].nbytes > TOGETHER // 4:  # it takes milliseconds, as a slice takes some tenths of a second
                give_back()
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of texts, without added special tokens; null counts as empty."""
        return self._batch(texts, False)

    def counts(self, texts: pa.Array | list[str | None]) -> list[int]:
        """Numbers of tokens of texts."""
        return self._batch(texts, True)


def gathered(batches, column: str = "text", size: int = TOGETHER):
    """Arrow batches joined until their texts reach ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def encoder(text: str) -> Encoder:
    """One encoder a worker and file; its caches live as long as the worker."""
    return Encoder(text)


def tokenizer_file(path: str) -> str:
    """The JSON text of a tokenizer file on the driver; operators broadcast it (under 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
