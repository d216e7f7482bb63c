"""Public tokenizers inside tasks: each distinct piece of text is encoded by the library once.

Both vocabularies can be cut where no token ever crosses: the byte-level one between its own pre-tokens, the
one of pieces at a space between two other characters.  So a text is split into short units at places that are certain
(``CUT_BYTES``, ``CUT_PIECES``), the library encodes the units not seen before in one batch, and the ids of a text are those of
its units in a row.  Units seen are kept from task to task, up to about ``KEPT_BYTES``, then those of the latest texts only;
a text is worked on in runs of about ``RUN`` characters, so memory does not grow with it.

A null text is empty; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Letters that every version of Unicode knows, followed by an end, white space or ASCII that is no letter; or else all up to white space.
CUT_BYTES = r"\s*[A-Za-zÀ-ÖØ-öø-ɏ]++(?![^\s!-@\[-`{-~])|\s*\S+|\s+"
#: A space between two characters that are no white space.
CUT_PIECES = r"(?<=\S) (?=\S)"
#: Characters of a text worked on together, and bytes of units that a process remembers.
RUN, KEPT_BYTES = 1 << 20, 128 << 20
#: Bytes counted for a remembered unit besides its own.
UNIT_BYTES = 150
#: Units that the library encodes in one call.
TOGETHER = 4096

#: Where runs may be cut, and what a text holds that is not split at all its spaces.
_CALM, _ODD = re.compile(r"\S \S"), re.compile(r"\A | (?=\s|\Z)")


def path_of(name: str) -> str:
    """Where the vocabulary ``name`` lies on this machine: a path, or the name of one of the public files."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def runs(text: str, limit: int = RUN) -> Iterator[str]:
    """``text`` in runs of ``limit`` characters or a little more, cut before single spaces inside a line."""
    at = 0
    while len(text) - at > limit:
        found = _CALM.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:] if at else text


def strings(column: pa.Array) -> list[str]:
    """The texts of a string column; null is empty."""
    try:
        return [s or "" for s in column.to_pylist()]
    except UnicodeDecodeError:
        return [b.decode("utf-8", "replace") if b else "" for b in column.cast(pa.binary()).to_pylist()]


class Known:
    """What a process remembers of units: their ids as little-endian 32-bit numbers."""

    def __init__(self, encode: Callable[[list[str]], Iterable]):
        self.encode, self.ids, self.held = encode, {}, 0

    def learn(self, texts: list[list[str]]) -> None:
        """Have the ids of all units of ``texts``."""
        units = set().union(*texts)
        if self.held > KEPT_BYTES:
            self.ids = {u: self.ids[u] for u in units if u in self.ids}
            self.held = sum(len(u) + len(i) + UNIT_BYTES for u, i in self.ids.items())
        new = list(units.difference(self.ids))
        for i in range(0, len(new), TOGETHER):  # what the library holds of a unit is many times its ids
            for unit, ids in zip(new[i : i + TOGETHER], self.encode(new[i : i + TOGETHER])):
                self.ids[unit] = array("I", ids).tobytes()
                self.held += len(unit) + 4 * len(ids) + UNIT_BYTES

    def of(self, units: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, units))


class Units:
    """Encodes texts as little-endian 32-bit ids, unit by unit.

    ``split`` gives the units of a run of a text, of which it is told whether it is the first; ``whole`` gives the ids of a text that
    must not be cut, else None.
    """

    def __init__(self, split: Callable[[str, bool], list[str]], encode: Callable[[list[str]], Iterable], whole: Callable[[str], bytes | None]):
        self.split, self.known, self.whole = split, Known(encode), whole

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            self.known.learn([u for _, u in waiting])
            for i, units in waiting:
                out[i].append(self.known.of(units))

        for i, text in enumerate(texts):
            if (ids := self.whole(text)) is not None:
                out[i].append(ids)
                continue
            for n, run in enumerate(runs(text)):
                waiting.append((i, self.split(run, not n)))
                size += len(run)
                if size >= RUN:
                    flush()
                    waiting, size = [], 0
        flush()
        return [b"".join(o) for o in out]


_loaded: dict[tuple, Units] = {}


def byte_level(name: str, plain: bool = False, spaced: bool = False) -> Units:
    """The encoder of a byte-level vocabulary of the tokenizers library.

    ``plain`` takes special strings as text; ``spaced`` puts a space before each text.
    """
    if (name, plain, spaced) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path_of(name))
        made.encode_special_tokens = plain
        special = [] if plain else [t.content for t in made.get_added_tokens_decoder().values()]
        cut = re.compile(CUT_BYTES).findall

        def split(run: str, first: bool) -> list[str]:
            return cut(f" {run}" if first and spaced else run)

        def encode(units: list[str]) -> Iterator[list[int]]:
            return (e.ids for e in made.encode_batch_fast(units, add_special_tokens=False))

        def whole(text: str) -> bytes | None:
            if not any(s in text for s in special):
                return None
            return array("I", made.encode(" " * spaced + text, add_special_tokens=False).ids).tobytes()

        _loaded[name, plain, spaced] = Units(split, encode, whole)
    return _loaded[name, plain, spaced]


def pieces(name: str) -> Units:
    """The encoder of a vocabulary of pieces of the sentencepiece library, which puts a space before each text.

    Where a piece of it has a space after another character, texts are encoded whole.
    """
    if (name,) not in _loaded:
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_file=path_of(name))
        inner = any("▁" in made.id_to_piece(i).lstrip("▁") for i in range(made.get_piece_size()))

        odd = re.compile(CUT_PIECES).split

        def split(run: str, first: bool) -> list[str]:
            run = run if first else run[1:]
            return odd(run) if _ODD.search(run) else run.split(" ")

        def encode(units: list[str]) -> list[list[int]]:
            return made.encode(units, num_threads=1) if units else []

        def whole(text: str) -> bytes | None:
            return array("I", made.encode(text)).tobytes() if inner or "▁" in text else None  # which the library takes for a space

        _loaded[name,] = Units(split, encode, whole)
    return _loaded[name,]


def byte_level_bytes(name: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves; the others follow 255 in their order
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    made = Tokenizer.from_file(path_of(name))
    words = made.get_vocab(with_added_tokens=False)
    out = [b""] * (1 + max(made.get_vocab().values()))
    for word, i in words.items():
        out[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
    return out


def piece_bytes(name: str) -> list[bytes]:
    """The bytes of each id of a vocabulary of pieces."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path_of(name))
    out = []
    for i in range(made.get_piece_size()):
        piece = made.id_to_piece(i)
        byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
        out.append(bytes([int(byte[1], 16)]) if byte and made.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
