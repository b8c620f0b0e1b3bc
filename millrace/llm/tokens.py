"""Exact token ids of whole texts, with each different word encoded once per worker.

The library needs several microseconds a word, so texts are cut at blanks where the tokenizer is known to cut too, and the
ids of each piece are kept. Which cuts are safe follows from the tokenizer file; any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Different pieces kept by a worker before it begins anew.
KEPT_PIECES = 1_500_000
#: Different pieces the library encodes in one call, parted by a special token.
JOINED_PIECES = 64

#: Kept for a piece that may not be encoded apart from its text; told from empty ids by its identity.
ALONE = bytes(bytearray(b"alone"))
EDGES = {" ", *(" " + chr(c) for c in range(1 << 16) if chr(c).isspace())}
#: Kinds of bytes of a text. Letters are those of Latin-1, whose second bytes follow 0xC3; each mark is one byte.
OTHER, LETTER, MARK, LINE_END, BLANK = range(5)
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[[*b".,!?;:|#*$%&"]] = MARK
KINDS[[*b"\n"]], KINDS[[*b" "]] = LINE_END, BLANK


class PieceEncoder:
    """encode(texts) gives the ids of each text as little-endian unsigned 32-bit integers, in bytes.

    How texts are cut ("mode"):
    - "apart": white space separates words and is dropped, as a normalizer and pre-tokenizer state: cut at every blank.
    - "ahead": a blank belongs to the word after it (byte-level with the usual pattern, no normalizer): cut before each
      blank. Texts with a blank before other white space, at their end, or with a special token go to the library whole.
    - "whole": everything else.
    """

    def __init__(self, path: str, most: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.mode, self.special = way_to_cut(spec)
        self.edge = edge_ids(spec, self.mode)
        self.mark = self.special[0] if self.special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else None
        self.kept: dict[str, bytes] = {}
        self.most = most

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Texts are cut, pieces told apart and their ids joined in arrays; only the different pieces of a call become Python objects."""
        if self.mode == "whole":
            return self.whole(texts if isinstance(texts, list) else texts.to_pylist())
        if len(self.kept) > self.most:
            self.kept.clear()
        array = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        parts, offsets = cut(array)
        parts = parts.dictionary_encode()
        pieces, codes = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        found = list(map(self.kept.get, pieces))
        new = [piece for piece, ids in zip(pieces, found) if ids is None]
        if new:
            self.learn_all(new)
            found = list(map(self.kept.__getitem__, pieces))
        out = joined_of(found, codes, offsets)
        alone = [k for k, ids in enumerate(found) if ids is ALONE]
        if alone:
            bad = np.concatenate([[0], np.cumsum(np.isin(codes, alone))])
            for row in np.flatnonzero(bad[offsets[1:]] > bad[offsets[:-1]]).tolist():
                out[row] = self.whole([array[row].as_py()])[0]
        return out

    def learn_all(self, new: list[str]) -> None:
        if self.edge is not None:
            plain = [piece for piece in new if piece[1:].isalpha() and (piece[0] == " " or self.mode == "apart" and piece[0].isalpha())]
            for at in range(0, len(plain), JOINED_PIECES):
                self.learn_words(plain[at : at + JOINED_PIECES])
            new = [piece for piece in new if piece not in self.kept]
        for at in range(0, len(new), JOINED_PIECES):
            self.learn(new[at : at + JOINED_PIECES])
        if self.mode == "ahead":  # a blank before other white space or at the end may belong to either side
            self.kept.update((piece, ALONE) for piece in new if piece[:2] in EDGES)

    def learn_words(self, words: list[str]) -> None:
        """Keeps the ids of words in one line: they are told apart by the ids that end a word, or begin one with its blank. Nothing
        is kept if there are not as many of those as words (each word has one at least)."""
        line = (" " if self.mode == "apart" else "").join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) == len(words):
            cuts = [0, *(at + 1).tolist()] if self.mode == "apart" else [*at.tolist(), len(ids)]
            data = ids.tobytes()
            self.kept.update((word, data[4 * start : 4 * end]) for word, start, end in zip(words, cuts, cuts[1:]))

    def learn(self, new: list[str]) -> None:
        """Keeps the ids of pieces: the library treats what lies between special tokens independently."""
        joined = self.mark.join(new) if self.mark else ""
        if self.mark is None or joined.count(self.mark) >= len(new) or any(s in joined for s in self.special[1:]):
            self.kept.update(zip(new, self.whole(new)))
            if self.mode == "ahead":
                self.kept.update((piece, ALONE) for piece in new if any(s in piece for s in self.special))
            return
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
        data, start = ids.tobytes(), 0
        for piece, end in zip(new, ends, strict=True):
            self.kept[piece] = data[4 * start : 4 * end]
            start = end + 1

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def joined_of(values: list[bytes], codes: np.ndarray, offsets: np.ndarray, between: bytes = b"") -> list[bytes]:
    """For each list of codes (given by its offsets) the values of its codes, joined."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(codes))
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), taken)
    return pc.binary_join(lists, pa.scalar(between, pa.large_binary())).to_pylist()


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, one after the other, none empty, and where each text's pieces begin (and the last ends).

    A text is cut before each blank. What lies between is cut further between words, marks and line ends, unless it has
    anything else in it, two line ends together or a line end after its blank: those three never share a token there.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    kind[lead] = kind[lead + 1] = np.where((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7), LETTER, OTHER)
    start = kind == BLANK
    start[ends[:-1][ends[:-1] < len(data)]] = True
    change = np.zeros(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    bad = kind == OTHER
    line = np.flatnonzero(kind[1:] == LINE_END) + 1
    bad[line] |= ~start[line] & ((kind[line - 1] == LINE_END) | (kind[line - 1] == BLANK))
    pieces = np.flatnonzero(start)
    whole = np.flatnonzero(np.logical_or.reduceat(bad, pieces))
    change[1:] &= kind[:-1] != BLANK
    if len(whole):
        closes = np.append(pieces[1:], len(data))
        edges = np.zeros(len(data) + 1, np.int8)
        edges[pieces[whole]] += 1
        edges[closes[whole]] -= 1
        change &= np.cumsum(edges[:-1], dtype=np.int8) == 0
    starts = np.flatnonzero(start | change)
    offsets = np.append(starts, len(data)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return found, np.searchsorted(starts, ends)


def edge_ids(spec: dict, mode: str) -> np.ndarray | None:
    """By id whether it ends a word ("apart", by a suffix) or begins with a blank ("ahead"); None if that cannot be told."""
    vocabulary = spec["model"].get("vocab")
    suffix = spec["model"].get("end_of_word_suffix")
    if mode == "whole" or not isinstance(vocabulary, dict) or mode == "apart" and not suffix:
        return None
    highest = max([*vocabulary.values(), *(token["id"] for token in spec.get("added_tokens") or ())])
    edge = np.zeros(highest + 1, bool)
    # The byte of a blank is written as this letter in the vocabulary of a byte-level tokenizer.
    edge[[i for token, i in vocabulary.items() if (token.endswith(suffix) if mode == "apart" else token.startswith("\u0120"))]] = True
    return edge


def way_to_cut(spec: dict) -> tuple[str, list[str]]:
    """The mode of PieceEncoder and the special strings, from a tokenizer file."""
    special = [token["content"] for token in spec.get("added_tokens") or ()]
    normalizer, before = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or ())
    if spec.get("model", {}).get("dropout") or not plain:
        return "whole", special
    if normalizer is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "ahead", special
    steps = (normalizer or {}).get("normalizers", ())
    collapses = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} in steps
    known = {step["type"] for step in steps} <= {"NFC", "Replace", "Lowercase"}
    first = (before.get("pretokenizers") or [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    words_only = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    if collapses and known and words_only and r"[^\s\p{L}\p{N}]" in pattern and " " not in pattern and not any(" " in s for s in special):
        return "apart", special
    return "whole", special


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, most: int = KEPT_PIECES) -> PieceEncoder:
    """The encoder of a tokenizer file that keeps `most` pieces before it begins anew, one per worker process."""
    if (path, most) not in _encoders:
        _encoders[path, most] = PieceEncoder(path, most)
    return _encoders[path, most]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
