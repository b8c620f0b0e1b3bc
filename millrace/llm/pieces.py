"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies with a score-ordered agenda of adjacent pairs.

A text's symbols are its characters. The agenda holds every adjacent pair whose joined string is a piece, ordered by the piece's
score, then from left to right; the first pair is merged and its neighbours enter, until none is left. Characters that are no
piece become byte pieces.

White space becomes U+2581, one is put in front. If no piece has that mark after another character, no merge crosses
the place before it, and a text is the sequence of its chunks (marks, then other characters). Each different chunk is
encoded once per worker. Short chunks go through the agenda together, one merge of each at a time, as rows of an array; longer
ones have a heap. All new chunks of an Arrow batch are checked against the library, in both directions.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm.common import gathered, map_texts, prepare
from millrace.llm.tokens import joined_of

SPACE = "▁"
#: Chunks of at most this many characters share an array.
ROW_CHARS = 40
#: Chunks that go through the array together.
ROWS = 4096
#: Different chunks a worker keeps before it begins anew.
KEPT_CHUNKS = 500_000
NONE = np.iinfo(np.int32).max

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long"


def fields(data: bytes):
    """(number, value) of a protocol buffer message: bytes, or an integer."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A vocabulary read from a model file: pieces, scores and the pairs that may be merged."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = list(fields(file.read()))
        entries = [dict(fields(value)) for number, value in model if number == 1]
        trainer = dict(fields(next((v for n, v in model if n == 2), b"")))
        rules = dict(fields(next((v for n, v in model if n == 3), b"")))
        kinds = [entry.get(3, 1) for entry in entries]
        # Piece types: 1 normal, 2 unknown, 3 control, 4 defined by the user, 5 unused, 6 byte.
        if trainer.get(3) != 2 or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or {4, 5} & set(kinds):
            raise ValueError("needs a merge-type model without normalization, with a dummy prefix and normal pieces only")
        self.pieces = [entry[1].decode() for entry in entries]
        self.kinds = kinds
        self.id = {piece: k for k, piece in enumerate(self.pieces) if kinds[k] == 1}
        self.byte = {int(piece[3:5], 16): k for k, piece in enumerate(self.pieces) if kinds[k] == 6}
        self.unknown = kinds.index(2)
        self.apart = not any(SPACE in piece.lstrip(SPACE) for piece in self.id)
        scores = np.array([np.frombuffer(e.get(2, b"\0\0\0\0"), "<f4")[0] for e in entries])
        rank = np.searchsorted(np.unique(-scores), -scores).astype(np.int32)

        # Symbols: pieces, then single characters that occur in pieces without being one. -1 stands for all others.
        letters = sorted({c for piece in self.id for c in piece} - self.id.keys())
        self.symbol = self.id | {c: len(self.pieces) + k for k, c in enumerate(letters)}
        self.letters = letters
        self.width = len(self.pieces) + len(letters)
        pairs = {}
        for piece, k in self.id.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = k
        self.pairs = {key: (int(rank[k]), k) for key, k in pairs.items()}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[key] for key in self.keys.tolist()], np.int32)
        self.rank = rank[self.merged]
        self.text = [self.shown(k) for k in range(len(self.pieces))]

    def shown(self, k: int) -> bytes:
        """The bytes that a piece stands for when decoded."""
        if self.kinds[k] == 6:
            return bytes([int(self.pieces[k][3:5], 16)])
        return b"" if self.kinds[k] == 3 else " ⁇ ".encode() if self.kinds[k] == 2 else self.pieces[k].replace(SPACE, " ").encode()

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in `keys`, -1 if they may not be merged."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.width + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def ids_of(self, symbols: list[int], text: str) -> list[int]:
        """Ids of the symbols left; a character that is no piece becomes the pieces of its bytes."""
        if all(0 <= s < len(self.pieces) for s in symbols):
            return symbols
        out, at = [], 0
        for s in symbols:
            known = 0 <= s < len(self.pieces)
            if known:
                out.append(s)
            elif self.byte:
                out.extend(self.byte[b] for b in text[at].encode())
            else:
                out.append(self.unknown)
            at += len(self.pieces[s]) if known else 1
        return out

    def encode_long(self, text: str) -> list[int]:
        """The agenda as a heap."""
        symbols = [self.symbol.get(c, -1) for c in text]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            if 0 <= i and j < n and symbols[i] >= 0 and symbols[j] >= 0:
                key = symbols[i] * self.width + symbols[j]
                if key in self.pairs:
                    heapq.heappush(agenda, (self.pairs[key][0], i, key, j))

        for i in range(n - 1):
            enter(i, i + 1)
        alive = [True] * n
        while agenda:
            _, i, key, j = heapq.heappop(agenda)
            if not (alive[i] and alive[j]) or after[i] != j or symbols[i] * self.width + symbols[j] != key:
                continue
            symbols[i], alive[j] = self.pairs[key][1], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            enter(before[i], i)
            enter(i, after[i])
        return self.ids_of([s for s, a in zip(symbols, alive) if a], text)

    def encode_rows(self, texts: list[str]) -> list[list[int]]:
        """The agenda of many short texts: a row each, the rank of each pair at its left place, one merge a turn in every row."""
        width = max(map(len, texts)) + 1
        get = self.symbol.get
        symbols = np.full((len(texts), width), -1, np.int32)
        for row, text in enumerate(texts):
            symbols[row, : len(text)] = [get(c, -1) for c in text]
        alive = np.zeros(symbols.shape, bool)
        alive[:] = np.arange(width) < np.array([len(t) for t in texts])[:, None]
        rank = np.full(symbols.shape, NONE, np.int32)
        at = self.found(symbols[:, :-1], symbols[:, 1:])
        rank[:, :-1] = np.where(at >= 0, self.rank[at], NONE)
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (len(texts), 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (len(texts), 1))
        rows = np.arange(len(texts))
        while len(rows):
            i = rank[rows].argmin(axis=1)
            busy = rank[rows, i] != NONE
            rows, i = rows[busy], i[busy]
            if not len(rows):
                break
            j = after[rows, i]
            symbols[rows, i] = self.merged[self.found(symbols[rows, i], symbols[rows, j])]
            alive[rows, j] = False
            rank[rows, j] = NONE
            k = after[rows, j]
            after[rows, i] = k
            inside = k < width
            before[rows[inside], k[inside]] = i[inside]
            last = np.minimum(k, width - 1)
            at = np.where(inside & alive[rows, last], self.found(symbols[rows, i], symbols[rows, last]), -1)
            rank[rows, i] = np.where(at >= 0, self.rank[at], NONE)
            h = before[rows, i]
            some = h >= 0
            r, h, i = rows[some], h[some], i[some]
            at = self.found(symbols[r, h], symbols[r, i])
            rank[r, h] = np.where(at >= 0, self.rank[at], NONE)
        counts = alive.sum(axis=1)
        flat, ends = symbols[alive].tolist(), np.cumsum(counts).tolist()
        return [self.ids_of(flat[e - n : e], t) for e, n, t in zip(ends, counts.tolist(), texts)]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        out: list = [None] * len(chunks)
        order = sorted(range(len(chunks)), key=lambda k: len(chunks[k]))
        short = [k for k in order if len(chunks[k]) <= ROW_CHARS]
        for start in range(0, len(short), ROWS):
            part = short[start : start + ROWS]
            for k, ids in zip(part, self.encode_rows([chunks[k] for k in part])):
                out[k] = ids
        for k in order[len(short) :]:
            out[k] = self.encode_long(chunks[k])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the decoded text, before the dummy blank is taken off and bytes that are no UTF-8 are replaced."""
        return b"".join(map(self.text.__getitem__, ids))


class CheckedEncoder:
    """Encodes and decodes texts chunk by chunk and checks every new chunk against the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = PieceModel(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}
        self.corrected: set[str] = set()

    def learn(self, chunks: list[str]) -> None:
        """chunks: keys without the blank before them, or with all blanks but that one."""
        found = self.model.encode_chunks([SPACE + key.replace(" ", SPACE) for key in chunks])
        wanted = self.library.encode(chunks, num_threads=1)
        back = self.library.decode(wanted, num_threads=1)
        for key, mine, theirs, shown in zip(chunks, found, wanted, back):
            text = self.model.decode(mine)
            # A mark by itself (a blank at the end) is no text that the library can be given.
            if key and (mine != theirs or text[1:] != shown.encode()):
                self.corrected.add(key)
                mine, text = theirs, b" " + shown.encode()
            self.ids[key] = ",".join(map(str, mine)).encode()
            self.text[key] = text

    def odd_chunks(self, text: str) -> list[str]:
        """The chunks of a text that is not words with single blanks between."""
        if not text:
            return []
        if not self.model.apart or SPACE in text:
            return [text]
        return [chunk[1:] for chunk in re.findall(r" +[^ ]*", " " + text)]

    def encode(self, texts: list[str] | pa.Array) -> list[tuple[bytes, bytes, int]]:
        """For each text: its ids in decimal, joined by commas, the bytes of its decoded text, and chunks the library corrected.

        Plain texts are split, their chunks told apart and the ids joined in arrays; only different chunks become Python objects.
        """
        if len(self.ids) > KEPT_CHUNKS:
            for kept in (self.ids, self.text, self.corrected):
                kept.clear()
        array = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        odd = pc.or_(pc.match_substring_regex(array, "^ | $|  |^$"), pc.match_substring(array, SPACE)) if self.model.apart else pa.array([True] * len(array), pa.bool_())
        split = pc.split_pattern(pc.if_else(odd, "", array), " ")
        known = [self.odd_chunks(text) if is_odd else None for text, is_odd in zip(pc.if_else(odd, array, "").to_pylist(), odd.to_pylist())]
        flat = split.flatten().dictionary_encode()
        chunks, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        new = set(chain(chunks, *filter(None, known))).difference(self.ids)
        if new:
            self.learn(list(new))
        ids, text = ([kept[chunk] for chunk in chunks] for kept in (self.ids, self.text))
        wrong = np.concatenate([[0], np.cumsum(np.array([chunk in self.corrected for chunk in chunks], bool)[codes])])
        wrong = (wrong[offsets[1:]] - wrong[offsets[:-1]]).tolist()
        out = [(a, b[1:], n) for a, b, n in zip(joined_of(ids, codes, offsets, b","), joined_of(text, codes, offsets), wrong)]
        for k, parts in enumerate(known):
            if parts is not None:
                out[k] = (b",".join(map(self.ids.__getitem__, parts)), b"".join(map(self.text.__getitem__, parts))[1:], sum(map(self.corrected.__contains__, parts)))
        return out


_encoders: dict[str, CheckedEncoder] = {}


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """SCHEMA, a row per document, without a shuffle; n_corrected counts chunks for which the library's ids were taken (none
    is known). A null text counts as empty; an empty text has no ids."""
    prepare(docs.sparkSession)

    def work(part):
        if model not in _encoders:
            _encoders[model] = CheckedEncoder(model)
        found = _encoders[model].encode(part.column("text").fill_null(""))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return {
            "doc_id": part.column("doc_id"), "n_tokens": [ids.count(b",") + 1 if ids else 0 for ids, _, _ in found],
            "ids_sha256": [sha(ids) for ids, _, _ in found], "decoded_sha256": [sha(text) for _, text, _ in found],
            "n_corrected": [n for _, _, n in found],
        }

    return map_texts(docs, work, SCHEMA, gathered)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table
    from millrace.llm.tokens import tokenizer_path

    return encoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
