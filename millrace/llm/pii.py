"""Personal data: patterns for e-mail, IP, card and phone, and a skip-chain conditional random field that adds spans.

The nodes of a document's field are its tokens (runs without white space) that hold a digit or "@"; all other tokens are O. Chain
edges join nodes at most CHAIN_WORDS words apart. Skip edges join each node to the one before with the same string and to the one
before with the same shape, however far away, so k alike tokens cost k edges. Tokens inside a pattern's span are
observed; loopy sum-product message passing carries their labels over the edges to the others. A token whose label is sure is
added as a span if skip edges lead from it to an observed one of that label, over tokens that are as sure of it. So
"call 555-010-7788 ... +1 555-010-7788" can get one label for both.

The weights are fitted by pseudo-likelihood on counts of (features, neighbour labels, label) over all documents, labelled by
the patterns. Neighbours over a kind of edge count as one label or none, so there are 216 neighbourhoods, and features take
1,440 values: the counts have at most 311,040 cells, whatever the number of documents, and all of them are used.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts, prepare, slices
from millrace.llm.scan import text_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

# The patterns of the base kinds. Possessive where that cannot change a match, so that no text takes long.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
DIGITS = re.compile(r"[0-9]")

#: Nodes with at most this many words between count as neighbours.
CHAIN_WORDS = 3
#: Turns of message passing and the share of the old message kept.
TURNS, DAMPING = 12, 0.3
#: Least probability of a label for a span that the patterns do not find.
SURE = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: for each "@" the local part is all that may belong to it since the last match."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            last = match.end()
        at = text.find("@", match.end() if match else at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


@dataclass
class Field:
    """Nodes of a document: place, feature number, observed label (or -1), and edges (i, j, kind): 0 chain, 1 string, 2 shape."""

    spans: list[tuple[int, int]]
    features: list[int]
    observed: list[int]
    edges: list[tuple[int, int, int]]


EDGE_KINDS = ("chain", "string", "shape")
TRIM = ".,;:!?\"'()[]{}<>#*$%&|"


def shape_of(token: str) -> str:
    """Digits to 0, letters to a, runs of letters shortened to one."""
    return re.sub("a+", "a", re.sub("[^\\W\\d_]", "a", re.sub("[0-9]", "0", token)))


def feature_of(token: str, before: str) -> int:
    """A small number for what a token looks like: a product of few-valued features."""
    digits = [c for c in token if "0" <= c <= "9"]
    n = len(digits)
    count = 0 if n < 4 else 1 if n < 9 else 2 if n < 13 else 3 if n < 20 else 4
    dots = min(token.count("."), 4)
    letters = any(c.isalpha() for c in token)
    at = 0 if "@" not in token else 1 if "." in token.rpartition("@")[2] else 2
    plus = token[:1] == "+"
    brackets = "(" in token or ")" in token or "-" in token
    checks = count == 3 and luhn("".join(digits))
    quoted = before[-1:] in ("=", ":")
    out = 0
    for value, size in ((count, 5), (dots, 5), (letters, 2), (at, 3), (plus, 2), (brackets, 2), (checks, 2), (quoted, 2)):
        out = out * size + int(value)
    return out


#: Features of a number of feature_of, as one-hot columns: value counts in the same order.
SIZES = (5, 5, 2, 3, 2, 2, 2, 2)


def unfolded(numbers: np.ndarray) -> np.ndarray:
    """One-hot rows of feature numbers, with pairs of the three most telling ones."""
    values, rest = [], numbers.copy()
    for size in reversed(SIZES):
        values.append(rest % size)
        rest //= size
    values = values[::-1]
    both = [(values[0] * SIZES[1] + values[1], SIZES[0] * SIZES[1]), (values[0] * SIZES[2] + values[2], SIZES[0] * SIZES[2]), (values[3] * 2 + values[4], 6)]
    columns = [*zip(values, SIZES), *both]
    return np.concatenate([np.eye(size)[v] for v, size in columns] + [np.ones((len(numbers), 1))], axis=1)


def field_of(text: str, spans: list[tuple[str, int, int]]) -> Field:
    tokens, before, words, place = [], "", [], 0
    for m in TOKEN.finditer(text):
        token = m.group()
        place += 1
        if "@" in token or DIGITS.search(token):
            left = len(token) - len(token.lstrip(TRIM))
            right = len(token.rstrip(TRIM))
            if left < right:
                tokens.append((m.start() + left, m.start() + right, before))
                words.append(place)
        before = token
    owner, ends = [-1] * len(tokens), [e for _, e, _ in tokens]
    for kind, start, end in sorted(spans, key=lambda s: KINDS.index(s[0]), reverse=True):
        for k in range(bisect_right(ends, start), len(tokens)):
            if tokens[k][0] >= end:
                break
            owner[k] = KINDS.index(kind) + 1
    edges, last = [], {}
    for k, (s, e, _) in enumerate(tokens):
        if k and words[k] - words[k - 1] <= CHAIN_WORDS + 1:
            edges.append((k - 1, k, 0))
        token = text[s:e]
        for kind, key in ((1, token.lower()), (2, shape_of(token))):
            if (kind, key) in last and not (kind == 2 and edges and edges[-1][:2] == (last[kind, key], k) and edges[-1][2] == 1):
                edges.append((last[kind, key], k, kind))
            last[kind, key] = k
    return Field([(s, e) for s, e, _ in tokens], [feature_of(text[s:e], b) for s, e, b in tokens], owner, edges)


@dataclass(frozen=True)
class Crf:
    """unary: features x labels; pair: for each kind of edge a symmetric label x label table (log potentials)."""

    unary: np.ndarray
    pair: np.ndarray


#: What the neighbours over a kind of edge are reduced to in the fit: 0 for none, else 1 + the last of their labels in LABELS.
NEAR = len(LABELS) + 1


def neighbourhoods(field: Field) -> list[int]:
    """For each node a number below NEAR ** 3 for what its neighbours are, an unobserved one counting as O."""
    near = [[0] * len(field.spans) for _ in EDGE_KINDS]
    for i, j, kind in field.edges:
        for a, b in ((i, j), (j, i)):
            near[kind][a] = max(near[kind][a], 1 + max(field.observed[b], 0))
    return [(chain * NEAR + string) * NEAR + shape for chain, string, shape in zip(*near)]


def near_labels() -> np.ndarray:
    """NEAR ** 3 x kinds x labels: a 1 for the label that a neighbourhood has over each kind of edge."""
    number = np.arange(NEAR**3)
    each = np.stack([number // NEAR**2, number // NEAR % NEAR, number % NEAR], axis=1)
    return np.eye(NEAR)[each][:, :, 1:]


def fit(feature: np.ndarray, near: np.ndarray, counts: np.ndarray, steps: int = 300, rate: float = 0.5, l2: float = 1e-3) -> Crf:
    """Pseudo-likelihood on cells of (feature number, neighbourhood) with counts of each label, one row a cell.

    Skip edges are kept attractive: equal labels never lower the score and different ones never raise it, since what looks alike
    is to have one label.
    """
    labels, kinds = len(LABELS), len(EDGE_KINDS)
    if not len(feature):
        width = unfolded(np.zeros(1, np.int64)).shape[1]
        return Crf(np.zeros((width, labels)), np.zeros((kinds, labels, labels)))
    numbers, of = np.unique(feature, return_inverse=True)
    x, z = unfolded(numbers), near_labels()
    # Counts are damped, or documents without personal data would leave nothing to the other labels.
    weight = np.sqrt(counts.astype(float))
    weight /= weight.sum()
    total = weight.sum(axis=1, keepdims=True)

    def summed(values, place, size):
        return np.stack([np.bincount(place, column, size) for column in values.T], axis=1)

    unary, pair = np.zeros((x.shape[1], labels)), np.zeros((kinds, labels, labels))
    memory_u, memory_p = np.full(unary.shape, 1e-8), np.full(pair.shape, 1e-8)
    for _ in range(steps):
        score = (x @ unary)[of] + np.einsum("nkl,klm->nm", z, pair)[near]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = p / p.sum(axis=1, keepdims=True) * total - weight
        gu = x.T @ summed(error, of, len(numbers)) + l2 * unary
        gp = np.einsum("nkl,nm->klm", z, summed(error, near, len(z)))
        gp = (gp + gp.transpose(0, 2, 1)) / 2 + l2 * pair
        memory_u += gu**2
        memory_p += gp**2
        unary -= rate * gu / np.sqrt(memory_u)
        pair -= rate * gp / np.sqrt(memory_p)
        pair[1:] = np.where(np.eye(labels, dtype=bool), np.maximum(pair[1:], 0), np.minimum(pair[1:], 0))
    return Crf(unary, pair)


def marginals(field: Field, model: Crf, turns: int = TURNS) -> np.ndarray:
    """Label probabilities of every node by loopy sum-product; observed nodes are certain."""
    n, labels = len(field.spans), len(LABELS)
    score = unfolded(np.array(field.features, np.int64)) @ model.unary
    for k, label in enumerate(field.observed):
        if label >= 1:
            score[k] = -50.0
            score[k, label] = 0.0
    if field.edges:
        i, j, kind = (np.array(c) for c in zip(*field.edges))
        source, target, kind = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([kind, kind])
        back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        message = np.zeros((len(source), labels))
        for _ in range(turns):
            total = score.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[back])[:, :, None] + model.pair[kind]
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        np.add.at(score, target, message)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[tuple[str, int, int]], model: Crf) -> list[tuple[str, int, int]]:
    """Tokens outside the patterns' spans that the field labels with certainty and that agree with an observed one.

    They agree if skip edges lead from the token to an observed one with the same label, and every token on the way is as sure
    of that label. Without an observed span there is nothing to be consistent with, and nothing is added.
    """
    if not spans:
        return []
    field = field_of(text, spans)
    if all(label >= 1 for label in field.observed):
        return []
    p = marginals(field, model)
    best = p.argmax(axis=1)
    sure = (best > 0) & (p[np.arange(len(best)), best] >= SURE)
    label = [seen if seen >= 1 else int(b) if s else 0 for seen, b, s in zip(field.observed, best, sure)]
    alike: dict[int, list[int]] = {}
    for i, j, kind in field.edges:
        if kind and label[i] and label[i] == label[j]:
            alike.setdefault(i, []).append(j)
            alike.setdefault(j, []).append(i)
    reached = {k for k, seen in enumerate(field.observed) if seen >= 1}
    ahead = list(reached)
    while ahead:
        new = [k for k in alike.get(ahead.pop(), ()) if k not in reached]
        reached.update(new)
        ahead += new
    return [(LABELS[label[k]], *field.spans[k]) for k in sorted(reached) if field.observed[k] < 1]


def rows_to_read(texts: pa.Array) -> np.ndarray:
    """Whether a text has a digit or "@" at all."""
    data, offsets = text_bytes(texts)
    some = ((data >= 48) & (data <= 57)) | (data == ord("@"))
    total = np.concatenate([[0], np.cumsum(some)])
    return total[offsets[1:]] > total[offsets[:-1]]


def configurations(docs: DataFrame) -> DataFrame:
    """(feature, near, n0 .. n4): how often each label occurs with each feature number and neighbourhood, over all documents."""
    prepare(docs.sparkSession)

    def counted(batches):
        counts: Counter = Counter()
        for part in slices(batches):
            read = rows_to_read(part.column("text"))
            for text in part.column("text").filter(pa.array(read)).to_pylist():
                field = field_of(text, base_spans(text))
                counts.update(zip(field.features, neighbourhoods(field), (max(label, 0) for label in field.observed)))
        if counts:
            names = ["feature", "near", "label"]
            columns = [pa.array(c, pa.int32()) for c in zip(*counts)] + [pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n"])

    made = docs.select("text").mapInArrow(counted, "feature int, near int, label int, n long")
    sums = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(LABELS))]
    return made.groupBy("feature", "near").agg(*sums)


def train(docs: DataFrame) -> Crf:
    """Weights from all documents: one pass, counts summed before and after one small shuffle. Every cell counts; there are at
    most 311,040 (17 MB). Null and empty texts have no nodes; a repeated row counts as often as it is there."""
    cells = configurations(docs).toPandas().sort_values(["feature", "near"])
    counts = cells[[f"n{k}" for k in range(len(LABELS))]].to_numpy()
    return fit(cells["feature"].to_numpy(), cells["near"].to_numpy(), counts)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def found(docs: DataFrame, model: Crf) -> DataFrame:
    """SCHEMA, a row per document, without a shuffle: counts and hash of the patterns' spans, all spans, how many were added.

    A null text counts as empty; a text without spans has the hash of the empty string and "" as spans. Repeated rows give
    repeated results, an empty table gives none; a text of any length is read whole; columns but doc_id and text are not looked at.
    """
    prepare(docs.sparkSession)

    def work(part):
        rows = part.num_rows
        out = {"doc_id": part.column("doc_id")} | {f"n_{k}": [0] * rows for k in KINDS}
        out |= {"base_sha256": [hashlib.sha256(b"").hexdigest()] * rows, "spans": [""] * rows, "n_added": [0] * rows}
        read = np.flatnonzero(rows_to_read(part.column("text")))
        for row, text in zip(read.tolist(), part.column("text").take(pa.array(read)).to_pylist()):
            base = base_spans(text)
            if base:
                more = added_spans(text, base, model)
                for kind, _, _ in base:
                    out[f"n_{kind}"][row] += 1
                out["base_sha256"][row] = hashlib.sha256(joined(base).encode()).hexdigest()
                out["spans"][row], out["n_added"][row] = joined(base + more), len(more)
        return out

    return map_texts(docs, work, SCHEMA)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [EMAIL], [IP], [CARD] or [PHONE] for each span; of overlapping ones the first gives the name."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def pii_stage(docs: DataFrame) -> DataFrame:
    """All documents with personal data replaced in text, n_chars (if there) counted anew for those; other columns stay."""
    model = train(docs)

    def run(batches):
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            changed = {}
            for row in np.flatnonzero(rows_to_read(part.column("text"))).tolist():
                base = base_spans(texts[row])
                if base:
                    changed[row] = redacted(texts[row], base + added_spans(texts[row], base, model))
            if changed:
                for row, text in changed.items():
                    texts[row] = text
                k = part.schema.get_field_index("text")
                part = part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))
                k = part.schema.get_field_index("n_chars")
                if k >= 0:
                    sizes = part.column(k).to_pylist()
                    for row, text in changed.items():
                        sizes[row] = len(text)
                    part = part.set_column(k, part.schema.field(k), pa.array(sizes, part.schema.field(k).type))
            yield part

    return docs.mapInArrow(run, docs.schema)


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return found(docs, train(docs))
