"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what repeats them.

Patterns find e-mail addresses, network addresses, card and phone numbers. The field labels the words that
hold a digit or an at sign; every other word is no personal data by the field's own rule, so it links
nothing. Adjacent words share a chain potential. Words of one document that are equal or similar (the same
digits, the same name before an at sign) share a skip potential however far apart they are. Loopy message
passing makes the labels of a document agree: a number without its country code is a phone number if the
document has it with the code elsewhere.

Weights are trained on the patterns' own findings, on a bounded sample. The label of a word that is similar to
a found one but not found itself is unknown there, a hidden variable. Half of the words that have a similar one
lose their features, so the field has to learn how far similar words can be trusted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import BLANKS, chunks, portable, stored

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none of them
SLOTS = 1 << 12  # hashed features
SURE = 40.0  # log odds of a label held fast
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Possessive repeats give back nothing: each pattern needs time in proportion to the text.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARKED = re.compile("[0-9@]")
WORD = re.compile(f"[^{BLANKS}]+")
DIGITS = re.compile("[0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind and start."""
    out = [(0, b, e) for b, e in _emails(text)]
    out += [(1, *m.span()) for m in ADDRESS.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return out


def marked_words(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an at sign, without punctuation around them."""
    out, end = [], 0
    found = MARKED.search(text)
    while found:
        begin = 1 + max(end - 1, *(text.rfind(c, end, found.start()) for c in BLANKS))
        end = WORD.match(text, found.start()).end()
        word = text[begin:end]
        inner = word.lstrip(".,;:!?\"'<>[]{}")
        first = begin + len(word) - len(inner)
        inner = inner.rstrip(".,;:!?\"'<>[]{}")
        if inner.startswith("(") and ")" not in inner:
            first, inner = first + 1, inner[1:]
        elif inner.endswith(")") and "(" not in inner:
            inner = inner[:-1]
        out.append((first, first + len(inner)))
        found = MARKED.search(text, end)
    return out


def _shape(word: str) -> str:
    return LETTERS.sub("a", DIGITS.sub("9", word))


def _key(word: str) -> str | None:
    """What similar words have in common: the name before an at sign, the last seven digits, a name with digits."""
    name = "".join(c for c in word.partition("@")[0].lower() if c.isalnum())
    if "@" in word or not name.isdigit():
        return name if len(name) >= 5 else None
    return name[-7:] if len(name) >= 4 else None


def _features(text: str, begin: int, end: int) -> list[int]:
    word = text[begin:end]
    shape, runs = _shape(word), DIGITS.findall(word)
    digits = "".join(runs)
    before = WORD.findall(text[max(0, begin - 40) : begin])[-1:]
    after = WORD.match(text[end : end + 40].lstrip(BLANKS))
    found = [
        "bias", "shape " + (shape if len(shape) <= 24 else "long"), "runs " + "-".join(str(len(r)) for r in runs[:6]),
        f"digits {min(len(digits), 20)}", f"at {word.count('@')}", f"check {16 <= len(digits) <= 19 and luhn(digits)}",
        f"octets {len(runs) == 4 and all(map(_octet, runs))}", "before " + (_shape(before[0]) if before else ""),
        "word " + (before[0].lower() if before else ""), "after " + (_shape(after[0]) if after else ""),
    ]
    return [zlib.crc32(f.encode()) % SLOTS for f in found]


@dataclass
class Graph:
    """Words of one text: places, features, links ``(a, b, 0: chain or 1: skip)``, the patterns' labels, and which words
    are similar to a labelled one without a label of their own."""

    words: list[tuple[int, int]]
    features: list[list[int]]
    links: list[tuple[int, int, int]]
    labels: list[int]
    unknown: list[bool]


def graph_of(text: str, base: list[tuple[int, int, int]]) -> Graph:
    words = marked_words(text)
    keys = [_key(text[begin:end]) for begin, end in words]
    links, last = [], {}
    for i, key in enumerate(keys):
        if i and not text[words[i - 1][1] : words[i][0]].strip(BLANKS):
            links.append((i - 1, i, 0))
        if key is not None:
            if key in last:  # each to the one before: links grow with the words, not with their square
                links.append((last[key], i, 1))
            last[key] = i
    labels, by_end = [0] * len(words), [w[1] for w in words]
    for kind, begin, end in reversed(base):
        at = int(np.searchsorted(by_end, begin, side="right"))
        while at < len(words) and words[at][0] < end:
            labels[at] = kind + 1
            at += 1
    found = {k for k, label in zip(keys, labels) if label}
    unknown = [k is not None and k in found and not label for k, label in zip(keys, labels)]
    return Graph(words, [_features(text, b, e) for b, e in words], links, labels, unknown)


@dataclass
class Field:
    """``unary``: weight per feature and label; ``pair``: per kind of link and two labels."""

    unary: np.ndarray
    pair: np.ndarray

    @classmethod
    def prior(cls) -> Field:
        """Without training: similar words prefer the same label."""
        return cls(np.zeros((SLOTS, LABELS)), np.stack((np.zeros((LABELS, LABELS)), 2.0 * np.eye(LABELS))))

    def scores(self, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Unary scores of ``n`` words from (feature, word) pairs."""
        return np.stack([np.bincount(owner, self.unary[features, k], n) for k in range(LABELS)], axis=1).astype(float)


def _log_sum(x: np.ndarray, axis) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def pass_messages(unary: np.ndarray, links: np.ndarray, pair: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Log marginals of words, and of both ends of links, by sum-product messages.

    Exact where the links make trees and ``rounds`` reach their length; on cycles damped until they settle.
    """
    n, e = len(unary), len(links)
    source, target = np.concatenate((links[:, 0], links[:, 1])), np.concatenate((links[:, 1], links[:, 0]))
    potential = np.concatenate((pair[links[:, 2]], pair[links[:, 2]].transpose(0, 2, 1)))
    back = np.concatenate((np.arange(e, 2 * e), np.arange(e)))
    messages = np.full((2 * e, LABELS), -np.log(LABELS))

    def heard() -> np.ndarray:
        total = unary.copy()
        np.add.at(total, target, messages)
        return total

    for turn in range(rounds if e else 0):
        new = _log_sum((heard()[source] - messages[back])[:, :, None] + potential, 1)
        new -= _log_sum(new, 1)[:, None]
        change = np.abs(new - messages).max()
        messages = new if turn < 10 else 0.5 * (messages + new)
        if change < 1e-6:
            break
    total = heard()
    beliefs = total - _log_sum(total, 1)[:, None]
    ends = (total[source] - messages[back])[:e, :, None] + (total[target] - messages)[:e, None, :] + potential[:e]
    return beliefs, ends - _log_sum(ends.reshape(e, LABELS**2), 1)[:, None, None] if e else ends


def _flat(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, their words, links and labels of several texts, numbered through."""
    begins = np.cumsum([0] + [len(g.words) for g in graphs])
    rows = [f for g in graphs for f in g.features]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    links = [(a + b, c + b, t) for g, b in zip(graphs, begins.tolist()) for a, c, t in g.links]
    labels = np.array([-1 if u else y for g in graphs for y, u in zip(g.labels, g.unknown)], np.int64)
    return np.array([f for r in rows for f in r], np.int64), owner, np.array(links, np.int64).reshape(-1, 3), labels


def known(unary: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Scores with the given labels held fast; -1 leaves a word free."""
    out, fixed = unary.copy(), np.flatnonzero(labels >= 0)
    out[fixed] += -SURE
    out[fixed, labels[fixed]] += SURE
    return out


def gradient(field: Field, features, owner, links, labels) -> Field:
    """Of the log likelihood of the known labels: counts expected given them less counts expected. -1 is unknown."""
    scores = field.scores(features, owner, len(labels))
    beliefs, ends = pass_messages(scores, links, field.pair)
    given, both = pass_messages(known(scores, labels), links, field.pair)
    gap = np.exp(given) - np.exp(beliefs)
    unary = np.stack([np.bincount(features, gap[owner, k], SLOTS) for k in range(LABELS)], axis=1).astype(float)
    pair = np.zeros((2, LABELS, LABELS))
    np.add.at(pair, links[:, 2], np.exp(both) - np.exp(ends))
    pair[1] = (pair[1] + pair[1].T) / 2  # skip links have no direction
    return Field(unary, pair)


def _sample(docs: DataFrame, text: str, key: str, most: int) -> DataFrame:
    """Texts with marked words, at most ``most`` rows: buckets of a hash of id and text, filled up to that number.

    Rows that are equal share a bucket; one that alone holds more than an eighth is left out.
    """
    hashed = F.xxhash64(F.col(key).cast("string"), F.col(text))
    total = max(1, docs.count())
    rows = docs.select(F.col(text).alias("text"), F.pmod(hashed, F.lit(1 << 40)).alias("h"))
    rows = rows.filter((F.col("h") < int((1 << 40) * min(1.0, 32 * most / total))) & F.col("text").rlike("[0-9@]"))
    rows = rows.select("text", (F.col("h") % 4096).cast("int").alias("bucket"))
    held, chosen = 0, []
    for r in sorted(rows.groupBy("bucket").count().collect(), key=lambda r: r["bucket"]):
        if r["count"] <= max(1, most // 8) and held + r["count"] <= most:
            held += r["count"]
            chosen.append((r["bucket"],))
    buckets = docs.sparkSession.createDataFrame(chosen, "bucket int")
    return rows.join(F.broadcast(buckets), "bucket").select("text")


def fit(
    docs: DataFrame, text: str = "text", key: str = "doc_id", max_rows: int = 20_000, rounds: int = 30, rate: float = 0.5, spread: float = 10.0,
) -> Field:
    """Train on what the patterns find in at most ``max_rows`` texts with marked words.

    Gradients are added up over tasks; ``spread`` is the variance of the weights' Gaussian prior. Without such texts the prior is returned.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            graphs = [graph_of(t, base_spans(t)) for t in batch.column("text").to_pylist()]
            for g in graphs:
                alike = sorted({i for a, b, t in g.links if t for i in (a, b)})
                for i in alike[len(g.words) % 2 :: 2]:
                    g.features[i] = [zlib.crc32(b"hidden") % SLOTS]
            features, owner, links, labels = _flat(graphs)
            arrays = [features.astype(np.int32), owner.astype(np.int32), links.astype(np.int32).ravel(), labels.astype(np.int8)]
            packed = [pa.array([a.tobytes()], pa.binary()) for a in arrays]
            yield pa.RecordBatch.from_arrays(packed, names=["features", "owner", "links", "labels"])

    sample = _sample(docs, text, key, max_rows).mapInArrow(encode, "features binary, owner binary, links binary, labels binary")
    sample = stored(sample, "labelled-words").coalesce(8)
    context = docs.sparkSession.sparkContext
    prior, seen = Field.prior(), None
    field = Field(prior.unary.copy(), prior.pair.copy())
    size = field.unary.size
    for _ in range(rounds):
        sent = context.broadcast((field.unary, field.pair))

        def add(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, total = Field(*sent.value), np.zeros(0)
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("features", "owner", "links", "labels"))):
                    *flat, labels = (np.frombuffer(r, k).astype(np.int64) for r, k in zip(row, ("i4", "i4", "i4", "i1")))
                    if len(labels):
                        g = gradient(now, flat[0], flat[1], flat[2].reshape(-1, 3), labels)
                        part = np.concatenate((g.unary.ravel(), g.pair.ravel(), [len(labels)]))
                        total = total + part if len(total) else part
            if len(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = [np.frombuffer(r["part"]) for r in sample.mapInArrow(add, "part binary").collect()]
        sent.destroy()
        if not parts:
            return prior
        total = np.sum(parts, axis=0)
        weights = np.concatenate((field.unary.ravel(), field.pair.ravel()))
        home = np.concatenate((prior.unary.ravel(), prior.pair.ravel()))
        g = total[:-1] / total[-1] - (weights - home) / (spread * total[-1])
        seen = g * g if seen is None else seen + g * g
        weights = weights + rate * g / np.sqrt(seen + 1e-12)
        field = Field(weights[:size].reshape(SLOTS, LABELS), weights[size:].reshape(2, LABELS, LABELS))
    return field


def _added(graph: Graph, beliefs: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Adjacent words of one kind that no pattern covers, as spans; one of them is similar to a word that a pattern found."""
    chained = {b for _, b, t in graph.links if not t}
    out, sure, before = [], [], None
    for i, (begin, end) in enumerate(graph.words):
        kind = int(beliefs[i].argmax())
        if graph.labels[i] or not kind or beliefs[i, kind] < np.log(least):
            before = None
            continue
        if before == kind and i in chained:
            out[-1] = out[-1][0], out[-1][1], end
            sure[-1] |= graph.unknown[i]
        else:
            out.append((kind - 1, begin, end))
            sure.append(graph.unknown[i])
        before = kind
    return [s for s, known_word in zip(out, sure) if known_word]


def find(docs: DataFrame, field: Field, text: str = "text", least: float = 0.9, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row and ``found``: spans of ``kind, start, end, base``.

    ``start`` and ``end`` count code points of the whole text. Spans of the patterns (``base``) always stay; words that
    the field labels with a marginal of at least ``least`` are added where no pattern's span lies and one of
    them is similar to a word that a pattern found, so a text without such a span stays without any. Spans are
    ordered by kind, start and end. A null, empty or unmarked text has none; repeated rows are
    treated each for itself; an input column named ``found`` gives way. Nothing is shuffled; a text must fit a task.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "found"]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    sent = docs.sparkSession.sparkContext.broadcast((field.unary, field.pair))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*sent.value)
        for batch in chunks(batches, "__text"):
            column = batch.column("__text")
            rows = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_numpy(zero_copy_only=False))
            texts = column.take(pa.array(rows)).to_pylist()
            base = [base_spans(t) for t in texts]
            graphs = [graph_of(t, b) for t, b in zip(texts, base)]
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            features, owner, links, labels = _flat(graphs)
            unary = model.scores(features, owner, len(labels))
            found_labels = np.where(labels > 0, labels, -1)  # what a pattern found is known, all else is asked
            beliefs = pass_messages(known(unary, found_labels), links, model.pair)[0]
            at = 0
            for row, graph, own in zip(rows.tolist(), graphs, base):
                more = _added(graph, beliefs[at : at + len(graph.words)], least)
                at += len(graph.words)
                spans = sorted([(*s, True) for s in own] + [(*s, False) for s in more])
                found[row] = [{"kind": KINDS[k], "start": b, "end": e, "base": own} for k, b, e, own in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(span))], names=[*keep, "found"])

    schema = f"{fields}found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(search, schema)


def without(found: DataFrame, text: str = "text", mark: str = "<{}>") -> DataFrame:
    """Each found span replaced by a mark with its kind; of spans that overlap, the first in order of start. Null stays null."""
    names = [c for c in found.columns if c != "found"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(batch.column(text).to_pylist(), batch.column("found").to_pylist()):
                parts, at = [], 0
                for s in sorted(spans or (), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [body[at : s["start"]], mark.format(s["kind"])]
                        at = s["end"]
                    elif s["end"] > at:  # the rest of an overlapping span goes with the first
                        at = s["end"]
                out.append(body if body is None else "".join([*parts, body[at:]]))
            columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(cut, found.select(*names).schema)


portable(__name__)
