"""Token ids of byte-level vocabularies, and token counts of documents.

``Encoder`` gives the ids that the ``tokenizers`` library gives for a vocabulary file. Texts of plain
Latin characters take a faster way through ``tiktoken`` with the same merges; there the two
libraries' character classes cannot differ. Every other text goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import chunks, most_frequent, portable, stored

#: The split pattern of byte-level vocabularies, and the byte alphabet's printable bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

_UNSURE = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]")


class Encoder:
    """Ids of texts without added special tokens; special strings inside texts count as one id."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(vocabulary)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.fast, self.cuts = None, False
        spec = json.loads(vocabulary)
        if self._plain(spec):
            rest = [b for b in range(256) if b not in PRINTABLE]
            letters = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.cuts = all(re.fullmatch(r"<[^\s.,;:!?]+", t) for t in special)
            self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Whether ids are ranks of byte merges split by the one pattern, with special tokens taken as they stand."""
        split = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        return (
            model.get("type") == "BPE"
            and not spec.get("normalizer")
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(not any(t[k] for k in ("single_word", "lstrip", "rstrip")) for t in spec["added_tokens"])
            and all(model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] == 256 + i for i, m in enumerate(model["merges"]))
        )

    def pieces(self, text: str) -> list[str]:
        """Cut a text so that its ids are those of the pieces, in order; whole where that is not sure."""
        return CUT.split(text) if self.cuts else [text]

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not _UNSURE.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


#: Cuts that every split of PATTERN makes too, so that the ids of a text are those of its pieces:
#: before a blank that a plain character follows, and between a letter and a stop before a blank.
#: None is at the begin of a special string, which starts with ``<`` (see ``Encoder.pieces``).
CUT = re.compile("(?=[ \n\t][!-;=-~\u00c0-\u024f])|(?<=[A-Za-z])(?=[.,;:!?](?:[ \n]|$))")
LONGEST = 64  # characters of a piece that is shared between documents


def _frequent(docs: DataFrame, vocabulary: str, often: int, most: int) -> list[tuple[str, int]]:
    """Pre-tokens found ``often`` times in some chunk of texts, the most frequent, each with its count of ids."""

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in chunks(batches, "text"):
            found: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                found.update(encoder.pieces(text or ""))
            rows = [(p, n) for p, n in found.items() if n >= often and len(p) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["piece", "times"])

    found = docs.select("text").mapInArrow(gather, "piece string, times bigint").groupBy("piece").agg(F.sum("times").alias("times"))
    head = most_frequent(stored(found, "frequent-pieces"), "times", most).select("piece")
    return [tuple(r) for r in _counted(head, vocabulary, "piece string, n bigint").collect()]


def _counted(pieces: DataFrame, vocabulary: str, schema: str) -> DataFrame:
    """Replace ``piece`` by, or add to it, its count of ids ``n``; equal neighbours are counted once."""
    sent = pieces.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f.split()[0] for f in schema.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        last, n = None, 0
        for batch in batches:
            column = batch.column("piece").dictionary_encode()
            counts = []
            for piece in column.dictionary.to_pylist():
                if piece != last:
                    last, n = piece, len(encoder.ids(piece))
                counts.append(n)
            each = np.array(counts, np.int64)[column.indices.to_numpy(zero_copy_only=False)] if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(each) if c == "n" else batch.column(c) for c in names], names=names)

    return pieces.mapInArrow(count, schema)


def count_tokens(
    docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", most: int = 300_000, often: int = 3
) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens`` of the whole text; a null or empty text has none.

    Pre-tokens (runs that every split of the vocabulary's pattern cuts off) are counted once each.
    The ``most`` frequent ones, of ``LONGEST`` characters at most, are broadcast with their counts and
    joined to each document's pre-token frequencies in place. All others go with their frequencies to
    the task of their pre-token, are counted there once, and only the counts come back. A longer
    pre-token is counted where it stands, as it is as large as a document.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, dict(_frequent(rows, vocabulary, often, most))))
    rest_type = pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = sent.value
        encoder = Encoder(words)
        row = TaskContext.get().partitionId() << 40
        for batch in chunks(batches, "text", 8 << 20):
            sums, sizes, rest = [], [], []
            for body in batch.column("text").to_pylist():
                total, others = 0, []
                for piece, times in Counter(encoder.pieces(body or "")).items():
                    n = known.get(piece)
                    if n is not None:
                        total += n * times
                    elif len(piece) > LONGEST:
                        total += len(encoder.ids(piece)) * times
                    elif piece:
                        others.append({"piece": piece, "times": times})
                sums.append(total)
                sizes.append(len((body or "").encode()))
                rest.append(others)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(sums)), pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()), pa.array(rest, rest_type),
                ],
                names=["row", "doc_id", "n_bytes", "sum", "rest"],
            )
            row += len(sums)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n_bytes bigint, sum bigint, rest array<struct<piece:string,times:bigint>>"
    parts = stored(rows.mapInArrow(split, schema), "document-pieces", "zstd")
    rest = parts.select("row", F.explode("rest").alias("r")).select("row", "r.piece", "r.times")
    met = _counted(rest.repartition("piece").sortWithinPartitions("piece"), vocabulary, "row bigint, times bigint, n bigint")
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"))
    joined = parts.drop("rest").join(sums, "row", "left")
    return joined.select("doc_id", "n_bytes", (F.col("sum") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


portable(__name__)
