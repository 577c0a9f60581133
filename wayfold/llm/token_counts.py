"""Token counts of whole texts under a sentencepiece model, by a map-side two-tier lookup.

A text is cut where no piece of the model can reach across: before every run of spaces and around line feeds that the
model has no piece for. The units' lengths are additive. Lengths of the most frequent units of a bounded sample are
broadcast as a hash table; each worker encodes the units that the table misses once and keeps them in a bounded cache.
No unit is ever shuffled: the sample's texts, SAMPLE at most, are counted by one task. The sample decides only how often a worker
has to encode, never a count.

Null texts count as empty (0 tokens). Units too long to repeat are encoded without being kept. Texts with characters
that the cut can't be proven for (the space mark itself, NUL, white space other than space and line feed, or any
character beyond the basic plane's ordinary text that the model's normaliser may change) are encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampled documents (bound), entries of the broadcast table, entries of a worker's cache, longest unit that is kept.
SAMPLE, TABLE, CACHE, LONGEST = 2000, 65_536, 400_000, 48
_MARK = "▁"
_ODD = re.compile("[▁\u0000\t\u000b-\u001f]")
_UNITS = re.compile(r"\n| *[^ \n]+| +")


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def cuts_allowed(model) -> bool:
    """Whether no piece holds a space mark after another character, nor a line feed, and spaces stand as they are."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    plain = all(not re.search(f"[^{_MARK}]{_MARK}", p) and "\n" not in p for p in pieces)
    return plain and len(model.encode("a  b")) > len(model.encode("a b")) and model.encode("\n") != model.encode("")


class _Lengths(dict):
    """Unit -> number of pieces; a miss is encoded, and kept while there is room."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__(frequent)
        self.frequent, self.model = frequent, model
        # a unit is encoded behind a line feed, so that the model adds no space mark of its own; what stands before it is taken off
        self.base = len(model.encode("\n"))

    def __missing__(self, unit: str) -> int:
        n = len(self.model.encode("\n" + unit)) - self.base if unit else 0
        if len(unit) <= LONGEST:
            if len(self) > len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[unit] = n
        return n


def units(text: str) -> list[str]:
    """The text's units; joined they are the text with the space that the model puts before it."""
    text = " " + text
    if "  " in text or " \n" in text or text[-1] == " ":
        return _UNITS.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            if t and not _ODD.search(t):
                seen.update(u for u in units(t) if 0 < len(u) <= LONGEST)
            if len(seen) > 4 * TABLE:
                seen = Counter(dict(seen.most_common(TABLE)))
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in seen.most_common(TABLE)], pa.string())], ["unit"])


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row for each row."""
    spark = docs.sparkSession
    every = max(1, docs.count() // SAMPLE)
    # the limit holds where a repeated id would pick all rows, and brings the sample into one task
    top = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(every)) == 0).select("text").limit(SAMPLE).mapInArrow(_frequent, "unit string")
    model = _model(model_path)
    cut = cuts_allowed(model)
    lengths = _Lengths(model, {})
    frequent = spark.sparkContext.broadcast({r[0]: lengths[r[0]] for r in top.collect()} if cut else {})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        known = _Lengths(model, frequent.value)
        length = known.__getitem__
        for b in batches:
            n, size = [], []
            for t in (v.as_py() for v in b.column(1)):
                if not t:
                    n.append(0)
                    size.append(0)
                    continue
                size.append(len(t.encode()))
                n.append(sum(map(length, units(t))) if cut and not _ODD.search(t) else len(model.encode(t)))
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), n, pa.array([x > limit for x in n.to_pylist()], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
