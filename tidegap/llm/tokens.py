"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries: before white space that follows something else, where
no token of the vocabulary's pre-tokenizer can reach across. Texts make batches of about
equal bytes; the distinct segments of a batch that aren't known yet are encoded as one batch
by the vocabulary's own library, of which only the lengths are kept.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidegap.llm.common import byte_groups, small_batches, trimmed

#: Bytes of a batch; segments whose token counts a worker remembers, and the longest of them.
BATCH_BYTES = 1 << 20
KNOWN, KNOWN_LENGTH = 150_000, 100
LIMIT = 512

# Code points with the Unicode property White_Space.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITE = "".join(map(chr, SPACES))
#: Leading white space and what follows it; white space alone only at a text's end.
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def segments(text: str) -> list[str]:
    """A text cut at its safe boundaries."""
    return SEGMENT.findall(text)


class Counter:
    """Token counts of texts by a tokenizer file of the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Counts in order."""
        split = [segments(t) for t in texts]
        new = set().union(*split)
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
        fresh = [s for s in new if s not in self.known]
        codes = self.library.encode_batch_fast(fresh, add_special_tokens=False)
        self.known.update(zip(fresh, map(len, codes), strict=True))
        counts = [sum(map(self.known.__getitem__, s)) for s in split]
        for s in fresh:
            if len(s) > KNOWN_LENGTH:
                del self.known[s]
        return counts


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``tokenizer`` is the path of a tokenizer file that executors have. Counts are the
    library's own, without added special tokens, truncation or padding; a special string
    inside a text is one token, as is its default. A null text counts as empty. Rows are
    independent; other columns are ignored; an empty table gives no rows. A very long text
    is a batch of its own, in some 13 bytes of memory a byte (measured on 5 MB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(tokenizer) or _counters.setdefault(tokenizer, Counter(tokenizer))
        for batch in batches:
            for at, to in byte_groups(batch.column(1), BATCH_BYTES):
                part = batch.slice(at, to - at)
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = pa.array(counter.count(texts), pa.int64())
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, tokens, pa.array([n > limit for n in tokens.to_pylist()], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
