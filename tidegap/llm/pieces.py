"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Texts are cut into marked words, where no piece can reach across. Distinct words are
sorted into a trie that is walked depth first, on a stack of forward states: a word
starts from the states of the prefix that it shares with the word before it.

The model is a BPE one, whose encoding is not the path of the largest sum of scores. It
is the only path in which every two neighbouring pieces stay apart when merged on their
own (a merge across a boundary would show in that pair), and a prefix of the encoding is
the encoding of that prefix. So a forward state is the last piece of the one valid path
that ends there, with its start as back pointer; the pair test replaces the sum.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegap.llm.common import byte_groups, columns, plain, small_batches, trimmed

MARK = "▁"
#: Bytes of text at a time; words and tested pairs that a worker keeps.
GROUP_BYTES = 4 << 20
CACHE = 300_000
PAIRS = 700_000
PUNCTUATION = ",.!?;:\"')]}|"
_NONE = -1


class Pieces:
    """Encoder and decoder of one BPE model with byte fallback and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        names = [sp.id_to_piece(i) for i in range(size)]
        self.ids = {n: i for i, n in enumerate(names) if not special[i]}
        self.score = {n: sp.get_score(i) for n, i in self.ids.items()}
        self.names = names
        self.ending: dict = {}  # pieces by their characters from the last to the first
        for n, i in self.ids.items():
            node = self.ending
            for c in reversed(n):
                node = node.setdefault(c, {})
            node[""] = i
        self.byte_id = {int(n[3:5], 16): i for i, n in enumerate(names) if sp.is_byte(i)}
        of_byte = {i: b for b, i in self.byte_id.items()}
        self.raw = [bytes([of_byte[i]]) if i in of_byte else b"" if special[i] else n.encode("utf-8") for i, n in enumerate(names)]
        if any(MARK in n.lstrip(MARK) for n in self.ids) or any("\n" in n for n in self.ids):
            raise ValueError("pieces of this model cross word boundaries")
        self.word = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        # no piece holds a letter and then one of these, so a word may be cut there
        signs = [c for c in PUNCTUATION if not any(c in n and re.search(rf"[^\W\d_]{re.escape(c)}", n) for n in self.ids)]
        self.stem = re.compile(f"({MARK}*[^\\W\\d_]+)(?=[{re.escape(''.join(signs))}])" if signs else "(?!)")
        self.known: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stays_apart(self, a: int, b: int) -> bool:
        x, y = self.names[a], self.names[b]
        return self.merge(x + y) == [x, y]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as 32-bit integers; cut ones are put together."""
        cut: dict[str, tuple[str, str]] = {}
        for w in words:
            if m := self.stem.match(w):
                cut[w] = w[: m.end()], w[m.end() :]
        parts = {w for w in words if w not in cut}
        parts.update(*cut.values())
        codes = self._walk(sorted(parts))
        codes.update([(w, codes[a] + codes[b]) for w, (a, b) in cut.items()])
        return codes

    def _walk(self, words: list[str]) -> dict[str, bytes]:
        """Ids of sorted distinct words: the depth-first walk over their trie."""
        ending, apart, alone = self.ending, self.apart, self.alone
        last, start = [_NONE], [0]  # forward states of the current prefix
        out, before = {}, ""
        for word in words:
            n, keep = len(word), 0
            top = min(n, len(before))
            while keep < top and word[keep] == before[keep]:
                keep += 1
            del last[keep + 1 :], start[keep + 1 :]
            for end in range(keep + 1, n + 1):
                node, at = ending, end
                while at:
                    at -= 1
                    node = node.get(word[at])
                    if node is None:
                        at = -1
                        break
                    piece = node.get("")
                    if piece is None:
                        continue
                    prev = last[at]
                    if prev < 0:  # the word's start or a character outside the vocabulary
                        ok = alone.get(piece)
                        if ok is None:
                            ok = alone[piece] = self.merge(word[at:end]) == [word[at:end]]
                    else:
                        pair = prev << 32 | piece
                        ok = apart.get(pair)
                        if ok is None:
                            ok = apart[pair] = self._stays_apart(prev, piece)
                    if ok:
                        last.append(piece)
                        start.append(at)
                        break
                else:
                    at = -1
                if at < 0:
                    last.append(_NONE)
                    start.append(end - 1)
            ids, end = [], n
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                else:
                    ids.extend(self.byte_id[b] for b in reversed(word[end - 1].encode("utf-8", "surrogatepass")))
                end = start[end]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
            before = word
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit integers."""
        split = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen: set[str] = set()
        seen.update(*split)
        if len(self.known) + len(seen) > CACHE:
            self.known.clear()
        if len(self.apart) > PAIRS:
            self.apart.clear()
        self.known.update(self.encode_words(sorted(seen - self.known.keys())))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of 32-bit ids."""
        data = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        text = data.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_models: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    return _models.get(path) or _models.setdefault(path, Pieces(path))


def _forget() -> None:
    """Words aren't kept between tasks; the tested pairs of pieces are of use to any text."""
    for p in _models.values():
        p.known = {}


def _carried(docs: DataFrame, keep: tuple[str, ...]) -> T.StructType:
    return T.StructType([docs.schema[n] for n in keep])


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The columns ``keep``, tokens (array<int>, if ``ids``), n_tokens, tokens_crc and
    round_trip for every row.

    Tokens are the library's for ``model``, without begin and end. tokens_crc is the
    CRC-32 of the tokens as little-endian 32-bit integers; round_trip says whether they
    decode to the text (a literal marker character comes back as a space). Null and
    empty texts have no tokens. Rows are independent; an empty table gives no rows. Columns
    that aren't kept are ignored, whatever their names; kept ones may not have a result's
    name. A very long text is encoded at once, in some 30 bytes of memory a byte (measured on 5 MB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _model(model)
        for batch in batches:
            for lo, hi in byte_groups(batch.column(batch.num_columns - 1), GROUP_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                codes = p.encode(texts)
                ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
                made = [
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([zlib.crc32(c) for c in codes], pa.int64()),
                    pa.array([p.decode(c) == t.replace(MARK, " ") for c, t in zip(codes, texts, strict=True)], pa.bool_()),
                ]
                if ids:
                    flat = pa.array(np.frombuffer(b"".join(codes), np.int32))
                    made.insert(0, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*keep, *(["tokens"] if ids else []), "n_tokens", "tokens_crc", "round_trip"])

    small_batches(docs.sparkSession)
    schema = _carried(docs, keep)
    if ids:
        schema.add("tokens", T.ArrayType(T.IntegerType()))
    schema.add("n_tokens", "long").add("tokens_crc", "long").add("round_trip", "boolean")
    return plain(docs.select(*columns([*keep, "text"]))).mapInArrow(trimmed(run, _forget), schema)


def decode(tokens: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (not ``text``) and the decoded text of a tokens column (null:
    null). Other columns are ignored, rows are independent, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _model(model)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if r is None else p.decode(array("i", r).tobytes()) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    small_batches(tokens.sparkSession)
    return plain(tokens.select(*columns([*keep, "tokens"]))).mapInArrow(trimmed(run), _carried(tokens, keep).add("text", "string"))
