"""SentencePiece encoding and decoding (operator 2), equal to the library's results for merge-type (BPE) models.

Encoding. Merging adjacent pieces by score leaves one token sequence: the one in which every token is what its own
text merges to, and every two adjacent tokens stay apart when the text of both is merged alone. So a text is encoded
from left to right by backtracking: an Aho-Corasick automaton over the pieces gives the longest piece at each place;
the next token must be compatible with the one before it, which is checked by merging both texts again, once for each
pair of tokens; if no piece that starts at a place is compatible, the last token gives way to its next shorter one.
A bit for each place says that no sequence of tokens ends there, so no place is tried twice and time stays linear.

No piece holds a space mark after another character, so no merge crosses from a word to the space before the next one.
A text is cut there, and at line ends that no piece holds; whatever comes between is encoded once and kept in a memory
of bounded size.

Files are read on the executors from ``model``, a path that each of them has.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SPACE = "▁"
#: Words that a worker remembers are at most twice so many, and pairs of tokens.
WORDS, PAIRS = 200_000, 400_000
#: Longer words are encoded anew each time.
WORD_CHARS = 64
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Codec:
    """One model. ``encode`` gives ids without a start id; ``decode`` takes any ids."""

    def __init__(self, model: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError(f"{model} is not a plain merge-type model")
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.chars = {x for x in self.id if len(x) == 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.end = pieces.index("</s>")
        self.fallback = proto.trainer_spec.byte_fallback
        if any(SPACE in x.lstrip(SPACE) for x in self.id):
            raise ValueError("a piece holds a space mark after another character")
        #: What a text is cut into: space marks with the characters up to the next one, or a line end.
        self.cut = re.compile(" +|\n| *[^ \n]+" if "\n" in "".join(self.id) else " *[^ \n]+|\n| +")
        self.whole = "\n" in "".join(self.id)
        self.text = pieces
        trie = ahocorasick.Automaton()
        for x, i in self.id.items():
            trie.add_word(x, (len(x), i))
        trie.make_automaton()
        self.find = trie.iter
        # longest piece that is a proper prefix of each piece, and whether its own text merges to it
        self.shorter = {i: next((self.id[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in self.id), -1) for x, i in self.id.items()}
        self.own = {i: self._merge(x) == [x] for x, i in self.id.items()}
        self.surface = [self._surface(p) for p in proto.pieces]
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _surface(p) -> str:
        if p.type == BYTE:
            value = int(p.piece[3:5], 16)
            return chr(value) if value < 128 else chr(0xDC00 + value)
        return {UNKNOWN: " ⁇ ", CONTROL: ""}.get(p.type, p.piece.replace(SPACE, " "))

    def _merge(self, text: str) -> list[str]:
        """Merges adjacent parts, best score first and leftmost of equals, until none is a piece."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self.pairs[key] = self._merge(x + y) == [x, y]
        return known

    def _known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        longest: list[int] = [-1] * len(text)
        for last, (n, i) in self.find(text):
            longest[last - n + 1] = i
        own, size, shorter, compatible = self.own, self.text, self.shorter, self.compatible
        failed = bytearray(len(text) // 8 + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            while token >= 0:
                to = at + len(size[token])
                if not failed[to >> 3] >> (to & 7) & 1 and own[token] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at] if at < len(text) else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(size[last])
                token = shorter[last]
        return out

    def word(self, text: str) -> tuple[int, ...]:
        if self.chars.issuperset(text):
            return tuple(self._known(text))
        ids: list[int] = []
        run = 0
        for i, ch in enumerate(text):  # a character that is no piece merges with nothing
            if ch not in self.id:
                if run < i:
                    ids += self._known(text[run:i])
                ids += [self.byte[b] for b in ch.encode()] if self.fallback else [self.unk]
                run = i + 1
        if run < len(text):
            ids += self._known(text[run:])
        return tuple(ids)

    def _learn(self, word: str) -> tuple[int, ...]:
        found = self.old.get(word)
        if found is None:
            found = self.word(word.replace(" ", SPACE))
        if len(word) <= WORD_CHARS:
            if len(self.young) >= WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        text = f" {text}" if self.dummy else text
        words = [text] if self.whole else self.cut.findall(text)
        found = list(map(self.young.get, words))
        if None in found:
            found = [self._learn(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        out = "".join(map(self.surface.__getitem__, ids))
        if self.dummy:
            first = next((i for i in ids if self.surface[i]), None)
            if first is not None and self.text[first].startswith(SPACE):
                out = out[1:]
        if not out.isascii() and _BYTES.search(out):
            out = _BYTES.sub(lambda m: _from_bytes(bytes(ord(c) - 0xDC00 for c in m[0])), out)
        return out


_BYTES = re.compile("[\udc80-\udcff]+")


def _from_bytes(data: bytes) -> str:
    """UTF-8, where each byte that is part of no character becomes a replacement character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), "�"]
            data = data[e.start + 1 :]
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """Adds ``ids``, array<int>: the ids of ``text``, and an end id. A null text counts as empty. Other columns stay, but
    for one that is named like ``ids``."""
    docs = C.without(docs, ids)

    def run(batches):
        c = codec(model)
        for whole in batches:
            for batch in C.slices(whole, text):
                got = [[*c.encode(x or ""), c.end] if end else c.encode(x or "") for x in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int32()))], names=[*batch.schema.names, ids])

    return docs.mapInArrow(C.lean(run), C.schema_with(docs, f"`{ids}` array<int>"))


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``, the text of ``ids``; null ids give an empty text. Other columns stay, but for one that is named like
    ``text``."""
    docs = C.without(docs, text)

    def run(batches):
        c = codec(model)
        for batch in batches:
            got = [c.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, text])

    return docs.mapInArrow(C.lean(run), C.schema_with(docs, f"`{text}` string"))


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded with an end id, and its ids decoded.

    Ids stay in the worker: only digests leave it. A null or empty text has the end id alone. Rows are independent, so
    repeated rows give repeated results and a null doc_id stays null. Other columns are not read.
    """

    def run(batches):
        c = codec(model)
        name = [str(i) for i in range(len(c.text))]
        for whole in batches:
            for batch in C.slices(whole, "text"):
                n, of_ids, of_text = [], [], []
                for x in batch.column("text").to_pylist():
                    got = [*c.encode(x or ""), c.end]
                    n.append(len(got))
                    of_ids.append(hashlib.sha256(" ".join(map(name.__getitem__, got)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(c.decode(got).encode()).hexdigest())
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return round_trip_digests(C.documents(spark, sf_dir), model)
