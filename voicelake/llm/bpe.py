"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece there is one token that its encoding ends with.
An automaton over the vocabulary yields the tokens that are a suffix of the
prefix; the one that may stand beside the last token of the prefix before it
(a pair of tokens is compatible if merging its bytes gives that pair again) is
stored, and following the stored tokens back from the end gives the ids. Time
is linear in the text for any piece length.

Texts are first cut at special tokens, then into pieces by the vocabulary's
pattern. Pieces repeat, so each Python worker keeps those it has solved, up to
a bound. Whole texts are processed; rows never meet, so there is no shuffle.

A vocabulary file whose settings ask for anything else (a normalizer, another
cutting rule, tokens that strip blanks, bytes without a token) is refused.

Defined results: a null text is empty and has no ids; bytes that decode to
invalid UTF-8 become U+FFFD; repeated rows and empty tables need no care;
columns of the input other than doc_id are not carried by the report.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pattern that the byte-level vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Solved pieces that a worker keeps (some 70 MB).
KEPT_PIECES = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself, or the next code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(shifted)}


def refuse_unhandled(spec: dict) -> None:
    """Raises ValueError for settings of a vocabulary file that the encoder doesn't follow."""
    model, cut, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    faults = [f"model.{name}" for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(name)]
    faults += ["model.type"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * bool(spec.get("normalizer"))
    faults += ["pre_tokenizer"] * (cut.get("type") != "ByteLevel" or bool(cut.get("add_prefix_space", True)) or not cut.get("use_regex", True))
    faults += ["decoder"] * (decoder.get("type") != "ByteLevel")
    faults += [f"added token {t['content']}" for t in spec["added_tokens"] if not t["content"] or any(t.get(flag) for flag in ("single_word", "lstrip", "rstrip"))]
    faults += ["model.vocab: bytes without a token"] * (not byte_alphabet().keys() <= model["vocab"].keys())
    if faults:
        raise ValueError(f"vocabulary settings that are not handled: {', '.join(faults)}")


class Vocabulary:
    """Tokens, merges and the suffix automaton of one vocabulary file."""

    def __init__(self, source: str):
        import ahocorasick

        spec = json.loads(source)
        refuse_unhandled(spec)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in ids.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.rank[pair] = rank
            self.parts.setdefault(whole, pair)
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if t not in self.special and self.stable(i):
                self.automaton.add_word(raw(t).decode("latin-1"), (len(raw(t)), i))
        self.automaton.make_automaton()
        self._compatible: dict[tuple[int, int], bool] = {}

    def stable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.bytes_of[token]) == 1 if token not in self.parts else not self._crossed(*self.parts[token], own=True)

    def _built(self, token: int) -> int:
        return self.rank[self.parts[token]] if token in self.parts else -1

    def _crossed(self, left: int, right: int, own: bool = False) -> bool:
        """Whether merging the bytes of two tokens merges across their joint.

        Goes back in time: undoes the later of both last merges and looks at the
        two tokens that then met at the joint. They merge if their rank comes
        before either is used up; of equal ranks the leftmost merge comes first.
        own: the tokens' direct merge is allowed.
        """
        until_left = until_right = len(self.rank)
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and not own and rank < until_left and rank <= until_right:
                return True
            own = False
            left_built, right_built = self._built(left), self._built(right)
            if left_built < 0 and right_built < 0:
                return False
            if left_built > right_built:
                until_left, left = left_built, self.parts[left][1]
            else:
                until_right, right = right_built, self.parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= 4 * KEPT_PIECES:
                self._compatible.clear()
            known = self._compatible[key] = not self._crossed(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        last: list[int] = [-1] * (len(piece) + 1)
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - size
            if last[end + 1] < 0 and (start == 0 or (last[start] >= 0 and self.compatible(last[start], token))):
                last[end + 1] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]


class PieceCodes(dict):
    """piece -> its ids as little-endian 32-bit integers; solves what it lacks."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.encode_piece(piece.encode())
        code = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = code
        return code


class Codec:
    def __init__(self, source: str):
        import regex

        self.vocabulary = Vocabulary(source)
        self.codes = PieceCodes(self.vocabulary)
        self.pieces = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.vocabulary.special, key=len, reverse=True)) + ")").split if self.vocabulary.special else None

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not any(t in text for t in self.vocabulary.special):
            return b"".join(map(self.codes.__getitem__, self.pieces(text)))
        out = []
        for part in self.at_special(text):
            own = self.vocabulary.special.get(part)
            out.append(own.to_bytes(4, "little") if own is not None else b"".join(map(self.codes.__getitem__, self.pieces(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(source: str) -> Codec:
    """One codec a Python worker."""
    return Codec(source)


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and the ids of every text, as array<int>."""
    return _mapped(docs, vocabulary_path, "doc_id long, ids array<int>", lambda c, text: (list(memoryview(c.encode(text)).cast("I")),))


def token_report(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and the SHA-256 of the text that the ids decode to."""

    def digest(c: Codec, text: str) -> tuple:
        ids = c.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()

    return _mapped(docs, vocabulary_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(docs: DataFrame, vocabulary_path: str, schema: str, each) -> DataFrame:
    with open(vocabulary_path, encoding="utf-8") as file:  # a vocabulary is a few MB, whatever the corpus
        text = file.read()
    refuse_unhandled(json.loads(text))
    source = docs.sparkSession.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(source.value)
        for batch in batches:
            rows = [each(own, text or "") for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([r[k] for r in rows], type=arrow.types[k + 1]) for k in range(len(arrow) - 1))]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, schema)


def vocabulary_file() -> str:
    """Where the public vocabulary lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark, sf_dir):
    return token_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_file())
