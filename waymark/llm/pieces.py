"""Operator 10: SentencePiece BPE ids by exact backtracking, and decoding.

The greedy choice at each position is the longest piece (found with an Aho-Corasick automaton).  A piece may
follow another only if merging the two texts by the model's merge order gives exactly these two pieces back.
If no piece fits, the last one is taken back and a shorter one tried; a bit per position records the positions
from which the rest can't be reached, so none is tried twice.  The one sequence whose neighbours are all
compatible is what the merge procedure makes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, table, texts

SPACE = "▁"
CACHE_WORDS = 400_000
CACHE_PAIRS = 400_000
#: Longer words, as whole lines of scripts without spaces are, aren't remembered: a table entry stays small.
LONGEST = 64


class PieceCodec:
    """Encode and decode with a BPE model that has byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # its vocabulary only; it encodes nothing here
        self.piece = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.hidden = {i for i in range(len(self.piece)) if model.is_control(i)}
        self.unknown = model.unk_id()
        plain = [i for i in range(len(self.piece)) if i not in self.byte_of and i not in self.hidden and i != self.unknown]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece holds a space after another character: texts can't be cut at words")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1 and self.merged(p) == [p]:  # else the merge procedure can never make it
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself, for the short texts that the compatibility checks compare."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def split(self, text: str) -> list[str]:
        """Pieces of ``text``; characters without a piece stand alone."""
        n = len(text)
        longest = list(text)  # of each position, the longest piece from there
        for end, (back, p) in self.automaton.iter(text):
            longest[end - back] = p  # ends only grow
        failed = 0  # bit i: the text from position i on can't be finished
        out: list[str] = []
        at, p, last = 0, longest[0], ""
        pairs = self.pairs
        while at < n:
            while p:
                if not failed >> (at + len(p)) & 1 and (not last or pairs.get((last, p)) or self.compatible(last, p)):
                    break
                p = self.shorter(p)
            if p:
                out.append(p)
                last = p
                at += len(p)
                if at < n:
                    p = longest[at]
            else:
                if not out:
                    raise ValueError("no sequence of compatible pieces")
                failed |= 1 << at
                p = out.pop()
                at -= len(p)
                p = self.shorter(p)
                last = out[-1] if out else ""
        return out

    def shorter(self, p: str) -> str:
        """The next shorter piece that begins ``p``; its first character always counts as one."""
        for k in range(len(p) - 1, 1, -1):
            if p[:k] in self.automaton:
                return p[:k]
        return p[0] if len(p) > 1 else ""

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_id[b] for b in p.encode()]
        return out

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut before each space mark that follows another character; no merge crosses such a cut."""
        words = text.replace(SPACE, " ").split(" ")
        out, marks = [], SPACE
        for w in words[:-1]:
            if w:
                out.append(marks + w)
                marks = SPACE
            else:
                marks += SPACE
        out.append(marks + words[-1])
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, runs of byte pieces read as UTF-8 (bad bytes: U+FFFD), the dummy prefix dropped."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.hidden:
                p = self.piece[i]
                out.append((p[1:] if not out and p[0] == SPACE else p).replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def coded(self, chunk: str, key: str) -> tuple[str, str | None]:
        """Ids of a chunk, joined by commas, and its decoded text if that isn't a space and ``key``."""
        pieces, known = self.split(chunk), self.id
        try:
            ids = ",".join([str(known[p]) for p in pieces])
            text = "".join(pieces).replace(SPACE, " ")
        except KeyError:
            numbers = self.ids(pieces)
            ids = ",".join(map(str, numbers))
            # decode() drops one mark at the start of a text; behind a piece that has none it drops nothing
            text = self.decode([self.id["a"], *numbers])[1:]
        return ids, None if text == " " + key else text

    def report(self, text: str) -> tuple[int, str, str]:
        """Number of ids, decimal ids joined by commas, decoded text."""
        if not text:
            return 0, "", ""
        words = text.split(" ")
        if "" in words or SPACE in text:
            words = self.chunks(text)  # keys that begin with a mark; no word of the other kind does
        ids_of, text_of = self.ids_of, self.text_of
        new = set(words).difference(ids_of)
        if new:
            if len(ids_of) + len(new) > CACHE_WORDS:
                ids_of.clear()
                text_of.clear()
                new = set(words)
            long = {w for w in new if len(w) > LONGEST}
            for w in new - long:
                ids_of[w], other = self.coded(w if w[0] == SPACE else SPACE + w, w)
                if other is not None:
                    text_of[w] = other
            if long:
                got = {w: self.coded(w if w[0] == SPACE else SPACE + w, w) for w in long}
                ids_of = {w: got[w][0] if w in got else ids_of[w] for w in set(words)}
                text_of = {w: got[w][1] if w in got else text_of.get(w) for w in ids_of}
                text_of = {w: x for w, x in text_of.items() if x is not None}
        ids = ",".join(map(ids_of.__getitem__, words))
        if text_of.keys().isdisjoint(words):  # each word's ids decode to a space and the word
            decoded = " ".join(words)
        else:
            decoded = "".join([text_of.get(w) or " " + w for w in words])
            decoded = decoded[1:] if decoded[:1] == " " else decoded
        return ids.count(",") + 1, ids, decoded

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.ids(self.split(c))] if text else []


@functools.lru_cache(maxsize=2)
def shared_codec(path: str) -> PieceCodec:
    """One codec for each Python worker, kept from task to task."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model: str, text_col: str = "text", lists: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256, and with ``lists`` the ids and the decoded text themselves.

    A null or empty text has no ids and decodes to the empty text.  Whole texts are encoded, one at a time; repeated rows
    stay; an empty table gives no rows; a column of the name of an added one is replaced.
    """

    def make():
        codec = shared_codec(model)

        def f(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if lists else ()))}
            for t in texts(batch, text_col):
                n, ids, decoded = codec.report(t)
                out["n_tokens"].append(n)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if lists:
                    out["ids"].append(np.array(ids.split(",") if ids else [], dtype=np.int32))
                    out["decoded"].append(decoded)
            return out

        return f

    return add_columns(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * lists, keep)


def decode_ids(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of a column of id lists; a null list gives a null."""

    def make():
        codec = shared_codec(model)
        return lambda batch: {"decoded": [None if x is None else codec.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]}

    return add_columns(df, make, "decoded string")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
