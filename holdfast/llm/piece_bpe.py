"""SentencePiece BPE encoding by backtracking, and decoding.

A sequence of pieces is the encoding of a text exactly if every two adjacent
pieces are what merging makes of their joined text.  So the encoder walks the
text with the longest matching piece (a trie of the pieces gives it), checks
it against its left neighbour by re-merging both, falls back to shorter
pieces, and steps back over a position from which nothing fits; a bit per
position keeps such failures from being tried twice.

No piece holds a word mark after another character, so marks with what
follows them are encoded one by one and cached.  Nor does merging cross two
characters that stand side by side in no piece: a word that ends in such a
character (a full stop, say) is the word without it, and the character.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache

MARK = "▁"          # fixed value: stands for a space
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


class PieceBpe:
    """Encoder for a SentencePiece BPE model with byte fallback, identity
    normalisation and a dummy prefix; other models are refused."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = (train.model_type == 2 and train.byte_fallback and not norm.precompiled_charsmap
                 and norm.add_dummy_prefix and norm.escape_whitespaces
                 and not norm.remove_extra_whitespaces and not train.treat_whitespace_as_suffix)
        kinds = {p.type for p in model.pieces}
        if not plain or not kinds <= {1, 2, 3, 6}:
            raise ValueError(f"{path}: not an identity-normalised BPE model with byte fallback")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK))
               for p in self.ids):
            raise ValueError(f"{path}: word marks inside pieces")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any("\n" in p for p in self.ids):
            raise ValueError(f"{path}: line feeds inside pieces")
        # the last merge of every piece that merging reaches
        self.split = {p: parts for p in self.ids if len(p) > 1
                      and len(parts := self.merge(p, 2)) == 2}
        self.reachable = {p for p in self.ids if len(p) == 1 or p in self.split}
        self.trie = ahocorasick.Automaton()
        for p in self.reachable:
            self.trie.add_word(p, len(p))
        self.width = max(map(len, self.reachable))
        # the longest piece at the beginning of every way into the trie that is no piece
        self.longest = {}
        for p in sorted(self.reachable, key=len):
            for n in range(1, len(p)):
                if p[:n] not in self.reachable:
                    self.longest[p[:n]] = self.longest.get(p[:n - 1], p[:n - 1]) or p[0]
        self.adjacent = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.decimal = [str(i) for i in range(len(model.pieces))]
        self.codes = WordCache(self._code, 100_000)
        self.shorter = WordCache(self._shorter, 100_000)
        self.fits = WordCache(lambda pair: self.compatible(*pair), 300_000)
        self.words = WordCache(self._word, 350_000, 80 << 20)
        self.heads = WordCache(self._encoded, 50_000)
        self.feed = self._encoded("\n")

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` ends in just these two pieces.

        Goes through the merges of both backwards: before the later of the two
        last merges was made, the parts at the border stood side by side, and
        must not have merged first.
        """
        scores, split = self.scores, self.split
        if left + right in scores:
            return False
        while True:
            a, b = split.get(left), split.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and scores[left] < scores[right]:
                bar, left = scores[left], a[1]
                s = scores.get(left + right)
                if s is not None and s > bar:
                    return False
            else:
                bar, right = scores[right], b[0]
                s = scores.get(left + right)
                if s is not None and s >= bar:      # of equals the leftmost merges first
                    return False

    def merge(self, text: str, until: int = 1) -> list[str]:
        """Pieces of a short text by the merge rule itself: always the best
        scored adjacent pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _shorter(self, piece: str) -> str | None:
        """The next shorter piece with which ``piece`` begins."""
        for n in range(len(piece) - 1, 0, -1):
            if piece[:n] in self.reachable:
                return piece[:n]
        return None

    def pieces(self, text: str) -> list[str]:
        """Pieces of ``text``; characters outside the vocabulary stand alone."""
        n, width = len(text), self.width
        prefix, longest, fits = self.trie.longest_prefix, self.longest, self.fits
        failed = None                           # made when a place fails first
        out: list[str] = []
        at, piece, last = 0, None, None
        while at < n:
            if piece is None:
                piece = text[at:at + width]
                piece = piece[:prefix(piece) or 1]
                piece = longest.get(piece, piece)
            while True:
                end = at + len(piece)
                if (failed is None or not failed[end >> 3] >> (end & 7) & 1) and (
                        last is None or fits[last, piece]):
                    out.append(piece)
                    at, last, piece = end, piece, None
                    break
                less = self.shorter[piece]
                if less is None:
                    # nothing fits here: mark the place and shorten the last piece
                    if failed is None:
                        failed = bytearray(n // 8 + 1)
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = out.pop()
                    at -= len(piece)
                    last = out[-1] if out else None
                    break
                piece = less
        return out

    def _code(self, piece: str) -> bytes:
        """Ids of a piece, or of the bytes of a character that is none."""
        i = self.ids.get(piece)
        return np.asarray([self.bytes[b] for b in piece.encode("utf-8")] if i is None else [i],
                          "<i4").tobytes()

    def _encoded(self, text: str) -> bytes:
        return b"".join(map(self.codes.__getitem__, self.pieces(text)))

    def _word(self, word: str) -> bytes:
        """Ids of a word mark and ``word``."""
        stem = word[:-1]
        if stem and word[-2:] not in self.adjacent:
            got = self.words.get(stem)
            if got is None:                     # kept if it is cut no further
                got = self._encoded(MARK + stem) if len(stem) > 1 and \
                    stem[-2:] not in self.adjacent else self.words[stem]
            return got + self.codes[word[-1]]
        return self._encoded(MARK + word)

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The ids as decimal text joined by commas, and as a list."""
        if not text:
            return "", []
        marked = text.replace(" ", MARK)
        words = self.words.__getitem__
        if MARK * 2 in marked or marked[0] == MARK:
            got = [words(u[1:]) for u in _UNIT.findall(MARK + marked)]
        else:
            first, *lines = marked.split("\n")
            got = list(map(words, first.split(MARK)))
            for line in lines:                  # a line feed is a piece of its own
                got.append(self.feed)
                head, *rest = line.split(MARK)
                if head:
                    got.append(self.heads[head])
                got += map(words, rest)
        ids = np.frombuffer(b"".join(got), "<i4").tolist()
        return ",".join(map(self.decimal.__getitem__, ids)), ids


_ENCODERS: dict[str, PieceBpe] = {}


def encoder(path: str) -> PieceBpe:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceBpe(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, with_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds
    ids and decoded.  A null text counts as empty and has no ids.  Rows are
    independent: repeated rows and null ids come back as they are, an empty
    table gives no row, other columns are not read, and a text of any length
    is encoded whole in time proportional to it.
    """

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                joined, got = enc(t or "")
                back = enc.library.decode(got) if got else ""
                n.append(len(got))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(got)
                    texts.append(back)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                    pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, schema)
