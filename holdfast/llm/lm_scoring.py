"""Language-model scoring with a weighted backoff automaton.

Tokens are words and one end per document.  Smoothed n-grams are states with
failure arcs: a state is a history of one or two words, an arc carries the log
probability of a token seen after it, and the failure arc leads to the history
without its oldest word at the cost of the backoff weight.  A text is traversed
once from left to right: every token is scored in the state that the tokens
before it have led to, and gives the next state.  All documents of a block go
one token forward at a time.

The model is an interpolated absolute-discounting one of order three over all
words: every word, bigram and trigram of the training documents counts.  What
the discount leaves to the unigrams belongs to the unknown word, so the model
spreads over the training vocabulary and one unknown word, as the add-one base
does.

The model grows with the corpus and is never sent whole.  Documents are dealt
into blocks; a block keeps its texts as numbers of its own vocabulary, gets
the corpus counts of exactly its words and n-grams, and builds its own part of
the automaton.  It sends its distinct words, then its n-grams as numbers of
words, as packed messages: one per slice of all words, or of all histories
(dealt by hash; a history of frequent words is dealt over several slices, by
the words after it).  Every slice answers in the order it was asked.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, values

END = b""                      # no word is empty
BLOCK_DOCS, BLOCK_TOKENS = 4096, 1 << 20
SLICE_BYTES, MIN_SLICES = 4 << 20, 64     # of text for a slice
SLICE_TOKENS = 1 << 19         # a history is dealt over one slice more for so many
LANE = 256                     # tokens of a text that are traversed in one go
DISCOUNT = 0.75                # of n-grams of two or three words

# what goes between blocks and slices
DOCS, WORDS, NUMBERS, GRAMS, COUNTS = range(5)
_MESSAGE = "kind int, slice long, block long, data binary, more binary"
_NUMBERED = _MESSAGE + ", n long, v long, n1 long, n2 long"
_TYPES = {"kind": pa.int32(), "data": pa.binary(), "more": pa.binary()}


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case, cut at ASCII white space, and the end."""
    out = text.encode("utf-8").lower().split() if text else []
    out.append(END)
    return out


def is_held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text, modulo 7, is 2; a null id counts as
    empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _messages(rows: list[tuple], schema: str = _MESSAGE) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    cols = zip(*rows) if rows else [()] * len(names)
    return pa.table([pa.array(c, _TYPES.get(n, pa.int64())) for n, c in zip(names, cols)], names)


# --- packed columns ----------------------------------------------------------
# a history (u,) is the number u, a history (u, v) is (u + 1) << 32 | v

def _pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length: per column the least value, and the
    distances from it as byte planes, as many as the largest one needs."""
    n = len(columns[0])
    parts = [np.int64(n).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c, np.int64)
        lo, hi = (int(c.min()), int(c.max())) if n else (0, 0)
        width = ((hi - lo).bit_length() + 7) // 8
        parts.append(np.array([lo, width], np.int64).tobytes())
        far = c.view(np.uint64) - np.uint64(lo % (1 << 64))
        parts.append(np.ascontiguousarray(far.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        lo, width = np.frombuffer(raw, np.int64, 2, at).tolist()
        far = np.zeros((n, 8), np.uint8)
        far[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append((far.view(np.uint64).reshape(n) + np.uint64(lo % (1 << 64))).view(np.int64))
        at += 16 + n * width
    return out


def _pack_grams(history: np.ndarray, *columns: np.ndarray) -> bytes:
    """Histories, mostly in order, by the differences of their first words."""
    u, v = history >> 32, history & ((1 << 32) - 1)
    first, second = np.where(u > 0, u - 1, v), np.where(u > 0, v + 1, 0)
    return _pack(np.diff(first, prepend=0), second, *columns)


def _unpack_grams(data: bytes) -> list[np.ndarray]:
    first, second, *columns = _unpack(data)
    first = np.cumsum(first)
    return [np.where(second > 0, (first + 1) << 32 | second - 1, first), *columns]


def _mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _dealt(of: np.ndarray):
    """(slice, positions in it), in order."""
    if len(of) and of.max() < 1 << 15:
        of = of.astype(np.int16)               # sorted by radix
    order = np.argsort(of, kind="stable")
    which, start = np.unique(of[order], return_index=True)
    return zip(which.tolist(), np.split(order, start[1:]))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the number of every key."""
    order = np.argsort(keys)
    keys = keys[order]
    new = _starts(keys)
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(new)), np.diff(new, append=len(keys)))
    return keys[new], order[new], number


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _summed(number: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, number, n)
    return out


# --- words -------------------------------------------------------------------

def _block(block: int, slices: int, vocab: dict[bytes, int], found: list[tuple],
           texts: list[np.ndarray]) -> pa.Table:
    """One block's documents (id, whether it is null, held out, length; and
    all tokens), and its words by slice with their training counts.  A word's
    number in the block is its place among them."""
    words = list(vocab)
    of = np.fromiter((zlib.crc32(w) % slices for w in words), np.int64, len(words))
    ids = np.concatenate(texts)
    held = np.repeat([f[2] for f in found], [f[3] for f in found])
    n = np.bincount(ids[~held], minlength=len(words))
    place, at, rows = np.empty(len(words), np.int64), 0, []
    for s, i in _dealt(of):
        place[i] = np.arange(at, at + len(i))
        at += len(i)
        rows.append((WORDS, s, block, b" ".join(words[j] for j in i.tolist()), _pack(n[i])))
    return _messages([(DOCS, -1, block, _pack(*map(np.array, zip(*found))), _pack(place[ids]))]
                     + rows)


def blocks(docs: DataFrame, slices: int) -> DataFrame:
    """(doc_id, text) rows as blocks, each a run of documents within a task."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        vocab, found, texts, tokens = {}, [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                words = words_of(t)
                ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32,
                                  len(words))
                found.append((d or 0, d is None, is_held_out(d), len(ids)))
                texts.append(ids)
                tokens += len(ids)
                if len(found) >= BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                    yield from _block(block, slices, vocab, found, texts).to_batches()
                    block += 1
                    vocab, found, texts, tokens = {}, [], [], 0
        if found:
            yield from _block(block, slices, vocab, found, texts).to_batches()

    return docs.mapInArrow(run, _MESSAGE)


def slice_words(table: pa.Table, slices: int) -> pa.Table:
    """To every block of a slice, in its order: the words' numbers, frequent
    ones first (-1: in no training document), and corpus counts.  The first
    answer says how many tokens and words the slice trains, and how many words
    occur once and twice."""
    t = table.sort_by("block")
    s = t.column("slice")[0].as_py()
    texts = [d.split(b" ") for d in t.column("data").to_pylist()]
    word = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    number = word.indices.to_numpy().astype(np.int64)
    total = _summed(number, np.concatenate([_unpack(d)[0] for d in t.column("more").to_pylist()]),
                    len(word.dictionary))
    name = np.empty(len(total), np.int64)
    name[np.argsort(-total, kind="stable")] = np.arange(len(total)) * slices + s
    name[total == 0] = -1
    if name.max() >= (1 << 31) - 1:
        raise ValueError("more distinct words than 31 bits can number")
    about = (int(total.sum()), *(int(x.sum()) for x in (total > 0, total == 1, total == 2)))
    rows, at = [], 0
    for b, words in zip(t.column("block").to_pylist(), texts):
        i = number[at:at + len(words)]
        rows.append((NUMBERS, s, b, _pack(name[i], total[i]), None,
                     *(about if not at else (None,) * 4)))
        at += len(words)
    return _messages(rows, _NUMBERED)


# --- n-grams -----------------------------------------------------------------

class Block:
    """Documents of a block and its distinct n-grams of two and three words,
    in an order that depends on nothing else."""

    def __init__(self, table: pa.Table):
        row = table.filter(pc.equal(table.column("kind"), DOCS)).to_pylist()[0]
        self.block = row["block"]
        ids, null, held, self.size = _unpack(row["data"])
        self.doc_id = pa.array(ids, mask=null.astype(bool))
        self.held = held.astype(bool)
        self.ids, = _unpack(row["more"])
        told = table.filter(pc.equal(table.column("kind"), NUMBERS)).sort_by("slice")
        parts = zip(*map(_unpack, told.column("data").to_pylist()))
        self.name, self.total = map(np.concatenate, parts)     # name -1: in no n-gram
        self.words = len(self.name)

        first = np.zeros(len(self.ids), bool)
        first[np.cumsum(self.size)[:-1]] = first[0] = True
        trains = np.repeat(~self.held, self.size)
        g = self.name[self.ids]
        at = np.flatnonzero(~first[1:] & (g[1:] >= 0) & (g[:-1] >= 0)) + 1
        keys, one, number = _distinct(g[at - 1] << 32 | g[at])
        two = np.full(len(self.ids), -1, np.int64)      # the bigram that ends there, or -1
        two[at] = number
        self.b_first, self.b_last = self.ids[at[one] - 1], self.ids[at[one]]
        b_n = np.bincount(number[trains[at]], minlength=len(keys))
        at = at[(two[at - 1] >= 0) & ~first[at]]
        keys3, one, number = _distinct(two[at - 1] << 32 | g[at])
        self.t_history, self.t_lower = two[at[one] - 1], two[at[one]]
        self.t_last = self.ids[at[one]]
        t_n = np.bincount(number[trains[at]], minlength=len(keys3))
        mask = (1 << 32) - 1
        pairs = keys + (1 << 32)                        # bigrams as histories
        #: words, then bigrams; a word without a number is -1
        self.histories = np.concatenate([self.name, pairs])
        self.history = np.concatenate([keys >> 32, pairs[self.t_history]])
        self.last = np.concatenate([keys & mask, keys3 & mask])
        self.n = np.concatenate([b_n, t_n])

    def _slices(self, slices: int) -> tuple[np.ndarray, np.ndarray]:
        """Per history its first slice, and over how many it is dealt.  It is
        not more frequent than its rarest word."""
        most = np.concatenate([self.total,
                               np.minimum(self.total[self.b_first], self.total[self.b_last])])
        return ((_mixed(self.histories) % np.uint64(slices)).astype(np.int64),
                np.minimum(1 + most // SLICE_TOKENS, slices))

    def dealt(self, slices: int):
        """The n-grams' slices and histories; whether a history lies in one
        slice; the histories to be asked for by name, and in which slices.  A
        slice answers unasked for the histories of the n-grams it is sent, and
        nothing follows an end."""
        first, over = self._slices(slices)
        at = np.concatenate([self.b_first, self.words + self.t_history])
        whole = over == 1
        of = first[at]
        hot = np.flatnonzero(~whole[at])
        of[hot] += (_mixed(self.last[hot]) % over[at[hot]].astype(np.uint64)).astype(np.int64)
        told = self.histories < 0
        told[at] = True
        told &= whole | (self.histories < 0)
        end = self.ids[-1]
        told[end] = True
        told[self.words + np.flatnonzero(self.b_last == end)] = True
        ask = np.flatnonzero(~told)
        asked = np.repeat(ask, over[ask])
        nth = np.arange(len(asked)) - np.repeat(np.cumsum(over[ask]) - over[ask], over[ask])
        return of % slices, at, whole, asked, (first[asked] + nth) % slices

    def messages(self, slices: int) -> pa.Table:
        """Its n-grams with their counts in its training documents, and the
        histories it asks for."""
        of, _, _, asked, asked_of = self.dealt(slices)
        asks = {s: self.histories[asked[i]] for s, i in _dealt(asked_of)}
        grams = dict(_dealt(of))
        none = np.zeros(0, np.int64)
        return _messages([
            (GRAMS, s, self.block, _pack_grams(*(c[grams.get(s, none)] for c in
                                                 (self.history, self.last, self.n))),
             _pack_grams(asks.get(s, none))) for s in sorted(asks.keys() | grams.keys())])

    def counts(self, table: pa.Table, slices: int) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of its n-grams; with how many different words the
        corpus goes on after its histories."""
        of, at, whole, asked, asked_of = self.dealt(slices)
        t = table.filter(pc.equal(table.column("kind"), COUNTS))
        data = {r["slice"]: r for r in t.select(["slice", "data", "more"]).to_pylist()}
        count = np.zeros(len(of), np.int64)
        kinds = np.zeros(len(self.histories), np.int64)
        asks = dict(_dealt(asked_of))
        for s, i in _dealt(of):
            count[i], = _unpack(data[s]["data"])
            h = at[i[_starts(at[i])]]
            answer, = _unpack(data[s]["more"])
            kinds[h[whole[h]]] = answer[:len(h)][whole[h]]
            if s in asks:                           # a history once in a slice
                kinds[asked[asks.pop(s)]] += answer[len(h):]
        for s, i in asks.items():
            kinds[asked[i]] += _unpack(data[s]["more"])[0]
        return count, kinds


def block_grams(table: pa.Table, slices: int) -> pa.Table:
    return Block(table).messages(slices)


def slice_grams(table: pa.Table) -> pa.Table:
    """To every block of a slice, in its order: the n-grams' corpus counts;
    with how many different words of the slice the corpus goes on after their
    histories, and after those it asked for."""
    t = table.sort_by("block")
    s = t.column("slice")[0].as_py()
    grams = [_unpack_grams(d) for d in t.column("data").to_pylist()]
    asks = [_unpack_grams(d)[0] for d in t.column("more").to_pylist()]
    ends = np.cumsum([len(g[0]) for g in grams])[:-1]
    history, last, n = (np.concatenate(c) for c in zip(*grams))
    del grams
    known, _, of = _distinct(history)
    keys, _, number = _distinct(of << 32 | last)
    total = _summed(number, n, len(keys))
    kinds = np.append(np.bincount(keys[total > 0] >> 32, minlength=len(known)), 0)
    known = np.append(known, -1)                    # is not asked for

    def after(numbers, asked):
        at = np.searchsorted(known[:-1], asked)
        return np.concatenate([kinds[numbers[_starts(numbers)]],
                               np.where(known[at] == asked, kinds[at], 0)])

    return _messages([(COUNTS, s, b, _pack(c), _pack(after(h, a))) for b, c, h, a in zip(
        t.column("block").to_pylist(), np.split(total[number], ends), np.split(of, ends), asks)])


class Automaton:
    """Backoff automaton over tokens ``0..len(unigram)-1``.

    ``unigram``: log10 probability per token.  ``grams``: n-gram -> training
    count, for n-grams of one to three tokens.  ``follow``: history -> number
    of the n-gram arcs that leave it; all but an end go on as often as they
    occur.
    """

    def __init__(self, unigram: np.ndarray, grams: dict[tuple, int],
                 follow: dict[tuple, int], discount: float = DISCOUNT):
        w = len(unigram)
        pairs = {g: i for i, g in enumerate(g for g in grams if len(g) == 2)}
        triples = [g for g in grams if len(g) == 3]
        histories = [(t,) for t in range(w)] + list(pairs)
        column = lambda x: np.array(x, np.int64)
        self._build(unigram, column([g[0] for g in pairs]), column([g[1] for g in pairs]),
                    column([pairs[g[:2]] for g in triples]), column([g[2] for g in triples]),
                    column([pairs[g[1:]] for g in triples]),
                    *(column([grams.get(g, 0) for g in x]) for x in (histories, triples)),
                    column([follow.get(h, 0) for h in histories]),
                    discount)

    @classmethod
    def of(cls, *columns) -> Automaton:
        out = cls.__new__(cls)
        out._build(*columns)
        return out

    def _build(self, unigram, b_first, b_last, t_history, t_last, t_lower, count, t_count,
               follow, discount=DISCOUNT) -> None:
        # states: the empty history, words, bigrams.  A history that nothing
        # follows has no arc and costs nothing to leave.
        w = self.width = len(unigram)
        self.root = unigram
        self.fail = np.concatenate([np.zeros(1 + w, np.int64), 1 + b_last])
        left = np.where(follow > 0, discount * follow / np.maximum(count, 1), 1.0)
        self.backoff = np.concatenate([[0.0], np.log10(left)])

        def arcs(state, token, n, lower):
            seen = np.flatnonzero(n > 0)
            state, token, n = state[seen], token[seen], n[seen]
            p = (n - discount) / count[state - 1] + 10 ** (self.backoff[state] + lower[seen])
            out = np.full(len(lower), -np.inf)
            out[seen] = np.log10(p)
            return state * w + token, out, seen

        k2, p2, at2 = arcs(1 + b_first, b_last, count[w:], unigram[b_last])
        k3, p3, at3 = arcs(1 + w + t_history, t_last, t_count, p2[t_lower])
        keys = np.concatenate([k2, k3])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.arc = np.concatenate([p2[at2], p3[at3]])[order]
        self.next = np.concatenate([1 + w + at2, 1 + w + t_lower[at3]])[order]

    def score(self, s, t):
        """Log probability of ``t`` in state ``s``, and the next state; both
        numbers or arrays."""
        shape = np.broadcast(s, t).shape
        s = np.array(np.broadcast_to(s, shape), np.int64).reshape(-1)
        t = np.array(np.broadcast_to(t, shape), np.int64).reshape(-1)
        total, to, left = self.root[t], 1 + t, np.arange(len(t))
        lost = np.zeros(len(t))
        for _ in range(2):                     # a bigram, a word; then the empty history
            left = left[s[left] > 0]
            if not len(left) or not len(self.keys):
                break
            key = s[left] * self.width + t[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            total[left[hit]], to[left[hit]] = self.arc[at[hit]], self.next[at[hit]]
            left = left[~hit]
            lost[left] += self.backoff[s[left]]
            s[left] = self.fail[s[left]]
        return (total + lost).reshape(shape), to.reshape(shape)

    def traverse(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probabilities of texts of those sizes, one after another in
        ``ids``.  All go one token forward at a time, each carrying its state
        and its sum.  A long text goes in lanes of :data:`LANE` tokens; a lane
        begins two tokens earlier, in the empty history, since two tokens lead
        to the same state from wherever they begin."""
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (np.cumsum(size) - size)[text]
        end = begin + np.minimum(size[text], (nth + 1) * LANE)
        own = begin + nth * LANE                       # from here on it scores
        at = np.maximum(own - 2, begin)
        order = np.argsort(at - end, kind="stable")    # the longest first
        text, own, at, end = text[order], own[order], at[order], end[order]
        going = np.searchsorted(at - end, -np.arange(max(end - at, default=0)), side="left")
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at))
        for k, m in enumerate(going.tolist()):
            now = at[:m] + k
            p, state[:m] = self.score(state[:m], ids[now])
            total[:m] += np.where(now >= own[:m], p, 0.0)
        return np.bincount(text, total, len(size))


def unigrams(counts: np.ndarray, n: int, distinct: int, discount: float) -> np.ndarray:
    """Log10 probabilities of tokens with those training counts, 0 for unknown
    ones.  Without training tokens everything is the unknown word."""
    if not n:
        return np.zeros(len(counts))
    return np.log10(np.where(counts > 0, counts - discount, discount * distinct) / n)


def block_scores(table: pa.Table, slices: int, n: int, distinct: int,
                 discount: float) -> pa.Table:
    """Scores of one block's documents."""
    b = Block(table)
    count, kinds = b.counts(table, slices)
    pairs = len(b.b_first)
    model = Automaton.of(
        unigrams(b.total, n, distinct, discount), b.b_first, b.b_last, b.t_history, b.t_last,
        b.t_lower, np.concatenate([b.total, count[:pairs]]), count[pairs:], kinds)
    start = np.cumsum(b.size) - b.size
    base = np.add.reduceat(np.log10((b.total + 1) / (n + distinct + 1))[b.ids], start)
    known = np.add.reduceat((b.total > 0)[b.ids].astype(np.int64), start)
    return pa.table([b.doc_id, pa.array(b.held),
                     pa.array(b.size), pa.array(known), pa.array([n] * len(b.size), pa.int64()),
                     pa.array(base), pa.array(model.traverse(b.ids, b.size))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                     "score"])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    and score, both log10.

    Documents whose crc32(doc_id as text) modulo 7 is 2 are held out, all
    others train.  A null or empty text is the end alone; a null id counts as
    empty text for the fold.  Repeated rows train and score like any others;
    an empty table gives no row; other columns are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    slices = max(MIN_SLICES, -(-int(size) // SLICE_BYTES))
    rows = materialize(blocks(docs, slices), "lm_blocks")
    words = materialize(rows.filter(F.col("kind") == WORDS).groupBy("slice").applyInArrow(
        lambda t: slice_words(t, slices), _NUMBERED), "lm_words")
    s = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1", "n2"))).head()
    n, v, n1, n2 = map(int, s)
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    own = materialize(rows.filter(F.col("kind") == DOCS), "lm_docs")
    discard(rows)                                   # its words are answered
    whole = own.unionByName(words.drop("n", "v", "n1", "n2"))
    counts = materialize(
        whole.groupBy("block").applyInArrow(lambda t: block_grams(t, slices), _MESSAGE)
        .groupBy("slice").applyInArrow(slice_grams, _MESSAGE), "lm_counts")
    return whole.unionByName(counts).groupBy("block").applyInArrow(
        lambda t: block_scores(t, slices, n, v, discount),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
