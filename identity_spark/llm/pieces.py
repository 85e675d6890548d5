"""Encoding with a SentencePiece vocabulary by streaming Viterbi, and decoding.

The ids of a text are those of its segmentation into pieces with the highest sum of scores; of equal sums the one whose
last pieces are longer wins. A character that is no piece is spelled by its UTF-8 bytes, at a score below any piece's.

The encoder reads characters one after another and keeps the best sums of the last ``longest`` boundaries only, the
length of the longest piece. Whenever the paths that lead back from these boundaries meet in one, everything before it
is settled and its ids are committed. :class:`StreamingViterbi` does so for one stream; :func:`streams` does it for
many streams at once, a character of each at a time, with a trie for the pieces that are still open.

Where no piece of the vocabulary can span two characters, such as before a blank that follows a letter, paths always
meet, and what follows doesn't depend on what was before. A text is cut there, and the ids of a short stretch that
comes again are remembered (see :mod:`memory`).

A vocabulary of merges (BPE) has ranks for scores, whose sums prefer many common pieces to one rare piece; for such a
file the score is the logarithm of a Zipf law over the ranks. A unigram file's scores are taken as they are. Scores
are whole numbers (millionths), so that sums are exact.

Defined results: a null or empty text has no ids; decoding gives the text back, but for the character U+2581, which
stands for a blank as in the vocabulary; ids outside of the vocabulary and control ids decode to nothing; rows are
encoded each by itself, equal ones equally; a text of any length is encoded whole, in memory of some 60 bytes for each
of its own, and a long stretch by itself, with no memory beyond its window and its ids; a key
isn't looked at, so it may be null or repeated; further columns are kept, but for one that has the name of the result,
which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import tidy
from .memory import StretchEncoder

BLANK = "▁"
#: Below the lowest score of any piece, for a character that is spelled by bytes.
UNKNOWN = 10_000_000
#: Streams of more characters, and groups of fewer streams, are encoded each by itself, others together.
TOGETHER = 1024
ALONE = 24
#: Characters of a group of streams, as if all were as long as the longest.
GROUP = 1 << 19
#: Stretches that a worker remembers before it begins anew.
REMEMBERED = 1_000_000
ROWS_AT_ONCE = 512
_NONE = -(1 << 60)


class Vocabulary:
    """Pieces, scores and bytes of a model file; ``scores`` is "zipf" for merge ranks or "file"."""

    def __init__(self, path: str, scores: str = "zipf"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if scores == "zipf":
            ranked = sorted(normal, key=lambda i: (-model.get_score(i), i))
            total = math.log(sum(1 / (r + 2.7) for r in range(len(ranked))))
            self.score = {i: -round(1e6 * (math.log(r + 2.7) + total)) for r, i in enumerate(ranked)}
        else:
            self.score = {i: round(1e6 * model.get_score(i)) for i in normal}
        self.id = {self.text[i]: i for i in normal}
        self.longest = max(map(len, self.id), default=1)
        self.unknown = min(self.score.values(), default=0) - UNKNOWN
        self.known = {self.text[i]: (i, s) for i, s in self.score.items()}
        raw = {i: self.text[i].replace(BLANK, " ").encode() for i in normal} | {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes = [raw.get(i, b"") for i in range(size)]
        self.raw = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.raw_size = np.array([len(x) for x in self.bytes], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self._tree()

    def _tree(self) -> None:
        """The pieces as a trie in arrays: node x goes by character code c to x' = next[x] + c if came[x'] = x.

        code[point] is a character's code, 0 for those in no piece; word[x] is the piece that ends in node x, or -1."""
        letters = [c for c, _ in Counter(chain.from_iterable(self.id)).most_common()]  # usual ones have neighbouring codes
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        code = {c: k + 1 for k, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for x, i in self.id.items():
            at = 0
            for c in x:
                if (k := code[c]) not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][k]
            ends[at] = i
        place = np.zeros(len(children), np.int64)
        size = len(letters) + 1
        free = np.ones(3 * len(children) + 2 * size, bool)
        free[:size] = False  # the root is 0; codes are subtracted from places beyond
        base = np.zeros(len(children), np.int64)
        several = sorted((x for x in range(len(children)) if len(children[x]) > 1), key=lambda x: -len(children[x]))
        start, branches = size, 0
        for x in several:
            codes = np.array(list(children[x]), np.int64)
            if len(codes) < branches:
                start = size
            branches = len(codes)
            while True:
                if start + 128 + size > len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                some = np.arange(start, start + 128)
                fits = np.flatnonzero(free[some[:, None] + codes[None, :]].all(axis=1))
                if len(fits):
                    break
                start += 128
            start = int(some[fits[0]])  # what comes with as many branches doesn't fit before it
            base[x] = some[fits[0]]
            free[base[x] + codes] = False
            place[list(children[x].values())] = base[x] + codes
        lone = [x for x in range(len(children)) if len(children[x]) == 1]
        codes, below = (np.array([k for x in lone for k in f(children[x])], np.int64) for f in (dict.keys, dict.values))
        place[below] = np.flatnonzero(free)[: len(lone)]
        base[lone] = place[below] - codes
        self.next, self.came, self.word = (np.full(len(free), k, np.int32) for k in (0, -1, -1))
        self.next[place], self.word[place] = base, ends
        self.came[place[below]] = place[lone]
        for x in several:
            self.came[place[list(children[x].values())]] = place[x]
        self.points = np.full(len(self.text), self.unknown, np.int64)
        self.points[list(self.score)] = list(self.score.values())

    def spelled(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode()] if self.byte else [0]


class StreamingViterbi:
    """Ids of a stream of characters; :meth:`push` gives those that are settled, :meth:`finish` the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # since the last settled boundary
        self.best = [0]  # sums at its boundaries, of which the last ``longest`` ones count
        self.back: list[tuple[int, int]] = [(0, -1)]  # where the best last piece begins, and its id (-1: bytes)

    def push(self, text: str) -> list[int]:
        out: list[int] = []
        v = self.v
        for c in text:
            self.text += c
            end = len(self.text)
            best, back = self.best[end - 1] + v.unknown, (end - 1, -1)
            found = _NONE
            for start in range(max(0, end - v.longest), end):
                if (piece := v.known.get(self.text[start:end])) and (total := self.best[start] + piece[1]) > found:
                    found, back = total, (start, piece[0])
            self.best.append(found if found > _NONE and back[1] >= 0 else best)
            self.back.append(back)
            if end % v.longest == 0:
                out += self._settle(range(max(0, end - v.longest + 1), end + 1))
        return out

    def finish(self) -> list[int]:
        return self._settle([len(self.text)])

    def _settle(self, boundaries) -> list[int]:
        """Walks back from boundaries that later pieces can begin at until one is left, and commits what is before it."""
        open_at = set(boundaries)
        while len(open_at) > 1:
            last = max(open_at)
            open_at.remove(last)
            open_at.add(self.back[last][0])
        at = met = open_at.pop()
        ids: list[list[int]] = []
        while at:
            start, piece = self.back[at]
            ids.append([piece] if piece >= 0 else self.v.spelled(self.text[start:at]))
            at = start
        if met:
            first = self.best[met]
            self.text, self.best = self.text[met:], [x - first for x in self.best[met:]]
            self.back = [(0, -1), *((s - met, p) for s, p in self.back[met + 1 :])]
        return list(chain.from_iterable(reversed(ids)))


def streams(v: Vocabulary, texts: list[str]) -> list[bytes]:
    """Ids of many short streams, a character of each at a time; longer streams come first, so that live ones are a prefix.

    Of boundary t there are the best sum and the last boundary, at or before the last commit's end, on the best path to
    it; both are held for the last ``longest`` boundaries. When the latter is one for all of them, the paths have met."""
    if not texts:
        return []
    size = np.array([len(x) for x in texts])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = v.code[np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le"), np.uint32)]
    offset = np.cumsum(size) - size
    live = np.searchsorted(-size, -np.arange(1, size[0] + 2), "right")  # streams with a character t
    ring, n = v.longest + 1, len(texts)
    every = np.arange(n)
    best, met = np.zeros((ring, n), np.int64), np.zeros((ring, n), np.int32)
    begin, piece = np.zeros((size[0], n), np.int16), np.zeros((size[0], n), np.int32)  # until they are committed
    done = np.zeros(n, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def commit(rows: np.ndarray, end: np.ndarray) -> None:
        at, which = end, rows
        while len(which):
            out.append((which, at, piece[at - 1, which]))
            at = begin[at - 1, which].astype(np.int64)
            on = at > done[which]
            at, which = at[on], which[on]
        done[rows] = end

    opened: list[tuple[int, np.ndarray, np.ndarray]] = []  # (start, streams, nodes of the trie), the first start first
    for t in range(int(size[0])):
        m = int(live[t])
        code = flat[offset[:m] + t]
        total, last, since = np.full(m, _NONE, np.int64), np.full(m, -1, np.int32), np.full(m, t, np.int16)
        still = []
        for start, rows, nodes in [*opened, (t, every[:m], np.zeros(m, np.int64))]:
            if len(rows) and rows[-1] >= m:
                there = int(np.searchsorted(rows, m))
                rows, nodes = rows[:there], nodes[:there]
            at = v.next[nodes] + code[rows]
            on = v.came[at] == nodes
            rows, nodes = rows[on], at[on]
            word = v.word[nodes]
            ends = word >= 0
            to, word = rows[ends], word[ends]
            now = best[start % ring, to] + v.points[word]
            better = now > total[to]  # of equal sums the longer piece, which came first
            to = to[better]
            total[to], last[to], since[to] = now[better], word[better], start
            if len(rows) and t + 1 - start < v.longest:
                still.append((start, rows, nodes))
        opened = still
        none = np.flatnonzero(last < 0)
        total[none] = best[t % ring, none] + v.unknown
        best[(t + 1) % ring, :m], met[(t + 1) % ring, :m] = total, met[since % ring, every[:m]]
        begin[t, :m], piece[t, :m] = since, last
        if live[t + 1] < m:
            ended = every[live[t + 1] : m]
            commit(ended, np.full(len(ended), t + 1))
        if (t + 1) % v.longest == 0 and live[t + 1]:
            window = np.arange(t + 2 - v.longest, t + 2)
            now = met[window % ring, : live[t + 1]]
            rows = np.flatnonzero((now == now[0]).all(axis=0))
            end = now[0, rows].astype(np.int64)
            commit(rows[end > done[rows]], end[end > done[rows]])
            met[(window % ring)[:, None], rows[None, :]] = window[:, None]
    row, at, ids = (np.concatenate(x) for x in zip(*out, strict=True))
    by_place = np.lexsort((at, row))
    row, at, ids = row[by_place], at[by_place], ids[by_place]
    ends = np.cumsum(np.bincount(row, minlength=n))
    found: list[bytes] = [b""] * n
    whole = ids.astype("<u4").tobytes()
    for k, i, a, b in zip(range(n), order.tolist(), [0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist(), strict=True):
        found[i] = whole[a:b]
    for k in np.unique(row[ids < 0]).tolist():
        own = slice(ends[k - 1] if k else 0, ends[k])
        text = texts[order[k]]
        spelt = [[i] if i >= 0 else v.spelled(text[e - 1]) for i, e in zip(ids[own].tolist(), at[own].tolist(), strict=True)]
        found[order[k]] = np.array(list(chain.from_iterable(spelt)), "<u4").tobytes()
    return found


def all_streams(v: Vocabulary, texts: list[str]) -> list[bytes]:
    """Ids of streams of any length: short ones together in groups of bounded size, long or lone ones by themselves."""
    out: list[bytes] = [b""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        end = at + 1
        while end < len(order) and (longest := len(texts[order[end]])) <= TOGETHER and (end - at) * longest < GROUP:
            end += 1
        some = [texts[i] for i in order[at:end]]
        alone = len(some) < ALONE or len(some[-1]) > TOGETHER
        found = [_stream(v, x) for x in some] if alone else streams(v, some)
        for i, x in zip(order[at:end], found, strict=True):
            out[i] = x
        at = end
    return out


def _stream(v: Vocabulary, text: str) -> bytes:
    one = StreamingViterbi(v)
    return np.array(one.push(text) + one.finish(), "<u4").tobytes()


class Encoder(StretchEncoder):
    """Ids of whole texts."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        super().__init__(remembered)
        self.v = vocabulary
        several = {c for x in vocabulary.id if len(x) > 1 for c in x}
        self.lone = np.zeros(256, bool)
        self.lone[[ord(c) for c in "\n\t\r" if c not in several]] = True
        #: whether a piece spans a blank that follows another character; then a text is one stretch
        self.inner = any(BLANK in x.lstrip(BLANK) for x in vocabulary.id)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Stretches begin around characters that stand alone, and where blanks begin."""
        edge = np.zeros(len(data), bool)
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        if not self.inner:
            lone, blank = self.lone[data], data == 32
            edge |= lone
            edge[1:] |= lone[:-1] | (blank[1:] & ~blank[:-1])
        return np.flatnonzero(edge)

    def learn(self, stretches: list[bytes]) -> list[bytes]:
        return all_streams(self.v, [x.decode().replace(" ", BLANK) for x in stretches])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end; a blank comes before each text that isn't empty."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), BLANK, " ")
        marked = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        return super().encode(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, marked))


def decoded_all(v: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of rows of ids, without the blank that encoding puts first; ends: ids up to each row's end."""
    known = (ids >= 0) & (ids < len(v.bytes))
    ids = np.where(known, ids, 0)
    size = np.where(known, v.raw_size[ids], 0)
    to = np.cumsum(size)
    whole = v.raw[np.repeat(v.raw_start[ids] - to + size, size) + np.arange(int(to[-1]) if len(to) else 0)].tobytes()
    stops = np.concatenate([[0], to])[ends].tolist()
    texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops[:-1]], stops, strict=True)]
    return [x[1:] if x.startswith(" ") else x for x in texts]


def decoded(v: Vocabulary, ids: list[int]) -> str:
    """The text of some ids, without the blank that encoding puts first."""
    return decoded_all(v, np.array(ids, np.int64), np.array([len(ids)]))[0]


@cache
def vocabulary(path: str, scores: str) -> Vocabulary:
    """One for each worker process and file."""
    return Vocabulary(path, scores)


@cache
def encoder(path: str, scores: str, remembered: int) -> Encoder:
    """One for each worker process and file; it remembers from task to task."""
    return Encoder(vocabulary(path, scores), remembered)


def _with(df: DataFrame, field: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [field])


def encode(docs: DataFrame, path: str, *, scores: str = "zipf", text: str = "text", out: str = "ids", back: str | None = None, keep_text: bool = True, remembered: int = REMEMBERED, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """All columns of ``docs`` and the ids of each whole text; ``back`` names a column for what these ids decode to.

    Columns of ``docs`` with these names are replaced; without keep_text the text stays behind. remembered and
    rows_at_once trade memory of a task for time."""
    docs = docs.drop(out, *([] if back is None else [back]))
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path, scores, remembered)
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                some = batch.slice(start, rows_at_once)
                ids, ends = encode_all.encode(some.column(text))
                values = ids.astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                more = [] if back is None else [pa.array(decoded_all(encode_all.v, values, ends), pa.string())]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), lists, *more], [*kept, out, *([] if back is None else [back])])

    return docs.mapInArrow(tidy(run), _with(docs.select(*kept), f"`{out}` array<int>" + ("" if back is None else f", `{back}` string")))


def decode(rows: DataFrame, path: str, *, scores: str = "zipf", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text of each list of ids, in place of a column of that name; null for null."""
    rows = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, scores)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(start, ROWS_AT_ONCE)
                texts = [None if x is None else decoded(v, x) for x in some.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(tidy(run), _with(rows, f"`{out}` string"))
