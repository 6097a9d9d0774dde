"""SentencePiece encoding and decoding by suffix-array matching.

Spaces become U+2581, one is put in front, and the text falls into runs that no piece crosses (spaces and the word after
them). The runs that a batch holds and the worker hasn't met are concatenated and indexed by a suffix array over the
first `longest piece` characters; every piece of the vocabulary is located in it by binary search, character by
character, all pieces at once. The occurrences are edges (start, end, piece); they are sorted by end position and
relaxed from left to right: the encoding of a prefix ends in the one piece that byte-pair merging wouldn't join or
split differently beside the last piece of the rest. Two neighbours stand if, undoing their merges from the latest
one, no pair that touches across the border would have merged earlier. So the result is the one that merging by
score gives, without merging.

Characters without a piece become byte pieces. Of a run with two spaces or more the last space and the word are matched;
the spaces before it are left over after all other merges (checked when the vocabulary is read) and are joined from the
left. Long runs are cut where no piece holds the two characters that meet, since nothing merges there. Runs that the
relaxation leaves open, and space runs of a vocabulary that joins them earlier, are merged directly.

Defined cases: null and empty texts have no pieces; U+2581 itself decodes as a space (it is what a space is written
as); whole texts are encoded; an empty table gives no rows; other columns are ignored; equal ids are encoded one by
one. Decoding returns the text exactly (but for U+2581).
"""

from __future__ import annotations

import heapq
import math
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_texts

SPACE = "▁"
#: Runs kept by a worker before it lets rare ones go, characters of text split at once, and of runs indexed at once.
KEPT_RUNS, CHUNK_CHARS, INDEX_CHARS = 100_000, 2_000_000, 200_000
#: Runs beyond this are cut before they are indexed; the pieces are the same.
CUT_CHARS = 64
_RANK = np.int64(1) << 40
_UNKNOWN = -1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a byte-pair SentencePiece model and what their merges say about neighbours."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)])
        self.bytes = [next((i for i in range(n) if self.pieces[i] == f"<0x{b:02X}>"), model.unk_id()) for b in range(256)]
        plain = [i for i in range(n) if not special[i]]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        order = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        #: When a piece is merged: later for lower scores; single characters are there from the start.
        self.time = np.full(n, -1, np.int64)
        for p, i in self.ids.items():
            self.time[i] = order[self.rank[p]] if len(p) > 1 else -1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        usable = []
        for p, i in self.ids.items():
            if SPACE in p[1:]:
                continue
            parts, last = self.merged(p)
            if len(parts) == 1 and (len(p) == 1 or (last and all(self.time[x] < self.time[i] for x in last))):
                usable.append(i)
                if last:
                    self.left[i], self.right[i] = last
        self.usable = np.array(sorted(usable, key=lambda i: self.pieces[i]))
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        self._pair_table()
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        #: Pairs of characters that some piece holds.
        self.met = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        wide = [p for p in self.ids if SPACE in p[1:]]
        #: Whether several spaces merge among themselves only, and after all that a space and a word make.
        self.spaces_last = all(not p.strip(SPACE) for p in wide) and min((self.rank[p] for p in wide), default=math.inf) > max((self.rank[p] for p in self.ids if len(p) > 1 and p[0] == SPACE and p not in wide), default=0)
        #: Runs: spaces with the word after them; a line break that no piece holds stands alone.
        alone = "" if "\n" in inner else "\n"
        self.runs = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + ("|\n" if alone else ""))
        self.text_of = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.bytes):
            self.text_of[i] = bytes([b])
        codes = np.zeros((len(self.usable), self.longest), np.uint32)
        for k, i in enumerate(self.usable):
            codes[k, : len(self.pieces[i])] = np.frombuffer(self.pieces[i].encode("utf-32-le"), np.uint32)
        self.codes = codes
        self.lengths = np.array([len(self.pieces[i]) for i in self.usable], np.int64)

    def cut(self, run: str) -> list[str]:
        """A run in parts that no merge joins."""
        at = [0, *(k for k in range(1, len(run)) if run[k - 1 : k + 1] not in self.met), len(run)]
        return [run[a:b] for a, b in zip(at, at[1:], strict=False)]

    def direct(self, text: str) -> np.ndarray:
        """Piece ids by merging, unknown characters as their bytes."""
        parts, _ = self.merged(text)
        return np.array(list(chain.from_iterable([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()] for p in parts)), np.int32)

    def merged(self, text: str) -> tuple[list[str], tuple[int, int] | None]:
        """Byte-pair merging by score, leftmost first among equals: the parts, and the ids of the last merge."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (both := parts[i] + parts[j]) in self.ids:
                heapq.heappush(queue, (self.rank[both], i, j, both))

        for i in range(len(parts)):
            offer(i)
        last = None
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            last = (self.ids.get(parts[i], -1), self.ids.get(parts[j], -1))
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None], last

    def _pair_table(self) -> None:
        """An open table of (a, b) to the time at which a and b merge, for every split of every piece."""
        pairs = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = self.time[i]
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.key, self.when = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _RANK, np.int64)
        for k, t in pairs.items():
            at = int(self._slot(np.array([k]))[0])
            while self.key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.key[at], self.when[at] = k, t

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_time(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The time at which neighbours a and b merge; _RANK if they never do."""
        key = a << 20 | b
        at = self._slot(key)
        have = self.key[at]
        out = self.when[at].copy()
        out[have != key] = _RANK
        open_ = np.flatnonzero((have != key) & (have >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            have = self.key[at[open_]]
            hit = have == key[open_]
            out[open_[hit]] = self.when[at[open_[hit]]]
            open_ = open_[~hit & (have >= 0)]
        return out

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between pieces a and b alone."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        # the pieces that touch across the border, from the last merge back; end: when the pair is broken up
        end = np.full(len(a), _RANK, np.int64)
        while len(at):
            # a pair that would merge before one of the two is absorbed breaks the border
            lost = self.merge_time(a, b) < end
            ok[at[lost]] = False
            ta, tb = self.time[a], self.time[b]
            left = ta > tb
            # the later one is undone; of equal ones the right one, since merging goes from left to right
            limit = np.where(left, ta, tb + 1)
            more = ~lost & (np.maximum(ta, tb) >= 0)
            a, b = np.where(left, self.right[a], a)[more], np.where(left, b, self.left[b])[more]
            at, end = at[more], limit[more]
        return ok


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of codes in the order of their next depth codes: packed into one number as far as they fit, then by
    prefix doubling."""
    seen = np.bincount(codes)
    dense = np.cumsum(seen > 0)
    bits = int(dense[-1]).bit_length()
    have = max(1, min(depth, 63 // bits))
    small = np.concatenate([dense[codes], np.zeros(have, np.int64)])
    key = np.zeros(len(codes), np.int64)
    for d in range(have):
        key = key << bits | small[d : d + len(codes)]
    order = np.argsort(key)
    while have < depth:
        step = np.empty(len(key), np.int64)
        step[0] = 1
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty_like(step)
        rank[order] = np.cumsum(step)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: max(0, len(rank) - have)] = rank[have:]
        key = rank << 31 | ahead
        order = np.argsort(key)
        have *= 2
    return order


def piece_ranges(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the range of order whose suffixes start with it, narrowed by one code after another."""
    padded = np.concatenate([codes, np.zeros(pieces.shape[1] + 1, codes.dtype)])
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
    for d in range(pieces.shape[1]):
        live = np.flatnonzero((lengths > d) & (lo < hi))
        if not len(live):
            break
        want = pieces[live, d]
        bounds = []
        for upper in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) >> 1
                code = padded[order[mid] + d]
                right = code <= want[open_] if upper else code < want[open_]
                a[open_[right]] = mid[right] + 1
                b[open_[~right]] = mid[~right]
            bounds.append(a)
        lo[live], hi[live] = bounds
    return lo, np.maximum(lo, hi)


def encode_runs(runs: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all runs one after another (unknown characters as their bytes), and each run's count."""
    wide = [k for k, r in enumerate(runs) if SPACE in r[1:]]
    words = list(runs)
    for k in wide if vocab.spaces_last else ():
        words[k] = SPACE + runs[k].lstrip(SPACE)
    ids, counts, failed = _relaxed(words, vocab)
    if not wide and not failed:
        return ids, counts
    upto = np.concatenate(([0], np.cumsum(counts)))
    every = [ids[a:b] for a, b in zip(upto, upto[1:], strict=False)]
    for k in failed:
        every[k] = vocab.direct(words[k])
    for k in wide:
        if not vocab.spaces_last:
            every[k] = vocab.direct(runs[k])
            continue
        # the last space is one of the others if its word didn't take it
        alone = every[k][0] == vocab.ids.get(SPACE, _UNKNOWN)
        spaces = SPACE * (len(runs[k]) - len(words[k]) + int(alone))
        every[k] = np.concatenate([vocab.direct(spaces), every[k][int(alone) :]])
    return np.concatenate(every), np.array([len(e) for e in every], np.int64)


def _relaxed(runs: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[int]]:
    text = "\0".join(runs) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(codes)
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order = suffix_array(codes, vocab.longest)
    lo, hi = piece_ranges(codes, order, vocab.codes, vocab.lengths)
    counts = hi - lo
    piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    begin = order[np.arange(len(piece)) - np.repeat(first - lo, counts)].astype(np.int32)
    end = begin + vocab.lengths[piece].astype(np.int32)
    ids = vocab.usable[piece].astype(np.int32)

    # characters without a piece: an edge of their own
    run_of = np.repeat(np.arange(len(runs)), sizes + 1)
    offset = np.arange(n) - starts[run_of]
    covered = np.zeros(n, bool)
    covered[begin[vocab.lengths[piece] == 1]] = True
    bare = np.flatnonzero(~covered & (offset < sizes[run_of])).astype(np.int32)
    begin, end, ids = np.concatenate([begin, bare]), np.concatenate([end, bare + 1]), np.concatenate([ids, np.full(len(bare), _UNKNOWN, np.int32)])

    # relax: all edges that end at the same offset of their runs together
    step = offset[begin] + end - begin
    step = step.astype(np.uint16 if step.max(initial=0) < 1 << 16 else np.int32)
    sort = np.argsort(step, kind="stable")
    begin, end, ids = begin[sort], end[sort], ids[sort]
    last = np.full(n + 1, -2, np.int64)  # the piece that ends at a position; -2 none, -3 a run's start
    last[starts] = -3
    came = np.zeros(n + 1, np.int64)
    cuts = np.concatenate(([0], np.cumsum(np.bincount(step, minlength=1))))
    for t in range(1, len(cuts) - 1):
        at = slice(cuts[t], cuts[t + 1])
        b, e, i = begin[at], end[at], ids[at]
        before = last[b]
        ok = (before == -3) | ((before != -2) & ((before == _UNKNOWN) | (i == _UNKNOWN)))
        check = np.flatnonzero((before >= 0) & (i >= 0))
        ok[check] = vocab.stand(before[check], i[check].astype(np.int64))
        # a run's start keeps its mark; ends lie beyond it
        last[e[ok]], came[e[ok]] = i[ok], b[ok]

    # back from each run's end
    stop = np.zeros(n + 1, bool)
    at, who, failed = starts + sizes, np.arange(len(runs)), []
    while len(at):
        bad = last[at] == -2
        failed += who[bad].tolist()
        stop[at[~bad]] = True
        at, who = came[at[~bad]], who[~bad]
        more = last[at] != -3
        at, who = at[more], who[more]
    ends = np.flatnonzero(stop)
    found, owner = last[ends], run_of[ends]
    odd = np.flatnonzero(found == _UNKNOWN)
    if len(odd):
        chars = [text[p].encode() for p in came[ends[odd]]]
        width = np.ones(len(found), np.int64)
        width[odd] = list(map(len, chars))
        at = np.cumsum(width)[odd] - width[odd]
        owner, found = np.repeat(owner, width), np.repeat(found, width)
        for k, c in zip(at, chars, strict=True):
            found[k : k + len(c)] = [vocab.bytes[b] for b in c]
    return found.astype(np.int32), np.bincount(owner, minlength=len(runs)), failed


class _Numbers(dict):
    """Runs and their numbers; a run that is asked for the first time gets the next one."""

    def __missing__(self, run: str) -> int:
        number = self[run] = len(self)
        return number


class Encoder:
    """Encodes texts and keeps the runs it has met more than once, about KEPT_RUNS at most."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.index = _Numbers()
        self.ids, self.starts, self.met = np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64)

    def runs(self, text: str | None) -> list[str]:
        found = self.vocab.runs.findall(SPACE + text.replace(" ", SPACE)) if text else []
        if max(map(len, found), default=0) <= CUT_CHARS:
            return found
        return list(chain.from_iterable([r] if len(r) <= CUT_CHARS or SPACE in r[1:] else self.vocab.cut(r) for r in found))

    def forget(self, most: int = KEPT_RUNS // 2, often: int = 2) -> None:
        """Keep the runs that were met so often, the first `most` of them."""
        kept = np.flatnonzero(self.met >= often)[:most]
        names = list(self.index)
        self.index = _Numbers((names[k], i) for i, k in enumerate(kept.tolist()))
        self.ids, upto = _gathered(self.ids, self.starts, kept)
        self.starts, self.met = upto, np.zeros(len(kept), np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode the runs that got the latest numbers, INDEX_CHARS at a time."""
        for part in _chunks(new, INDEX_CHARS):
            ids, counts = encode_runs(part, self.vocab)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets of the texts in them."""
        if len(self.index) > KEPT_RUNS:
            self.forget()
        known = len(self.index)
        # numbers take little memory; a text's runs as strings go with the text
        each = [np.fromiter(map(self.index.__getitem__, runs), np.int32, len(runs)) for runs in map(self.runs, texts)]
        if new := list(islice(self.index, known, None)):
            self.learn(new)
        n = np.fromiter(map(len, each), np.int64, len(each))
        which = np.concatenate([np.empty(0, np.int32), *each])
        self.met += np.bincount(which, minlength=len(self.met))
        ids, upto = _gathered(self.ids, self.starts, which)
        return ids, upto[np.concatenate(([0], np.cumsum(n)))]

    def decode(self, ids) -> str:
        return b"".join(map(self.vocab.text_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _gathered(ids: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ids[starts[k] : starts[k + 1]] for each k of which, one after another, and their offsets."""
    begin, width = starts[which], starts[which + 1] - starts[which]
    upto = np.concatenate(([0], np.cumsum(width)))
    return ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], width)], upto


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _chunks(texts: list, chars: int):
    """Consecutive texts of about so many characters together; a longer text alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def encoded(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids, round_trip (decoding gives the text back; U+2581 counts as a space)."""
    import pyarrow as pa

    path = model or default_model()

    def encode(texts: list) -> list:
        own = encoder(path)
        out: list[list] = [[], [], [], []]
        for part in _chunks(texts, CHUNK_CHARS):
            ids, at = own.encode(part)
            out[0] += [len(t or "") for t in part]
            out[1] += np.diff(at).tolist()
            out[2].append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
            out[3] += [own.decode(ids[a:b].tolist()) == (t or "").replace(SPACE, " ") for t, a, b in zip(part, at, at[1:], strict=False)]
        arrays = pa.concat_arrays(out[2]) if out[2] else pa.array([], pa.list_(pa.int32()))
        return [out[0], out[1], arrays, out[3]]

    return map_texts(docs.select("doc_id", F.col(text).alias("text")), encode, "n_chars long, n_pieces long, ids array<int>, round_trip boolean", done=lambda: encoder(path).forget(20_000, 3))


def decoded(rows: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text of piece ids."""
    path = model or default_model()
    return map_texts(rows.select("doc_id", F.col(ids).alias("ids")), lambda many: [[encoder(path).decode(x or []) for x in many]], "text string")
