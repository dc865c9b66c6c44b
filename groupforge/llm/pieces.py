"""A SentencePiece BPE vocabulary, read for encoding by prefix tables, for counting and for decoding.

Encoding: each prefix of a text has one last token in the text's encoding. An Aho-Corasick automaton gives the vocabulary
strings that end at each position; the one that is compatible with the last token of the prefix before it is the last token
of this prefix. The ids are then read backwards from the end. Two tokens are compatible if the merges, run on both strings
together, give just these two: a merge across their border must never come before the merges that build them.

Texts are first cut where no vocabulary string holds the two characters side by side: no merge crosses such a place.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import ahocorasick
import sentencepiece as spm

from .common import Recent, digest

#: Cuts letters, other signs and digits apart, each with the spaces before it; used only if no vocabulary string is cut by it.
FINE = r"▁*[^\W\d_▁²]+|▁*(?:[^\w▁]|[_²])+|▁*\w|▁+"
COARSE = r"▁+[^▁]*|[^▁]+"
UNKNOWN = -1


class PieceModel:
    """Plain data that is pickled to the executors once: its size is bounded by the vocabulary."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        if m.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        kinds = {p.type for p in m.pieces}
        if kinds & {4, 5}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser are supported")
        self.proto, self.key, self.dummy = proto, digest(proto), n.add_dummy_prefix
        self.pieces = [p.piece for p in m.pieces]
        self.scores = [p.score for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.silent = {i for i, p in enumerate(m.pieces) if p.type == 3}
        self.end = m.trainer_spec.eos_id
        self.pattern = next(p for p in (FINE, COARSE, r"(?s:.+)") if not self._crossed(p))
        n.add_dummy_prefix = False
        self.bare_proto = m.SerializeToString()

    def _crossed(self, pattern: str) -> bool:
        """Whether the pattern cuts any vocabulary string."""
        find = re.compile(pattern).findall
        sides = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        return any(len(find(x)) != 1 for x in sides) or any(len(find(p)) != 1 for p in self.ids)

    def normal(self, text: str | None) -> str:
        if not text:
            return ""
        return ("▁" if self.dummy else "") + text.replace(" ", "▁")


class Merger:
    """The merges themselves on one short string: the best-scored adjacent pair first, the leftmost of equals."""

    def __init__(self, model: PieceModel):
        self.ids, self.scores = model.ids, model.scores

    def run(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """The tokens' strings, and the two parts of the last merge."""
        part: list[str | None] = list(s)
        n = len(part)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (i := self.ids.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, len(part[a]) + len(part[b])))

        for a in range(n - 1):
            offer(a, a + 1)
        last = None
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if part[a] is None or part[b] is None or after[a] != b or len(part[a]) + len(part[b]) != size:
                continue
            last = (part[a], part[b])
            part[a], part[b] = part[a] + part[b], None
            after[a] = after[b]
            if after[b] < n:
                ahead[after[b]] = a
            offer(ahead[a], a)
            offer(a, after[a])
        return [p for p in part if p is not None], last


class Encoder:
    """Encodes and decodes with the prefix table; one in each worker process."""

    def __init__(self, model: PieceModel, cached: int = 250_000):
        self.m = model
        self.find = re.compile(model.pattern).findall
        self.merger = Merger(model)
        self.piece, self.size = model.pieces, [len(p) for p in model.pieces]
        n = len(model.pieces)
        self.left, self.right, self.plain = [-1] * n, [-1] * n, bytearray(n)
        times: dict[float, int] = {}
        for i in model.ids.values():
            times[model.scores[i]] = times.get(model.scores[i], 0) + 1
        self.rank = [-s for s in model.scores]
        self.automaton = ahocorasick.Automaton()
        for p, i in model.ids.items():
            if len(p) == 1:
                self.rank[i], self.plain[i] = float("-inf"), 1
                self.automaton.add_word(p, (i, 1))
        for p, i in sorted(model.ids.items(), key=lambda x: len(x[0])):
            if len(p) == 1:
                continue
            got, last = self.merger.run(p)
            if len(got) > 1:
                continue  # never made by the merges, so it ends no prefix
            self.automaton.add_word(p, (i, len(p)))
            a, b = model.ids[last[0]], model.ids[last[1]]
            self.left[i], self.right[i] = a, b
            early = all(self.plain[x] and self.rank[x] < self.rank[i] for x in (a, b))
            self.plain[i] = early and times[model.scores[i]] == 1
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cache = Recent(self.chunk, cached)
        self.decimal = [str(i) for i in range(n)]
        self.shown = ["" if i in model.silent else " ⁇ " if i == model.unk else p.replace("▁", " ") for i, p in enumerate(model.pieces)]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= 300_000:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Steps back through the merges on both sides of the border, the later merge first.

        `until`: the merge that ends the time in which a and b lie side by side; a merge across the border that ranks before it
        would come first. Of equal ranks the left one comes first.
        """
        ids, piece, rank, plain = self.m.ids, self.piece, self.rank, self.plain
        if not (plain[a] and plain[b]):
            return self.merger.run(piece[a] + piece[b])[0] == [piece[a], piece[b]]
        x, y, until, on_left = a, b, float("inf"), True
        while True:
            if (c := ids.get(piece[x] + piece[y])) is not None:
                if not plain[c]:
                    return self.merger.run(piece[a] + piece[b])[0] == [piece[a], piece[b]]
                if rank[c] < until or rank[c] == until and not on_left:
                    return False
            if self.left[x] < 0 and self.left[y] < 0:
                return True
            # undo the later of the merges that made x and y; of equal ranks the right one is later
            if rank[x] > rank[y]:
                until, on_left, x = rank[x], True, self.right[x]
            else:
                until, on_left, y = rank[y], False, self.left[y]

    def chunk(self, s: str) -> tuple[int, ...]:
        """Ids of a text that no merge crosses the ends of."""
        last, done, size = [UNKNOWN] * len(s), -1, self.size
        pairs, compatible = self.pairs, self.compatible
        for end, (token, length) in self.automaton.iter(s):
            if end <= done:
                continue
            start = end - length
            if start < 0 or (before := last[start]) < 0:
                last[end], done = token, end
                continue
            fits = pairs.get(before << 32 | token)
            if fits or fits is None and compatible(before, token):
                last[end], done = token, end
        out, at = [], len(s) - 1
        while at >= 0:
            if (token := last[at]) >= 0:
                out.append(token)
                at -= size[token]
            else:
                out.extend(self._unknown(s[at]))
                at -= 1
        out.reverse()
        return tuple(out)

    def _unknown(self, char: str) -> list[int]:
        """Byte tokens of a character outside the vocabulary, last first."""
        if not self.m.bytes_:
            return [self.m.unk]
        return [self.m.bytes_[x] for x in reversed(char.encode())]

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        ids = list(chain.from_iterable(map(self.cache.__getitem__, self.find(self.m.normal(text)))))
        if end:
            ids.append(self.m.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        byte_of = self.m.byte_of
        if byte_of.keys().isdisjoint(ids):
            out = "".join(map(self.shown.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if (b := byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(_from_bytes(bytes(run)))
                    run.clear()
                parts.append(self.shown[i])
            parts.append(_from_bytes(bytes(run)))
            out = "".join(parts)
        if self.m.dummy and out[:1] == " ":  # the space that encoding put first, if it comes from a piece
            first = next(i for i in ids if i not in self.m.silent)
            return out[1:] if self.piece[first][:1] == "▁" else out
        return out


def _from_bytes(data: bytes) -> str:
    """Each byte that begins no character gives one replacement sign."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode())
            out.append("�")
            at += e.start + 1
    return "".join(out)


class Counter:
    """Counts tokens: strings proved to encode alone as one token count at once, the rest is merged by the library."""

    def __init__(self, model: PieceModel, whole: frozenset[str] | set[str], cached: int = 250_000):
        self.m, self.cached = model, cached
        self.find = re.compile(model.pattern).findall
        self.whole = dict.fromkeys(whole, 1)
        self.bare = spm.SentencePieceProcessor(model_proto=model.bare_proto)
        self.known: dict[str, int] = dict(self.whole)
        self.old: dict[str, int] = {}

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = [self.find(self.m.normal(t)) for t in texts]
        new = set().union(*cut).difference(self.known) if cut else set()
        rest = []
        for c in new:
            if (n := self.old.get(c)) is None:
                rest.append(c)
            else:
                self.known[c] = n
        if rest:
            self.known.update(zip(rest, map(len, self.bare.encode(rest, num_threads=1)), strict=True))
        out = [sum(map(self.known.__getitem__, c)) for c in cut]
        for c in rest:
            if len(c) > 64:
                del self.known[c]
        if len(self.known) > self.cached:
            self.old, self.known = self.known, dict(self.whole)
        return out


def whole_tokens(model: PieceModel) -> frozenset[str]:
    """The vocabulary strings that the library, run on each alone, encodes as one token."""
    bare = spm.SentencePieceProcessor(model_proto=model.bare_proto)
    strings = list(model.ids)
    return frozenset(p for p, ids in zip(strings, bare.encode(strings), strict=True) if ids == [model.ids[p]])


_ENCODERS: dict[str, Encoder] = {}
_COUNTERS: dict[str, Counter] = {}


def encoder(model: PieceModel) -> Encoder:
    if model.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model.key] = Encoder(model)
    return _ENCODERS[model.key]


def counter(model: PieceModel, whole) -> Counter:
    if model.key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model.key] = Counter(model, whole)
    return _COUNTERS[model.key]
