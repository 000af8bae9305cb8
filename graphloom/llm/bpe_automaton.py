"""BPE encoding and decoding with a compiled automaton over tokens.

Start with one state and an arc for each byte.  A merge gadget for the pair (a, b), in rank order, acts
where the state behind a still has its arc b: that state is copied without this arc, and every state
from which a leads there gets an arc for the new token ab.  The result accepts each byte string once,
along its BPE tokenization.

A state is fixed by the arc that leads to it.  An arc is a token with one way of making it (a pair may
give a token that another pair has given before, which is an arc of its own), so states and arcs are
numbered alike.  What the arcs of a state have lost follows from two chains: the ends of its token
with the ranks at which later merges swallowed them, and the beginnings of the arc's token likewise.
Arcs are numbered so that those that begin with an arc z, swallowed at rank r or later, are
neighbours; so each gadget takes one arc and one run of arcs from a state, and the compiled transition
table keeps for each state the bounds of the runs that it has lost.  A transition is a search in them.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tuned
from .tokenizer_files import SPACED, WHITE, PieceTable

#: The splitting rule of byte-level BPE vocabularies (fixed pattern), white space spelled out.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """Compiled from a byte-level BPE vocabulary file.  Gadgets act in rank order, which is what merging
    the pair of least rank again and again comes to, unless a pair uses a token that a later one makes
    again: words of such a list, which training never yields, are merged pair by pair."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = {t: bytes(byte_of[c] for c in t) for t in vocab}
        self.labels: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in vocab.items():
            self.labels[i] = raw[t]
        for t, i in special.items():
            self.labels[i] = t.encode()
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.gadgets: dict[tuple[int, int], int] = {}
        # of each arc: its token, the arc that its token begins with and the rank of their merge; ends and
        # begins: (token, rank at which it was swallowed), from the token itself inwards
        self.token: list[int] = []
        self.left: list[tuple[int, int] | None] = []
        self.ends: list[tuple] = []
        self.begins: list[tuple] = []
        self.arcs_of: dict[int, list[int]] = {}
        for t, i in vocab.items():
            if len(raw[t]) == 1:
                self._arc(i, None, ((i, _NEVER),), ((i, _NEVER),))
        made = {left + right: rank for rank, (left, right) in enumerate(merges)}
        self.unordered: dict[tuple[int, int], tuple[int, int]] = {}
        if any(made.get(t, -1) > rank for rank, pair in enumerate(merges) for t in pair):
            for rank, (left, right) in enumerate(merges):
                self.unordered.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        for rank, (left, right) in enumerate(merges):
            self._gadget(vocab[left], vocab[right], vocab[left + right], rank)
        self._compile()

    @classmethod
    def from_file(cls, path: str) -> "Automaton":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        return cls(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})

    def _arc(self, token: int, left: tuple[int, int] | None, ends: tuple, begins: tuple) -> None:
        self.arcs_of.setdefault(token, []).append(len(self.token))
        self.token.append(token)
        self.left.append(left)
        self.ends.append(ends)
        self.begins.append(begins)

    def _lost(self, state: int, arc: int) -> bool:
        """Whether a gadget so far has taken this arc from this state."""
        rank = self.gadgets.get
        return any((r := rank((y, z))) is not None and r < gone and r <= taken for y, gone in self.ends[state] for z, taken in self.begins[arc])

    def _gadget(self, a: int, b: int, ab: int, rank: int) -> None:
        if (a, b) in self.gadgets:
            return
        for x in self.arcs_of.get(a, ()):
            for y in self.arcs_of.get(b, ()):
                if not self._lost(x, y):
                    self._arc(ab, (x, rank), ((ab, _NEVER), (b, rank), *self.ends[y][1:]), ((ab, _NEVER), (a, rank), *self.begins[x][1:]))
        self.gadgets[a, b] = rank

    def _compile(self) -> None:
        """Numbers the arcs by the trees of their beginnings, children by rank, and writes out the runs
        of numbers that each state has lost."""
        n = len(self.token)
        children: list[list[int]] = [[] for _ in range(n)]
        for arc, left in enumerate(self.left):  # made in the order of ranks
            if left is not None:
                children[left[0]].append(arc)
        size = [1] * n
        for arc in range(n - 1, -1, -1):
            if self.left[arc] is not None:
                size[self.left[arc][0]] += size[arc]
        first, at = [0] * n, 0  # an arc's own number; its tree's numbers follow
        for arc in range(n):
            if self.left[arc] is None:
                first[arc], at = at, at + size[arc]
            own = first[arc] + 1
            for child in children[arc]:
                first[child], own = own, own + size[child]
        # what each gadget takes from the states whose end is its left token: rank, and two runs
        taken: dict[int, list[tuple]] = {}
        for (a, b), rank in self.gadgets.items():
            for z in self.arcs_of.get(b, ()):
                later = next((first[c] for c in children[z] if self.left[c][1] >= rank), first[z] + size[z])
                taken.setdefault(a, []).append((rank, first[z], first[z] + 1, later, first[z] + size[z]))
        runs = {a: np.array(rows, np.int64) for a, rows in taken.items()}
        bounds, off = [], [0]
        for state in range(n):
            own = [runs[y][runs[y][:, 0] < gone] for y, gone in self.ends[state] if y in runs]
            own = np.concatenate([*(x[:, 1:3] for x in own), *(x[:, 3:5] for x in own), np.zeros((0, 2), np.int64)])
            own = own[own[:, 1] > own[:, 0]]
            own = own[np.argsort(own[:, 0])]
            if len(own):
                end = np.maximum.accumulate(own[:, 1])
                new = np.concatenate([[True], own[1:, 0] > end[:-1]])
                own = np.stack([own[new, 0], end[np.concatenate([new[1:], [True]])]], axis=1)
            bounds.append(own.ravel())
            off.append(off[-1] + own.size)
        #: The transition table: of a state the bounds[off[state] : off[state + 1]], begins and ends in turn.
        self.bounds, self.off = array("i", np.concatenate([*bounds, np.zeros(0, np.int64)]).astype(np.int32).tobytes()), off
        self.number = first
        self.by_label: dict[bytes, list[int]] = {}
        for arc, token in enumerate(self.token):
            self.by_label.setdefault(self.labels[token], []).append(arc)
        self.longest = max(map(len, self.by_label), default=0)
        del self.ends, self.begins, self.left, self.arcs_of, self.gadgets  # the table has it all

    def has_arc(self, state: int, arc: int) -> bool:
        """Whether the state behind arc `state` kept this arc: by the table."""
        low = self.off[state]
        return not (bisect_right(self.bounds, self.number[arc], low, self.off[state + 1]) - low) & 1

    def walk(self, word: bytes) -> list[int]:
        """The tokens of the accepting walk: longest labels first, with a step back at dead ends."""
        if self.unordered:
            return self._merged(word)
        if (whole := self.by_label.get(word)) is not None:
            return [self.token[whole[0]]]
        n, by_label, longest = len(word), self.by_label, self.longest
        bounds, off, number = self.bounds, self.off, self.number
        path: list[int] = []
        begin: list[int] = []
        dead: set[tuple[int, int]] = set()  # (arc, where it ended) from which no way leads on
        at, size = 0, min(longest, n)
        while at < n:
            found = None
            while size and found is None:
                for arc in by_label.get(word[at : at + size], ()):
                    if dead and (arc, at + size) in dead:
                        continue
                    if path:
                        low = off[path[-1]]
                        if (bisect_right(bounds, number[arc], low, off[path[-1] + 1]) - low) & 1:
                            continue
                    found = arc
                    break
                else:
                    size -= 1
            if found is not None:
                path.append(found)
                begin.append(at)
                at += size
                size = min(longest, n - at)
            else:
                if not path:
                    raise ValueError("a byte without a token")
                dead.add((path.pop(), at))  # the arcs of this label that are left, then shorter ones
                size = at - begin[-1]
                at = begin.pop()
        return [self.token[arc] for arc in path]

    def _merged(self, word: bytes) -> list[int]:
        """The tokens by merging, of all pairs the first of least rank at a time."""
        path = [self.token[self.by_label[word[i : i + 1]][0]] for i in range(len(word))]
        while found := [(self.unordered[p][0], i) for i, p in enumerate(zip(path, path[1:])) if p in self.unordered]:
            _, i = min(found)
            path[i : i + 2] = [self.unordered[path[i], path[i + 1]][1]]
        return path

    def encode_piece(self, piece: str, known: dict[str, list[int]]) -> list[int]:
        """Ids of a text; `known` keeps the words met."""
        out: list[int] = []
        for part in self.cut.split(piece) if self.cut else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in SPLIT.findall(part):
                    if (ids := known.get(word)) is None:
                        ids = known[word] = self.walk(word.encode())
                    out += ids
        return out

    def decode(self, ids) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


class AutomatonTable(PieceTable):
    """Ids of pieces by the automaton."""

    def __init__(self, path: str):
        self.automaton = Automaton.from_file(path)
        self.pieces, self.bare = SPACED, False
        self._clear()

    def _ids(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        known: dict[str, list[int]] = {}
        found = [self.automaton.encode_piece(p, known) for p in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return pieces, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes


_TABLES: dict[str, AutomatonTable] = {}


def automaton_table(path: str) -> AutomatonTable:
    if path not in _TABLES:
        _TABLES[path] = AutomatonTable(path)
    return _TABLES[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids): null and empty texts have no ids; repeated rows stay."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = automaton_table(tokenizer)
        for batch in batches:
            for part, _, _ in slices(batch):
                flat, off = table.encode([t or "" for t in part.column("text").to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return tuned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, n_tokens, ids_sha256, text): null ids are none; bytes that are not
    UTF-8 become replacement characters; an id without a label raises."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_table(tokenizer).automaton
        for batch in batches:
            lists = batch.column("ids")
            out = []
            for i in range(batch.num_rows):
                own = lists[i].values
                own = own.to_numpy(zero_copy_only=False).astype("<u4") if own is not None else np.zeros(0, "<u4")
                out.append((len(own), hashlib.sha256(own.tobytes()).hexdigest(), automaton.decode(own.tolist())))
            n, sha, text = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "text"])

    return ids.mapInArrow(decode, "doc_id long, n_tokens long, ids_sha256 string, text string")
