"""SentencePiece BPE encoding and decoding through a prefix table of last tokens.

For a prefix of a text, the last token of its encoding is unique.  So an encoding is a table with one token for
each prefix: an Aho-Corasick automaton names the pieces that end at a prefix, and of these the one is taken that
is compatible with the last token of the prefix before it.  A pair of pieces is compatible when merging their
joined text gives back just this pair, which is told by undoing the pair's later merges one by one and looking
whether one across the border came earlier; answers are remembered.  The ids are then read from the last prefix
backwards.  Where equal scores make the merge order depend on the place (runs of blanks), and only there, the
merges are carried out one by one.

A text is cut where no piece can cross: before a run of blanks that follows other text, and around characters
that occur in no longer piece.  The parts repeat (they are words), so their ids are kept in a bounded table, those
lately used longest.  The new parts of a batch are entered in sorted order: of the prefix table only the prefixes of the
part before are at hand, and a part goes on from those that it shares.

Definitions.  A null text is an empty one, which has no ids.  Texts are encoded whole, however long; repeated rows
are equal; only the text and the id column are read, so other columns may have any name.  The model's
normaliser must be the identity without white-space removal, otherwise loading it raises ValueError.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

BLANK = "▁"
#: in each of two tables: parts lately used, and those used before them
KEPT_PARTS = 180_000
KEPT_PAIRS = 400_000
#: longer parts have a prefix table of their own, which is not kept for the next part
KEPT_LENGTH = 64


class Automaton:
    """Aho-Corasick over pieces; a state can be kept with a prefix and resumed there."""

    def __init__(self, pieces: dict[str, int]):
        tree: list[dict[str, int]] = [{}]
        ends: list[tuple[int, int] | None] = [None]
        for piece, i in pieces.items():
            at = 0
            for ch in piece:
                if (to := tree[at].get(ch)) is None:
                    to = tree[at][ch] = len(tree)
                    tree.append({})
                    ends.append(None)
                at = to
            ends[at] = (i, len(piece))
        self.tree, self.fail = tree, [0] * len(tree)
        self.outputs: list[tuple[tuple[int, int], ...]] = [()] * len(tree)  # longest first
        queue = list(tree[0].values())
        for at in queue:
            own = ends[at]
            self.outputs[at] = ((own,) if own else ()) + self.outputs[self.fail[at]]
            for ch, to in tree[at].items():
                self.fail[to] = self.step(self.fail[at], ch)
                queue.append(to)

    def step(self, state: int, ch: str) -> int:
        tree, fail = self.tree, self.fail
        while (to := tree[state].get(ch)) is None and state:
            state = fail[state]
        return to or 0


#: of a prefix: its last token (-1 - code point: a character without a piece), automaton state, the entry of the prefix before that token
Last = tuple[int, int, "Last | None"]


class PieceModel:
    """A BPE model in SentencePiece's format, with byte fallback."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(serialized)
        norm, kind = proto.normalizer_spec, type(proto.pieces[0])
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models with the identity normaliser are supported")
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        if {kind.USER_DEFINED, kind.UNUSED} & set(self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.normal = kind.NORMAL
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        self.unknown_surface = proto.trainer_spec.unk_surface
        longer = [p for p in self.ids if len(p) > 1]
        joined = set("".join(longer))
        crossing = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in longer)
        loose = "".join(re.escape(chr(c)) for c in range(0, 32) if chr(c) not in joined)
        self.cut = re.compile(f"[{loose}]|{BLANK}*[^{BLANK}{loose}]+|{BLANK}+" if loose else f"{BLANK}*[^{BLANK}]+|{BLANK}+") if not crossing else re.compile("(?s).+")
        seen: dict[float, int] = {}
        for s in self.score.values():
            seen[s] = seen.get(s, 0) + 1
        self.tied = {p for p in longer if seen[self.score[p]] > 1}
        self.ties = sorted({p[:2] for p in self.tied})
        #: what a longer piece's last merge joins
        self.halves = {p: tuple(two) for p in longer if len(two := self.merge(p, 2)) == 2}
        self.stable = {p for p in self.ids if len(p) == 1 or p in self.halves}
        #: the order in which longer pieces are made; None where some piece is never made from its own characters
        self.made = {p: k for k, p in enumerate(sorted(longer, key=self.score.get, reverse=True))} if len(self.stable) == len(self.ids) else None
        self.automaton = Automaton({p: self.ids[p] for p in self.stable - self.tied})
        #: of each right piece: left ones -> whether the two stay apart; the outputs of a state, longest first, with these answers
        self.pairs: dict[int, dict[int, bool]] = {self.ids[p]: {} for p in self.stable - self.tied}
        self.asked = 0
        self.outputs = [tuple([(i, n, self.pairs[i]) for i, n in found]) for found in self.automaton.outputs]
        self.automaton.outputs.clear()
        #: the prefix table: the part before -> the entries of its prefixes, by length
        self.last: dict[str, list[Last | None]] = {}
        self.loose = re.compile(f"[{loose.replace(re.escape(chr(10)), '')}{BLANK}]")
        self.by_lines = not crossing and chr(10) not in joined
        self.surface = [p.replace(BLANK, " ") if k == self.normal else None for p, k in zip(self.pieces, self.kinds)]
        self.texts = [str(i) for i in range(len(self.pieces))]
        #: part -> ids as text; with the ids decoded, where that isn't the part again
        self.parts: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Carry the merges out, while there are more than ``least`` pieces: best score first, then leftmost."""
        if len(text) > 64 and least == 1:
            return self._merge_long(text)
        part, score, worst = list(text), self.score.get, float("-inf")
        found = [score(a + b, worst) for a, b in zip(part, part[1:])]
        while len(found) >= least and (best := max(found)) > worst:
            i = found.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del found[i]
            if i:
                found[i - 1] = score(part[i - 1] + part[i], worst)
            if i < len(found):
                found[i] = score(part[i] + part[i + 1], worst)
        return part

    def _merge_long(self, text: str) -> list[str]:
        part, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else len(part)
            if j < len(part) and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(agenda, (-s, i, j, part[i] + part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while agenda:
            _, i, j, whole = heapq.heappop(agenda)
            if nxt[i] != j or part[i] + part[j] != whole or not part[i] or not part[j]:
                continue
            part[i], part[j], nxt[i] = whole, "", nxt[j]
            if nxt[i] < len(part):
                prv[nxt[i]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [p for p in part if p]

    def _compatible(self, left: int, right: int) -> bool:
        if self.asked >= KEPT_PAIRS:
            for known in self.pairs.values():
                known.clear()
            self.asked = 0
        self.asked += 1
        ok = self.pairs[right][left] = self._stay_apart(self.pieces[left], self.pieces[right])
        return ok

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` gives [a, b]; no tied pieces may occur in it."""
        made = self.made
        if made is None:
            return self.merge(a + b) == [a, b]
        limit = len(made)
        while made.get(a + b, limit) >= limit:
            x, y = made.get(a, -1), made.get(b, -1)
            if x > y:
                a, limit = self.halves[a][1], x
            elif y >= 0:  # of equal merges the left one comes first
                b, limit = self.halves[b][0], y + 1
            else:
                return True
        return False

    def _fallback(self, ch: str) -> list[int]:
        return [self.bytes[b] for b in ch.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def part_ids(self, part: str) -> tuple[int, ...]:
        """The ids of a text that no cut applies to."""
        if part in self.stable and part not in self.tied:
            return (self.ids[part],)
        if any([two in part for two in self.ties]):
            return tuple(x for p in self.merge(part) for x in ([self.ids[p]] if p in self.ids else self._fallback(p)))
        entries: list[Last | None] = [None]
        if len(part) <= KEPT_LENGTH:
            if self.last:
                before, entries = self.last.popitem()
                known = min(len(before), len(part))
                while not part.startswith(before[:known]):
                    known -= 1
                del entries[known + 1 :]
            self.last[part] = entries
        self._extend(part, entries)
        out: list[int] = []
        at = entries[-1]
        while at:  # from the last token backwards
            if (i := at[0]) >= 0:
                out.append(i)
            else:
                out += self._fallback(chr(-1 - i))[::-1]
            at = at[2]
        return tuple(out[::-1])

    def _extend(self, part: str, entries: list[Last | None]) -> None:
        """Append the entries of the prefixes of ``part`` that are missing, each from the automaton state of the one before."""
        tree, fail, outputs = self.automaton.tree, self.automaton.fail, self.outputs
        state = at[1] if (at := entries[-1]) else 0
        for end in range(len(entries), len(part) + 1):
            ch = part[end - 1]
            while (to := tree[state].get(ch)) is None and state:
                state = fail[state]
            state = to or 0
            for i, n, apart in outputs[state]:
                if not (b := entries[end - n]) or ((left := b[0]) >= 0 and ((ok := apart.get(left)) or (ok is None and self._compatible(left, i)))):
                    entries.append((i, state, b))
                    break
            else:
                entries.append((-1 - ord(ch), state, entries[end - 1]))

    def parts_of(self, text: str) -> list[str]:
        """The parts of a text: nothing is ever merged across their ends."""
        if not text:
            return []
        if not self.by_lines or not self.prefix or self.loose.search(text):
            return self.cut.findall(self.prefix + text.replace(" ", BLANK))
        out: list[str] = []
        lead = self.prefix
        for line in text.split("\n"):
            if "  " in line or line[:1] == " " or line[-1:] == " " or (not line and lead):
                out += self.cut.findall(lead + line.replace(" ", BLANK))
            elif line:
                at = len(out)
                out += (BLANK + line.replace(" ", " " + BLANK)).split(" ")
                if not lead:
                    out[at] = out[at][1:]
            out.append("\n")
            lead = ""
        out.pop()
        return out

    def _part(self, part: str) -> str | tuple[str, str]:
        """The entry of a part."""
        if (entry := self.older.get(part)) is None:
            found = self.part_ids(part)
            try:
                back = "".join([self.surface[i] for i in found])
            except TypeError:  # byte pieces
                back = self.decode(found, False)
            entry = ",".join([self.texts[i] for i in found])
            if back != part.replace(BLANK, " "):
                entry = (entry, back)
        if len(part) < 100:
            if len(self.parts) >= KEPT_PARTS:
                self.older, self.parts = self.parts, {}
            self.parts[part] = entry
        return entry

    def _enter(self, texts: list[list[str]]) -> None:
        """Enter the parts of ``texts``, sorted, as far as there is room."""
        parts: set[str] = set()
        for text in texts:
            for at in range(0, len(text), KEPT_PARTS // 4):
                if len(parts) < KEPT_PARTS // 2:
                    parts.update(text[at : at + KEPT_PARTS // 4])
        new = parts - self.parts.keys()
        if len(self.parts) + len(new) > KEPT_PARTS:
            self.older, self.parts, new = self.parts, {}, parts
        for part in sorted(new):
            self._part(part)

    def entries(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Of each text: ids as text, the ids decoded (with the prefix); no part splits a character, so the parts' join to the whole."""
        split = [self.parts_of(t) for t in texts]
        del texts
        self._enter(split)
        for k, parts in enumerate(split):
            split[k], known = [], self.parts
            try:
                found = [known[p] for p in parts]
            except KeyError:
                found = [self.parts.get(p) or self._part(p) for p in parts]
            try:
                yield ",".join(found), "".join(parts).replace(BLANK, " ")
            except TypeError:
                both = [(e, p.replace(BLANK, " ")) if isinstance(e, str) else e for e, p in zip(found, parts)]
                yield ",".join([e[0] for e in both]), "".join([e[1] for e in both])

    def encode(self, text: str) -> list[int]:
        return _ids(self, next(self.entries([text])))

    def decode(self, ids, first: bool = True) -> str:
        """The text of ids: pieces with blanks for their mark, runs of byte pieces as UTF-8; without the prefix if ``first``."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            if run:
                out.append(decode_bytes(bytes(run)))
                run.clear()

        started = not first
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                started = True
                continue
            flush()
            if i == self.unknown:
                out.append(self.unknown_surface)
                started = True
            elif self.kinds[i] == self.normal:
                piece = self.pieces[i]
                if not started and self.prefix and piece.startswith(BLANK):
                    piece = piece[1:]
                started = True
                out.append(piece.replace(BLANK, " "))
        flush()
        return "".join(out)


def decode_bytes(run: bytes) -> str:
    """UTF-8, with one replacement character for each byte that starts no valid sequence."""
    out, at = [], 0
    while at < len(run):
        try:
            out.append(run[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out += [run[at : at + e.start].decode("utf-8"), "�"]
            at += e.start + 1
    return "".join(out)


_models: dict[str, PieceModel] = {}


def model_of(serialized: bytes) -> PieceModel:
    """The model of this worker process, with what it has learnt about parts and pairs; ``_over_texts`` drops it after its task."""
    key = hashlib.sha256(serialized).hexdigest()
    if key not in _models:
        _models[key] = PieceModel(serialized)
    return _models[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _over_texts(docs: DataFrame, model_path: str, id_col: str, schema: str, kinds: list[pa.DataType], row):
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))  # a vocabulary file, half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no reference cycles arise here, and the tables are large
        try:
            model = model_of(shared.value)
            for batch in batches:
                found = model.entries([t or "" for t in batch.column(1).to_pylist()])
                # a few rows at a time: ids take more room than their text
                for at in range(0, batch.num_rows, 64):
                    piece = batch.slice(at, 64)
                    cols = list(zip(*(row(model, entries) for entries in islice(found, 64))))
                    yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, cols, kinds)], names=[id_col, *(f"c{k}" for k in range(len(cols)))])
        finally:  # a worker outlives its task: what it keeps takes memory from others, and building the model takes about a second
            _models.clear()
            model = found = None
            gc.enable()
            gc.collect()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return small_batches(docs.select(id_col, F.col("text").alias("__text"))).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {schema}")


def _ids(model: PieceModel, found: tuple[str, str]) -> list[int]:
    return [int(i) for i in found[0].split(",")] if found[0] else []


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    return _over_texts(docs, model_path, id_col, "ids array<int>", [pa.list_(pa.int32())], lambda m, found: (_ids(m, found),))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows with ``ids``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(i.as_py() or []) for i in batch.column(1)], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def _digests(model: PieceModel, found: tuple[str, str]) -> tuple[int, str, str]:
    ids, back = found
    if model.prefix and ids and model.pieces[int(ids.split(",", 1)[0])].startswith(BLANK):  # the prefix goes once
        back = back[1:]
    return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again, the ids never leaving the task."""
    return _over_texts(docs, model_path, id_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], _digests)
