r"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The base patterns (email, ip, card, phone) are found leftmost and without overlap per kind; a match that fails its
check is dropped without another try.  The random field labels every word of a line as one of ``LABELS``; it is trained
on a small labelled table (lines of real documents in ``pii_lines.txt``, labelled by reading them, and the lines of
further forms that ``made`` builds) and decoded by Viterbi in numpy, many lines at once.  What it finds
beside the base spans is added: runs of words of one kind, without quotes and punctuation at their ends.
A run that touches a base match, taken or dropped, adds nothing: the pattern has decided there (runs of fewer than 12
digits, which no card could be, have not decided).  Runs of fewer than 7 characters add nothing.

Lines without any digit, ``@`` or other mark hold only words of the plain shape.  ``Field.plain_is_other`` proves
from the weights that their best labelling is all "other", so they are not decoded; if the proof fails they are.

Definitions.  A null text is empty and has no spans.  Offsets are code points, ends exclusive.  Whole texts are searched,
however long, in time linear in their length.  Repeated rows are equal; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb
from .store import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS, "secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a start inside a run of digits could only find what the run's first digit finds
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From every ``@``, its local part to the left and domain to the right."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            yield left, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it passes its check), by kind, then start."""
    out = [("email", a, b, True) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        out.append(("ip", *m.span(), all(len(p) < 4 and int(p) < 256 for p in parts)))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) >= 12:  # shorter runs are neither cards nor anything that the field would name
            out.append(("card", *m.span(), 16 <= len(digits) <= 19 and luhn(digits)))
    for m in _PHONE.finditer(text) if "+" in text else ():
        out.append(("phone", *m.span(), 8 <= sum(map(str.isdigit, m[0])) <= 15))
    return out


# --- word shapes -------------------------------------------------------------------------------------------------------

_FLAGS = {"@": 0, "(": 1, ")": 1, "-": 2, '"': 3, "'": 3, "`": 3, "=": 4, ":": 4, "_": 5, "/": 5}
_flag = np.zeros(256, np.uint16)
for _c, _k in _FLAGS.items():
    _flag[ord(_c)] |= 1 << _k
_flag[[*range(97, 103)]] |= 1 << 6  # hexadecimal letters
_flag[[*range(103, 123), *range(128, 256)]] |= 1 << 7  # further letters
_flag[65:91] |= 1 << 8
_digit = np.zeros(256, bool)
_digit[48:58] = True
_marked = _digit.copy()
_marked[[ord(c) for c in '@()+="`_/:']] = True
#: values of each part of a shape: nine flags, a leading plus, dots, digits, length, and whether an equals sign or colon precedes
SIZES = (2,) * 10 + (3, 6, 5, 2)
RADIX = np.cumprod((1, *SIZES[:-1]))
N_SHAPES = int(np.prod(SIZES))


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The shape of every word [start, end) of ``data``; ``leads``: it begins its line.

    Words without any mark have the plain shape, which is 0 but for what precedes.
    """
    code = np.zeros(len(start), np.int64)
    if not len(start):
        return code
    total = np.concatenate([[0], np.cumsum(_marked[data])])
    some = np.flatnonzero(total[end] > total[start])
    if len(some):
        size = end[some] - start[some]
        first = np.cumsum(size) - size
        at = np.repeat(start[some] - first, size) + np.arange(size.sum())
        b = data[at]
        flags = np.bitwise_or.reduceat(_flag[b], first)
        digits, dots = np.add.reduceat(_digit[b].astype(np.int64), first), np.add.reduceat((b == 46).astype(np.int64), first)
        parts = [(flags >> k & 1).astype(np.int64) for k in range(9)]
        parts.append((data[start[some]] == 43).astype(np.int64))
        parts.append(np.digitize(dots, [1, 3]))
        parts.append(np.digitize(digits, [1, 3, 5, 8, 16]))
        parts.append(np.digitize(size, [4, 9, 20, 32]))
        code[some] = sum(p * r for p, r in zip(parts, RADIX))
    ends_open = np.isin(data[end - 1], (61, 58))
    code[1:] += (ends_open[:-1] & ~leads[1:]) * RADIX[-1]
    return code


# --- the field ---------------------------------------------------------------------------------------------------------


def read_lines(text: str) -> tuple[tuple[tuple[str, int], ...], ...]:
    """Lines of (word, label) from a text with words as they are, or followed by a slash and their label."""
    def one(word: str) -> tuple[str, int]:
        head, _, tail = word.rpartition("/")
        return (head, LABELS.index(tail)) if head and tail in LABELS else (word, 0)

    return tuple(tuple(map(one, line.split())) for line in text.splitlines() if line.strip())


@cache
def labelled() -> tuple[tuple[tuple[str, int], ...], ...]:
    """The training table."""
    return read_lines((Path(__file__).parent / "pii_lines.txt").read_text("utf-8")) + made()


@cache
def made(n: int = 600, seed: int = 3) -> tuple[tuple[tuple[str, int], ...], ...]:
    """Lines of (word, label) in which each form below occurs among plain words, and among look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    run = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    num = lambda k: run("0123456789", k)
    low, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    plain = lambda: run(low + "éüñ", int(rng.integers(1, 11))) + pick(["", "", "", ".", ","])
    forms = {
        1: [lambda: [f"{run(low, 5)}@{run(low, 6)}.{run(low, 3)}"], lambda: [f"{run(low, 4)}.{num(2)}@{run(low, 4)}{num(1)}.{run(low, 7)}.com"], lambda: ["email:", f"{run(low, 6)}_{run(low, 3)}@{run(low, 5)}.org,"]],
        2: [lambda: [".".join(num(int(rng.integers(1, 4))) for _ in range(4))], lambda: [".".join(num(3) for _ in range(4)) + ","]],
        3: [lambda: [num(16)], lambda: [num(4) for _ in range(4)], lambda: ["-".join(num(4) for _ in range(4))], lambda: [num(19)]],
        4: [lambda: ["+1", f"({num(3)})", f"{num(3)}-{num(4)}"], lambda: [f"({num(3)})", f"{num(3)}-{num(4)}"], lambda: [f"{num(3)}-{num(3)}-{num(4)}"], lambda: [f"+{num(2)}", num(3), num(4), num(4)], lambda: [f"+{num(11)}"]],
        5: [lambda: ["token", "=", f'"{run("0123456789abcdef", 40)}"'], lambda: ["key:", run("0123456789abcdef", 32)], lambda: ["secret", "=", f'"{run(mixed, 24)}{num(2)}"'], lambda: [f'api_key="{run("0123456789abcdef", 32)}"'], lambda: [run(mixed, 18) + num(4) + run(mixed, 18)]],
    }
    context = {"token", "=", "key:", "secret", "email:"}
    alike = [lambda: num(int(rng.integers(1, 5))), lambda: f"{num(1)}.{num(2)}", lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"1{num(1)}:{num(2)}", lambda: f"http://{run(low, 6)}.{run(low, 3)}/{run(low, 5)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"({plain()})", lambda: f'"{run(low, 6)}"', lambda: "=", lambda: f"{run(low, 4)}-{run(low, 5)}", lambda: f"{run(low, 4)}/{run(low, 4)}", lambda: num(6), lambda: f"{run(low, 5)}:", lambda: f"${num(3)}.{num(2)}", lambda: run("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 6) + "!!", lambda: f"{num(3)},{num(3)}", lambda: f"{run(low, 3)}_{run(low, 3)}", lambda: f"{run(low, 12)}{num(2)}", lambda: f"#{num(4)}", lambda: f"+{num(1)}"]
    lines = []
    for _ in range(n):
        line = [(plain(), 0) for _ in range(int(rng.integers(1, 7)))]
        for _ in range(int(rng.integers(0, 3))):
            line.insert(int(rng.integers(len(line) + 1)), (pick(alike)(), 0))
        if rng.random() < 0.7:
            kind = int(rng.integers(1, 6))
            at = int(rng.integers(len(line) + 1))
            line[at:at] = [(w, 0 if w in context else kind) for w in pick(forms[kind])()]
        lines.append(tuple(line))
    return tuple(lines)


class Field:
    """Weights of the random field: emissions per part of a shape, transitions, first and last label."""

    def __init__(self, lines=None, rounds: int = 150):
        lines = labelled() if lines is None else lines
        k, length = len(LABELS), max(map(len, lines))
        offsets = np.cumsum((0, *SIZES[:-1]))
        code, gold, live = (np.zeros((len(lines), length), np.int64) for _ in range(3))
        for i, line in enumerate(lines):
            data = " ".join(w for w, _ in line).encode()
            block = tb.Block(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            _, start, end = block.words()
            code[i, : len(line)] = shapes(block.data, start, end, np.arange(len(start)) == 0)
            gold[i, : len(line)] = [y for _, y in line]
            live[i, : len(line)] = 1
        feats = code[:, :, None] // RADIX % SIZES + offsets
        n_feats = int(sum(SIZES))
        p = {"w": np.zeros((n_feats, k)), "t": np.zeros((k, k)), "s": np.zeros(k), "e": np.zeros(k)}
        m1, m2 = ({a: np.zeros_like(b) for a, b in p.items()} for _ in range(2))
        last = live.sum(axis=1) - 1
        rows = np.arange(len(lines))
        eye = np.eye(k)
        for step in range(1, rounds + 1):
            emit = p["w"][feats].sum(axis=2)
            fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
            fwd[:, 0] = p["s"] + emit[:, 0]
            for j in range(1, length):
                fwd[:, j] = _lse(fwd[:, j - 1, :, None] + p["t"], 1) + emit[:, j]
            bwd[rows, last] = p["e"]
            for j in range(length - 2, -1, -1):
                inner = _lse(p["t"] + (emit[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
                bwd[:, j] = np.where((last > j)[:, None], inner, bwd[:, j])
            z = _lse(fwd[rows, last] + p["e"], 1)
            marg = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
            diff = eye[gold] * live[:, :, None] - marg
            g = {"w": np.zeros_like(p["w"]), "s": diff[:, 0].sum(axis=0), "e": (eye[gold[rows, last]] - marg[rows, last]).sum(axis=0)}
            for f in range(len(SIZES)):
                np.add.at(g["w"], feats[:, :, f].reshape(-1), diff.reshape(-1, k))
            both = live[:, 1:, None, None]
            pair = np.exp(fwd[:, :-1, :, None] + p["t"] + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]) * both
            g["t"] = (eye[gold[:, :-1], :, None] * eye[gold[:, 1:], None, :] * both - pair).sum(axis=(0, 1))
            for a in p:
                grad = g[a] - 0.1 * p[a]
                m1[a], m2[a] = 0.9 * m1[a] + 0.1 * grad, 0.99 * m2[a] + 0.01 * grad**2
                p[a] = p[a] + 0.1 * (m1[a] / (1 - 0.9**step)) / (np.sqrt(m2[a] / (1 - 0.99**step)) + 1e-8)
        self.trans, self.first, self.last = p["t"], p["s"], p["e"]
        shape = np.arange(N_SHAPES)
        self.emit = sum(p["w"][shape // r % s + o] for r, s, o in zip(RADIX, SIZES, offsets)).astype(np.float32)

    @property
    def plain_is_other(self) -> bool:
        """Whether words of the plain shape alone are best labelled "other", whatever their number.

        A run of other labels costs at each word what its emission lacks; it wins at most the best entry, exit and steps.
        """
        lack = min(self.emit[c, 0] - self.emit[c, 1:].max() for c in (0, int(RADIX[-1])))
        steps = (self.trans[1:, 1:].max() - self.trans[0, 0]).item()
        entry = max((self.trans[0, 1:] - self.trans[0, 0]).max(), (self.first[1:] - self.first[0]).max())
        leave = max((self.trans[1:, 0] - self.trans[0, 0]).max(), (self.last[1:] - self.last[0]).max())
        return bool(lack > max(entry + leave, steps, 0.0))

    def decode(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Labels of consecutive lines with ``size`` words each."""
        out = np.zeros(len(code), np.int64)
        first = np.cumsum(size) - size
        for lo in range(0, len(size), 4096):
            order = lo + np.argsort(-size[lo : lo + 4096], kind="stable")
            n, at = size[order], first[order]
            if not len(n) or n[0] == 0:
                continue
            live = int((n > 0).sum())
            score = self.first + self.emit[code[at[:live]]]
            links: list[np.ndarray] = []
            done = np.zeros((len(n), len(LABELS)))
            for j in range(1, int(n[0]) + 1):
                more = int((n > j).sum())
                done[more:live] = score[more:live]
                if not more:
                    break
                step = score[:more, :, None] + self.trans
                links.append(step.argmax(axis=1).astype(np.int8))
                score, live = step.max(axis=1) + self.emit[code[at[:more] + j]], more
            label = (done + self.last).argmax(axis=1)
            for j in range(int(n[0]) - 1, -1, -1):
                more = int((n > j).sum())
                out[at[:more] + j] = label[:more]
                if j:
                    link = links[j - 1]
                    label[: len(link)] = link[np.arange(len(link)), label[: len(link)]]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def field_runs(field: Field, block: tb.Block) -> Iterator[tuple[int, str, int, int]]:
    """(row, kind, start, end) in bytes of the block: runs of words that the field labels alike."""
    row, start, end = block.words()
    if not len(row):
        return
    breaks = np.concatenate([[0], np.cumsum(block.data == 10)])
    line = breaks[start] + row  # a new row or line feed starts a new line
    leads = np.ones(len(row), bool)
    leads[1:] = line[1:] != line[:-1]
    code = shapes(block.data, start, end, leads)
    number = np.cumsum(leads) - 1
    want = np.bincount(number, code % RADIX[-1] > 0) > 0 if field.plain_is_other else np.ones(number[-1] + 1, bool)
    pick = np.flatnonzero(want[number])
    if not len(pick):
        return
    size = np.bincount(number[pick], minlength=number[-1] + 1)[want]
    label = field.decode(code[pick], size)
    hit = np.flatnonzero(label)
    if not len(hit):
        return
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (label[hit[1:]] != label[hit[:-1]]) | leads[pick[hit[1:]]]
    opens = np.flatnonzero(new)
    closes = np.concatenate([opens[1:], [len(hit)]]) - 1
    for a, b in zip(hit[opens], hit[closes]):
        yield int(row[pick[a]]), LABELS[label[a]], int(start[pick[a]]), int(end[pick[b]])


_TRIM = "\"'`.,;:!?()[]{}<>*#$%&|"
_ASSIGNED = re.compile(r"^[A-Za-z_-]+[=:][\"'`]?")


def extra_spans(text: str, runs: list[tuple[str, int, int]], base: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int]]:
    """The field's runs (byte offsets in ``text``) as spans in code points, where no base match has decided."""
    out = []
    raw = text.encode() if runs else b""
    for kind, a, b in runs:
        word = raw[a:b].decode("utf-8", "replace")
        s = len(raw[:a].decode("utf-8", "replace"))
        if kind == "secret" and (m := _ASSIGNED.match(word)):
            s, word = s + m.end(), word[m.end() :]
        lead = len(word) - len(word.lstrip(_TRIM.replace("(", "") if kind == "phone" else _TRIM))
        word = word[lead:].rstrip(_TRIM)
        s += lead
        if len(word) >= 7 and not any(x < s + len(word) and s < y for _, x, y, _ in base):
            out.append((kind, s, s + len(word)))
    return out


def _written(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, "secret"))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row; the counts are of base spans."""
    field = _field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for block in tb.blocks(batch.column(1)):
                runs: dict[int, list[tuple[str, int, int]]] = {}
                for r, kind, a, b in field_runs(field, block):
                    runs.setdefault(r, []).append((kind, a - int(block.at[r]), b - int(block.at[r])))
                marked = block.count(_digit[block.data] | (block.data == 64))
                for r in range(block.n):
                    text = block.text(r) if marked[r] or r in runs else ""
                    found = base_matches(text) if marked[r] else []
                    base = [(k, a, b) for k, a, b, ok in found if ok]
                    for i, kind in enumerate(KINDS):
                        cols[i].append(sum(k == kind for k, _, _ in base))
                    written = _written(base)
                    cols[4].append(hashlib.sha256(written.encode()).hexdigest())
                    more = extra_spans(text, runs[r], found) if r in runs else []
                    cols[5].append(_written(base + more) if more else written)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


@cache
def _field() -> Field:
    """The field as trained from ``labelled``, once per process."""
    return Field()
