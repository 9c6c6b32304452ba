"""Personal data: exact base patterns, and a linear-chain conditional random field that adds spans.

The tagger labels words that hold a digit (other words can't be labelled, which cuts the chain exactly
there, so only runs of such words are decoded). Its features are word shapes and cue words before them.
It is trained from the labelled table beside this module by penalised likelihood and decoded by Viterbi
in numpy, many runs at once. A span it finds counts if it overlaps no base span.

Base spans, leftmost and not overlapping within a kind: email, ip (parts at most 255), card (13 to 19
digits that pass Luhn's check), phone (9 to 15 digits). Matching and tagging are linear in the text, in time and
memory, however long its runs are. Positions are code points, ends exclusive.

Defined results: null text is read as empty and has no spans (the hash is that of the empty string);
repeated rows are each answered; a null doc_id is passed on; texts of any length are searched whole; an empty table
gives no rows; other columns are left behind (``masked`` keeps them all; of null text it leaves null)."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import repeats
from brindle.llm._tables import pick
from brindle.llm._text import pieces, strings
from brindle.llm.pii_labelled import lines

BASE = ("email", "ip", "card", "phone")
ADDED = ("phone", "secret", "ssn", "iban")
#: Words that are decoded together, padding included.
CELLS = 1 << 16
ORDER = {k: i for i, k in enumerate((*BASE, "secret", "ssn", "iban"))}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans, by kind as listed, then by start."""
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m.group().count(".") >= 3:
                p, parts = m.start(), m.group().split(".")
                for i in range(0, len(parts) - 3, 4):
                    z = p + sum(map(len, parts[i : i + 4])) + 3
                    if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in parts[i : i + 4]):
                        out.append(("ip", p, z))
                    p = z + 1
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_SPACE = frozenset(" \t\n\v\f\r")
_EDGE = "\"'`,;:!?.()[]{}<>=|“”«»"
_OPEN = "\"'`,;:!?.)]}<>=|“”«»"


def digit_words(text: str) -> list[tuple[int, int, bool]]:
    """Start and end of each word with a digit, trimmed of marks, and whether it directly follows another."""
    out: list[tuple[int, int, bool]] = []
    last = -1
    at = 0
    while m := _DIGIT.search(text, at):
        a = z = m.start()
        while a > 0 and text[a - 1] not in _SPACE and a > at:
            a -= 1
        while z < len(text) and text[z] not in _SPACE:
            z += 1
        follows = last >= 0 and not text[last:a].strip()
        last = at = z
        while z > a and text[z - 1] in _EDGE:
            z -= 1
        while a < z and text[a] in _OPEN:
            a += 1
        if "=" in text[a:z] and "@" not in text[a:z]:
            a = text.rindex("=", a, z) + 1
            while a < z and text[a] in _OPEN:
                a += 1
        if a < z:
            out.append((a, z, follows))
    return out


_CUES = {
    "secret": ("token", "key", "secret", "password", "passwort", "pass", "bearer", "auth", "credential"),
    "ssn": ("ssn", "social", "security"),
    "phone": ("phone", "tel", "call", "appelez", "fax", "mobile"),
    "iban": ("iban", "transfer", "account"),
}
_RUN = re.compile(r"X+|x+|d+|.")


def features(text: str, a: int, z: int) -> list[str]:
    """Shape, length, mixture and the cues just before."""
    w = text[a:z]
    s = "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in w)
    runs = _RUN.findall(s)
    n, d = len(w), s.count("d")
    kinds = "".join(sorted({r[0] if r[0] in "dXx" else "." for r in runs}))
    before = " ".join(re.split(r"[^\w]+", text[max(0, a - 60) : a].lower())[-4:])
    out = [
        "kinds=" + kinds,
        f"kinds,len={kinds},{min(n // 4, 8)}",
        f"switches={min(len(runs), 9) if n > 8 else 0}",
        f"mixed={n >= 10 and 0 < d < n and len(runs) > 4}",
        f"hex={n >= 16 and all(c in '0123456789abcdefABCDEF' for c in w) and 0 < d < n}",
        "digits=" + ("all" if d == n else "some"),
        "shape=" + ("".join(f"{r[0]}{len(r)}" for r in runs) if len(runs) < 6 else "long"),
        "head=" + "".join(f"{r[0]}{len(r)}" for r in runs[:2]),
        "plus=" + str("+" in text[max(0, a - 6) : a + 1]),
        "bias",
    ]
    for kind, words in _CUES.items():
        if any(c in before for c in words):
            out += [f"cue={kind}", f"cue,kinds={kind},{kinds}"]
    return out


class Tagger:
    """The trained field: a weight for each (feature, label) and (label, label)."""

    def __init__(self, kinds: tuple[str, ...] = ADDED):
        self.labels = ["O"] + [f"{p}-{k}" for k in kinds for p in "BI"]
        n = len(self.labels)
        self.allowed = np.zeros((n, n), bool)
        self.begins = np.array([not x.startswith("I-") for x in self.labels])
        for i, x in enumerate(self.labels):
            for j, y in enumerate(self.labels):
                self.allowed[i, j] = not y.startswith("I-") or x[2:] == y[2:] and x != "O"
        self.ids: dict[str, int] = {}
        self.emit = np.zeros((0, n))
        self.pass_ = np.zeros((n, n))

    def emissions(self, runs) -> np.ndarray:
        """The labels' scores for each word of a run, from its features."""
        out = np.array([self.emit[[self.ids[f] for f in fs if f in self.ids]].sum(0) for fs in runs])
        out[0, ~self.begins] = -1e9
        return out

    def scores(self, seqs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of sequences, padded, and their lengths."""
        return _padded([self.emissions(s) for s in seqs])

    def viterbi(self, emissions: list[np.ndarray]) -> list[list[int]]:
        """The best labels of each sequence; all sequences advance together."""
        e, size = _padded(emissions)
        go = np.where(self.allowed, self.pass_, -1e9)
        best, back = e[:, 0], np.zeros(e.shape, np.int8)
        final = best.copy()
        for t in range(1, e.shape[1]):
            step = best[:, :, None] + go
            back[:, t] = step.argmax(1)
            best = step.max(1) + e[:, t]
            final[size > t] = best[size > t]
        out = []
        for i, n in enumerate(size):
            y = [int(final[i].argmax())]
            for t in range(n - 1, 0, -1):
                y.append(int(back[i, t, y[-1]]))
            out.append(y[::-1])
        return out

    def fit(self, table, steps: int = 300, penalty: float = 0.02, rate: float = 0.1) -> Tagger:
        """Trains on (text, spans) rows by gradient ascent on the penalised log-likelihood."""
        seqs, gold = [], []
        for text, spans in table:
            for run in _runs(digit_words(text)):
                seqs.append([features(text, a, z) for a, z in run])
                y, open_ = [], None
                for a, z in run:
                    s = next((s for s in spans if a < s[1] and z > s[0]), None)
                    y.append(self.labels.index("O" if s is None else ("I-" if s is open_ else "B-") + s[2]))
                    open_ = s
                gold.append(y)
        self.ids = {f: i for i, f in enumerate(sorted({f for s in seqs for fs in s for f in fs}))}
        n = len(self.labels)
        self.emit = np.zeros((len(self.ids), n))
        m, v = [0.0, 0.0], [0.0, 0.0]
        for step in range(1, steps + 1):
            grads = self._gradient(seqs, gold)
            for i, name in enumerate(("emit", "pass_")):
                w = getattr(self, name)
                g = grads[i] - penalty * w
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                setattr(self, name, w + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8))
        return self

    def _gradient(self, seqs, gold) -> tuple[np.ndarray, np.ndarray]:
        e, size = self.scores(seqs)
        go = np.where(self.allowed, self.pass_, -1e9)
        ge, gp = np.zeros_like(self.emit), np.zeros_like(self.pass_)
        for i, (s, y) in enumerate(zip(seqs, gold)):
            n = len(s)
            f, b = np.zeros((n, len(self.labels))), np.zeros((n, len(self.labels)))
            f[0] = e[i, 0]
            for t in range(1, n):
                f[t] = np.logaddexp.reduce(f[t - 1][:, None] + go, 0) + e[i, t]
            for t in range(n - 2, -1, -1):
                b[t] = np.logaddexp.reduce(go + e[i, t + 1] + b[t + 1], 1)
            z = np.logaddexp.reduce(f[-1])
            for t in range(n):
                p = -np.exp(f[t] + b[t] - z)
                p[y[t]] += 1
                ge[[self.ids[x] for x in s[t]]] += p
                if t:
                    gp -= np.exp(f[t - 1][:, None] + go + e[i, t] + b[t] - z)
                    gp[y[t - 1], y[t]] += 1
        return ge, gp

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """The spans of each text."""
        seqs, where = [], []
        for i, text in enumerate(texts):
            for run in _runs(digit_words(text)):
                seqs.append(self.emissions(features(text, a, z) for a, z in run))
                where.append((i, run))
        found = []
        order = sorted(range(len(seqs)), key=lambda k: len(seqs[k]))
        lo = 0
        while lo < len(order):
            # runs of like length go together, as many as fill about so many cells when padded
            hi = lo + 1
            while hi < len(order) and hi - lo < 512 and (hi + 1 - lo) * len(seqs[order[hi]]) <= CELLS:
                hi += 1
            block = order[lo:hi]
            for k, y in zip(block, self.viterbi([seqs[k] for k in block])):
                found.append((k, y))
            lo = hi
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for k, y in sorted(found):
            i, run = where[k]
            for (a, z), label in zip(run, y):
                name = self.labels[label]
                if name[0] == "B":
                    out[i].append((name[2:], a, z))
                elif name[0] == "I":
                    out[i][-1] = (name[2:], out[i][-1][1], z)
        return out


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts])
    out = np.zeros((len(parts), int(size.max()), parts[0].shape[1]))
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out, size


def _runs(found: list[tuple[int, int, bool]]) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = []
    for a, z, follows in found:
        if follows and out:
            out[-1].append((a, z))
        else:
            out.append([(a, z)])
    return out


_TRAINED: Tagger | None = None


def trained() -> Tagger:
    global _TRAINED
    if _TRAINED is None:
        _TRAINED = Tagger().fit(lines())
    return _TRAINED


def find(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans, both in order."""
    out = []
    for text, more in zip(texts, tagger.spans(texts)):
        base = base_spans(text)
        if base and more:
            starts, ends = repeats.merged(np.array([b[1] for b in base]), np.array([b[2] for b in base]))
            at = np.searchsorted(starts, [s[2] for s in more]) - 1  # the last that starts before the span's end
            free = (at < 0) | (ends[np.maximum(at, 0)] <= [s[1] for s in more])
            more = [s for s, f in zip(more, free) if f]
        out.append((base, sorted(base + more, key=lambda s: (ORDER[s[0]], s[1]))))
    return out


def _marked(col: pa.Array) -> tuple[list[int], list[str]]:
    """The rows whose bytes hold a digit or @, and their texts; no other row can have a span."""
    buf, offs = strings(col)
    hot = ((buf >= 0x30) & (buf <= 0x39)) | (buf == 0x40)
    n = np.concatenate([[0], np.cumsum(hot)])[offs]
    rows = np.flatnonzero(np.diff(n)).tolist()
    return rows, [buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace") for r in rows]


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def detect(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans of every row."""
    tagger = tagger or trained()
    none = hashlib.sha256(b"").hexdigest()

    @F.arrow_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string>")
    def run(col: pa.Array) -> pa.Array:
        out = []
        for b in pieces([pa.RecordBatch.from_arrays([col], ["t"])], "t"):
            part = [(0, 0, 0, 0, none, "")] * b.num_rows
            rows, texts = _marked(b.column(0))
            for r, (base, spans) in zip(rows, find(texts, tagger)):
                kinds = [s[0] for s in base]
                part[r] = (*(kinds.count(k) for k in BASE), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans))
            out += part
        cols = list(zip(*out)) or [()] * 6
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2)], ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    d = pick(docs, doc_id="bigint", text="string").withColumn("_r", run(F.col("text")))
    return d.select("doc_id", "_r.*")


def redacted(text: Column, tagger: Tagger | None = None) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    tagger = tagger or trained()

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        parts = []
        for b in pieces([pa.RecordBatch.from_arrays([col], ["t"])], "t"):
            t = b.column(0)
            rows, texts = _marked(t)
            new = {}
            for r, text, (_, spans) in zip(rows, texts, find(texts, tagger)):
                if not spans:
                    continue
                out, end = [], 0
                for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= end:
                        out += [text[end:a], f"<{kind}>"]
                    end = max(end, z)
                new[r] = "".join(out) + text[end:]
            if new:
                mask = np.zeros(b.num_rows, bool)
                mask[list(new)] = True
                t = pa.compute.replace_with_mask(t, pa.array(mask), pa.array([new[r] for r in sorted(new)], t.type))
            parts.append(t)
        return pa.chunked_array(parts, col.type).combine_chunks() if parts else col

    return run(text)


def masked(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text``; n_chars, if there, follows. No row is dropped."""
    out = docs.withColumn("text", redacted(F.col("`text`").cast("string"), tagger))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
