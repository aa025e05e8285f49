"""Personal data: rule spans, and spans added by a character BiLSTM-CRF.

Rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers, leftmost
and without overlap per kind. A character-level bidirectional LSTM with CRF
transitions, trained in numpy on generated labelled spans, adds spans in spellings
that the rules miss (spelled-out addresses, phone numbers without a plus, cards with
other separators, secrets). Rule spans always stay; an added span never touches one.

A span that is added must be plausible for its kind, and every plausible span holds a
digit or a spelled-out "at" and "dot" around a host name: such a mark is part of what is
asked of a span (``plausible``), so tagging the surroundings of all marks, in overlapping
windows, loses nothing that could be returned. Pieces of spans cut by windows are joined,
and the windows' spans are reconciled over the whole text by weighted interval
scheduling; of equally long choices the one that ends first stays.

Counts and base_sha256 cover the rule spans; spans lists both. A null text counts as
empty: no spans. Offsets are code points, end exclusive; texts are read whole, whatever
their length. Repeated rows are treated alike, null ids kept, extra columns ignored, and
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_of, small_batches

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
WINDOW, STRIDE, MARGIN = 96, 48, 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: The signs of a spelled-out address: an "at" and a "dot" in brackets or between blanks, or the sign itself.
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?i:at)\s?[\])}>]\s?|\s(?i:at)\s)"
_DOT = r"(?:\.|\s\.\s|\s?[\[({<]\s?(?i:dot|\.)\s?[\])}>]\s?|\s(?i:dot)\s)"
_ADDRESS = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_MARK = re.compile(rf"[0-9]+|{_AT}[\w-]+{_DOT}[\w-]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(s: str) -> list[tuple[int, int]]:
    """Matches of local@domain in time linear in the text: found at the at sign, then grown to the left."""
    out, low, at = [], 0, s.find("@")
    while at >= 0:
        m = _DOMAIN.match(s, at)
        nxt = at + 1
        if m:
            i = at
            while i > low and s[i - 1] in _LOCAL:
                i -= 1
            if i < at:
                out.append((i, m.end()))
                low = nxt = m.end()
        at = s.find("@", nxt)
    return out


def base_spans(s: str) -> list[Span]:
    """Rule spans by kind, then start."""
    out = [("email", a, b) for a, b in emails(s)] if "@" in s else []
    for m in _IP.finditer(s):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(s):
        if m.end() - m.start() >= 16:
            digits = re.sub("[ -]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in s:
        for m in _PHONE.finditer(s):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- the tagger -------------------------------------------------------------------

_SIGNS = "@.+-()[]{}<>:=\"'_/\\, \n"
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
N_CHARS = 1 + 26 + 26 + 1 + len(_SIGNS) + 2


def _char_table() -> np.ndarray:
    """Id of every code point below 0x250; beyond it, letters and other signs share one each."""
    out = np.full(0x250, N_CHARS - 1, np.int64)
    for c in range(0x250):
        ch = chr(c)
        if "a" <= ch <= "z":
            out[c] = 1 + c - 97
        elif "A" <= ch <= "Z":
            out[c] = 27 + c - 65
        elif "0" <= ch <= "9":
            out[c] = 53
        elif ch in _SIGNS:
            out[c] = 54 + _SIGNS.index(ch)
        elif ch.isalpha():
            out[c] = N_CHARS - 2
    return out


_TABLE = _char_table()


def encode(s: str) -> np.ndarray:
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(cp, 0x24F)]


def allowed() -> np.ndarray:
    """Transition mask: I-k follows only B-k or I-k."""
    ok = np.zeros((len(TAGS), len(TAGS)), np.float32)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, f in enumerate(TAGS):
                if f[1:] != t[1:]:
                    ok[i, j] = -1e4
    return ok


class Tagger:
    """BiLSTM over characters with a linear-chain CRF on top; arrays are (time, batch, ...)."""

    def __init__(self, dim: int = 12, hidden: int = 24, seed: int = 1):
        r = np.random.default_rng(seed)
        k = len(TAGS)
        self.h = hidden
        init = lambda *s: (r.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": init(N_CHARS, dim) * 3, "W": init(2 * hidden, k), "c": np.zeros(k, np.float32), "T": np.zeros((k, k), np.float32), "S": np.zeros(k, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p |= {f"X{d}": init(dim, 4 * hidden), f"H{d}": init(hidden, 4 * hidden), f"B{d}": bias}
        self.mask = allowed()
        self.first = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states of one direction for embedded input x (time, batch, dim)."""
        h = self.h
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        pre = x @ self.p[f"X{d}"] + self.p[f"B{d}"]
        out = np.zeros((len(x), x.shape[1], h), np.float32)
        hs = cs = np.zeros((x.shape[1], h), np.float32)
        kept = {}
        for t in steps:
            a = pre[t] + hs @ self.p[f"H{d}"]
            g = 1 / (1 + np.exp(-a[:, : 3 * h]))
            u = np.tanh(a[:, 3 * h :])
            i, f, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            c = f * cs + i * u
            tc = np.tanh(c)
            if keep:
                kept[t] = (hs, cs, i, f, o, u, tc)
            hs, cs = o * tc, c
            out[t] = hs
        return out, kept

    def back(self, x: np.ndarray, d: str, kept: dict, dout: np.ndarray, grad: dict) -> np.ndarray:
        h = self.h
        steps = range(len(x) - 1, -1, -1) if d == "f" else range(len(x))
        da = np.zeros((len(x), x.shape[1], 4 * h), np.float32)
        dh = dc = np.zeros((x.shape[1], h), np.float32)
        gh = np.zeros_like(self.p[f"H{d}"])
        for t in steps:
            hp, cp, i, f, o, u, tc = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc**2)
            da[t] = np.concatenate([dc * u * i * (1 - i), dc * cp * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1)
            gh += hp.T @ da[t]
            dh = da[t] @ self.p[f"H{d}"].T
            dc = dc * f
        flat = da.reshape(-1, 4 * h)
        grad[f"H{d}"], grad[f"B{d}"], grad[f"X{d}"] = gh, flat.sum(axis=0), x.reshape(-1, x.shape[2]).T @ flat
        return da @ self.p[f"X{d}"].T

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["E"][ids]
        return np.concatenate([self.run(x, "f")[0], self.run(x, "b")[0]], axis=2) @ self.p["W"] + self.p["c"]

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood per window and its gradient."""
        n, m = ids.shape
        x = self.p["E"][ids]
        (hf, kf), (hb, kb) = self.run(x, "f", True), self.run(x, "b", True)
        hid = np.concatenate([hf, hb], axis=2)
        e = hid @ self.p["W"] + self.p["c"]
        trans, start = self.p["T"] + self.mask, self.p["S"] + self.first
        alpha = np.zeros_like(e)
        alpha[0] = e[0] + start
        for t in range(1, n):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + trans[None], 1) + e[t]
        beta = np.zeros_like(e)
        for t in range(n - 2, -1, -1):
            beta[t] = _lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        gt = np.zeros_like(trans)
        for t in range(1, n):
            gt += np.exp(alpha[t - 1][:, :, None] + trans[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        gs = de[0].sum(axis=0)
        rows = np.arange(m)
        gold = start[tags[0]] + e[0, rows, tags[0]]
        np.add.at(gs, tags[0], -1)
        for t in range(n):
            de[t, rows, tags[t]] -= 1
            if t:
                gold = gold + trans[tags[t - 1], tags[t]] + e[t, rows, tags[t]]
                np.add.at(gt, (tags[t - 1], tags[t]), -1)
        grad = {"T": gt, "S": gs}
        flat = de.reshape(-1, de.shape[2])
        grad["W"], grad["c"] = hid.reshape(-1, 2 * self.h).T @ flat, flat.sum(axis=0)
        dhid = de @ self.p["W"].T
        dx = self.back(x, "f", kf, dhid[:, :, : self.h], grad) + self.back(x, "b", kb, dhid[:, :, self.h :], grad)
        ge = np.zeros_like(self.p["E"])
        np.add.at(ge, ids.ravel(), dx.reshape(-1, dx.shape[2]))
        grad["E"] = ge
        return float((z - gold).mean()), {k: v / m for k, v in grad.items()}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi tags (time, batch)."""
        e = self.emissions(ids)
        trans = (self.p["T"] + self.mask)[None]
        score = e[0] + self.p["S"] + self.first
        came = np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            s = score[:, :, None] + trans
            came[t] = s.argmax(axis=1)
            score = s.max(axis=1) + e[t]
        out = np.zeros(ids.shape, np.int64)
        out[-1] = score.argmax(axis=1)
        rows = np.arange(ids.shape[1])
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = came[t, rows, out[t]]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis=axis, keepdims=True)) + m).squeeze(axis)


# --- labelled spans ---------------------------------------------------------------

_SYLLABLES = "th er on an re in ti es of and ing ion eau le que aux ée un der sch ung keit lich ver ó ción ado rr do é ü".split()


def _word(r: Random) -> str:
    x = r.random()
    w = r.choice(_COMMON) if x < 0.3 else _letters(r, 2, 9) if x < 0.4 else "".join(r.choices(_SYLLABLES, k=r.randint(1, 3)))
    x = r.random()
    return w.capitalize() if x < 0.12 else w.upper() if x < 0.15 else w


def _digits(r: Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


#: Common given names, English words and domains, so that training text is not all invented.
_NAMES = "john mary bob alice anna peter maria james linda sven yuki omar fatima jean luc carlos elena ivan olga kim lee hans greta paul sofia smith jones brown garcia muller rossi".split()
_COMMON = "the a of to and in is it for on with as was be by at from or an this that are not have you we they he she his her but can will one all their there what so up out if about who get which go me when make like time no just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us contact write mail reach please send call office home meeting noon page map line red small point dot".split()
_TLDS = "com org net io fr de edu gov co es info eu uk".split()


def _letters(r: Random, a: int, b: int) -> str:
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(a, b)))


def _label(r: Random) -> str:
    """A word as names and hosts have them."""
    return r.choice([lambda: "".join(r.choices(_SYLLABLES[:12], k=r.randint(1, 3))), lambda: r.choice(_NAMES), lambda: _letters(r, 2, 10), lambda: r.choice(_COMMON), lambda: _letters(r, 3, 8) + _digits(r, r.randint(1, 3))])()


def _host(r: Random) -> list[str]:
    return [*([r.choice(["mail", "mx", "news", "www", f"mail{r.randint(0, 9)}", _label(r)])] if r.random() < 0.35 else []), r.choice(["example", _label(r), f"{_label(r)}-{_label(r)}"]), r.choice(_TLDS)]


def _personal(r: Random) -> tuple[str, str]:
    """(kind, text) of one labelled span."""
    kind = r.choices(KINDS, [34, 14, 18, 20, 16])[0]
    if kind == "email":
        name = _label(r) + r.choice(["", "", "", "", "", f".{_digits(r, 2)}", f"_{_digits(r, 1)}", f".{_label(r)}", f"_{_label(r)}", f"-{_label(r)}", f"+{_letters(r, 2, 6)}"])
        at = r.choice(["@", "@", " @ ", " [at] ", " (at) ", "[at]", "(at)", " {at} ", "<at>", *[" at "] * 5])
        dots = [".", " dot ", " dot "] if at == " at " else ["."] if at == "@" else [".", " dot ", " [dot] ", " (dot) ", "[dot]", "(dot)", "{dot}", "[.]"]
        host = _host(r)
        text = host[0]
        dot = r.choice(dots)
        for k, part in enumerate(host[1:]):  # a plain stop before the last sign, now and then
            text += ("." if k < len(host) - 2 and r.random() < 0.4 else dot) + part
        if r.random() < 0.1:
            at, text = at.upper(), text.replace("dot", "DOT")
        name = name.capitalize() if r.random() < 0.15 else name
        return kind, name + at + text
    if kind == "ip":
        return kind, r.choice([".", ".", "[.]", " . ", "(.)"]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = _digits(r, 16)
        return kind, r.choice(["", "", " ", "-", ".", "_", "/"]).join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return kind, r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"+{_digits(r, 2)} {a} {b} {c}", f"0{a[:2]} {b} {c}", f"({a}) {b} {c}"])
    chars = r.choice(["0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
    body = "".join(r.choices(chars, k=r.choice([16, 20, 24, 32, 36, 40, 40, 48]))) + _digits(r, 1)
    key = r.choice(["token", "token", "secret", "api_key", "password", "access_key", "apikey", "client_secret", "auth_token"])
    x = r.random()
    if x < 0.12:
        return kind, r.choice(["AKIA", "ghp_", "sk_live_", "xoxb"]) + body
    return kind, f'{key} = "{body}"' if x < 0.65 else f"{key}: {body}" if x < 0.8 else f"{key}={body}" if x < 0.9 else f"{key} = '{body}'"


def _harmless(r: Random) -> str:
    """Marks that are no personal data."""
    n = r.randint
    return r.choice([str(n(0, 3000)), f"{n(0, 20)}.{n(0, 10)}", f"version {n(1, 9)}.{n(0, 9)}.{n(0, 9)}", f"{n(1900, 2030)}-{n(10, 12)}-{n(10, 28)}", f"{n(1, 100)}%", f"{n(1, 24)}:{n(10, 59)}", f"${n(1, 900)}.{n(10, 99)}", f"CC BY-NC {n(1, 5)}.0.", f"Version {n(1, 4)}.0.", "a dot in", f"{n(1, 99)},{n(100, 999)}", "@ home", f"no. {n(1, 99)}", str(n(10000, 9999999)), f"page {n(1, 999)} of {n(1, 999)}", f"[{n(1, 50)}]", f"§ {n(1, 99)}.{n(1, 9)}", "dot dot", "(at noon)", f"at {r.choice(_COMMON)}", f"look at the {r.choice(_COMMON)} dot on", f"met at {_label(r)}.", f"at {_label(r)}. {_label(r)}", f"{_label(r)}.{r.choice(_TLDS)}", "the dot at the end", f"at {n(1, 12)}.{n(10, 59)}", f"id {_letters(r, 4, 12)}{n(1, 99)}"])


def labelled(r: Random, length: int = WINDOW) -> tuple[str, list[Span]]:
    """Invented prose of at least ``length`` characters with labelled spans."""
    parts, spans, at = [], [], 0
    junk = r.choice(["", "", "", "", "!!", "###", "$$$", "&&&", "%%%", "***"])
    want = r.randint(0, 2) + length // 200
    while at < length + 40:
        x, kind = r.random(), None
        if want and x < 0.12:
            kind, piece = _personal(r)
            spans.append((kind, at, at + len(piece)))
            want -= 1
        else:
            piece = _harmless(r) if x > 0.92 else _word(r)
        piece += junk + r.choice([" ", " ", " ", " ", "\n", ", ", ". ", ": "])
        parts.append(piece)
        at += len(piece)
    return "".join(parts), spans


def tagged(s: str, spans: list[Span], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = encode(s), np.zeros(len(s), np.int64)
    for k, a, b in spans:
        tags[a:b] = TAGS.index(f"I-{k}")
        tags[a] = TAGS.index(f"B-{k}")
    ids, tags = ids[lo:hi], tags[lo:hi]
    if len(tags) and TAGS[tags[0]][0] == "I":  # a span cut by the window begins there
        tags[0] -= 1
    return ids, tags


@lru_cache(maxsize=4)
def train(steps: int = 900, batch: int = 48, seed: int = 3) -> Tagger:
    """Adam on generated windows; deterministic, and done once in a driver process."""
    r = Random(seed)
    model = Tagger()
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        ids, tags = np.zeros((WINDOW, batch), np.int64), np.zeros((WINDOW, batch), np.int64)
        for b in range(batch):
            s, spans = labelled(r)
            lo = r.randint(0, len(s) - WINDOW)
            ids[:, b], tags[:, b] = tagged(s, spans, lo, lo + WINDOW)
            if r.random() < 0.2:
                n = r.randint(1, 39)
                ids[-n:, b] = 0
                tags[-n:, b] = 0
        _, grad = model.loss(ids, tags)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        lr = 0.015 * min(1, step / 30) * (0.05 ** (step / steps))
        for k, g in grad.items():
            g = g * min(1, 5 / norm)
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g**2
            model.p[k] = (model.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# --- windows ----------------------------------------------------------------------


def windows_of(s: str) -> list[tuple[int, int, int, int]]:
    """(start, end, region start, region end) of overlapping windows around all marks."""
    regions: list[list[int]] = []
    for m in _MARK.finditer(s):
        a, b = max(0, m.start() - MARGIN), min(len(s), m.end() + MARGIN)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        at = a
        while True:
            out.append((at, min(b, at + WINDOW), a, b))
            if at + WINDOW >= b:
                break
            at += STRIDE
    return out


def spans_of(tags: np.ndarray, offset: int) -> list[Span]:
    out, start = [], -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and TAGS[t][0] != "I":
            out.append((kind, offset + start, offset + i))  # noqa: F821
            start = -1
        if TAGS[t][0] == "B":
            start, kind = i, TAGS[t][2:]  # noqa: F841
    return out


_SECRET = re.compile(r"""[A-Za-z_]+ ?[=:] ?["']?[0-9A-Za-z_]{16,}["']?""")


def tightened(s: str, span: Span) -> Span:
    """A secret runs from its key to the end of its value, an address from its name to the end of its host."""
    kind, a, b = span
    if kind == "secret":
        m = _SECRET.search(s, a, b)
        return (kind, *m.span()) if m else span
    if kind == "email" and not _ADDRESS.fullmatch(s, a, b):
        for m in _ADDRESS.finditer(s, max(0, a - MARGIN), b + MARGIN):
            if m.start() < b and a < m.end():
                return (kind, *m.span())
    return span


def plausible(s: str, span: Span) -> bool:
    """What a span of its kind must hold."""
    kind, a, b = span
    t = s[a:b]
    digits = sum(c in "0123456789" for c in t)
    if kind == "email":
        return bool(_ADDRESS.fullmatch(t))
    if kind == "ip":
        parts = re.findall("[0-9]+", t)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= digits <= 19 and not re.search(r"[^\W\d_]", t) and luhn("".join(re.findall("[0-9]", t)))
    if kind == "phone":
        return 8 <= digits <= 15 and not re.search(r"[^\W\d_]", t)
    return bool(re.search(r"[0-9A-Za-z]{16,}", t)) and digits > 0


def reconcile(cands: set[Span], taken: list[Span]) -> list[Span]:
    """Non-overlapping spans of greatest total length, clear of the spans already taken."""
    base = sorted((a, b) for _, a, b in taken)
    starts, free = [a for a, _ in base], []
    reach = np.maximum.accumulate([b for _, b in base]).tolist() if base else []
    for c in sorted(cands, key=lambda x: (x[2], x[1], x[0])):
        k = bisect_left(starts, c[2])
        if not k or reach[k - 1] <= c[1]:
            free.append(c)
    ends, best = [c[2] for c in free], [(0, -1, False)]
    for i, (_, a, b) in enumerate(free):
        j = int(np.searchsorted(ends, a, side="right"))
        with_it = best[min(j, i)][0] + b - a
        best.append((with_it, min(j, i), True) if with_it > best[i][0] else (best[i][0], i, False))
    out, i = [], len(free)
    while i > 0:
        _, j, took = best[i]
        if took:
            out.append(free[i - 1])
        i = j
    return out[::-1]


def whole_spans(pieces: list[tuple[str, int, int, bool, bool]]) -> list[Span]:
    """Spans cut by windows' inner edges (kind, start, end, cut at start, cut at end), joined where they overlap."""
    out, held = [], None
    for kind, a, b, left, right in sorted(pieces):
        if held and held[0] == kind and a < held[2]:
            if b > held[2]:
                held[2], held[4] = b, right
            elif b == held[2]:
                held[4] = held[4] and right
            if a == held[1]:
                held[3] = held[3] and left
            continue
        if held and not held[3] and not held[4]:
            out.append(tuple(held[:3]))
        held = [kind, a, b, left, right]
    if held and not held[3] and not held[4]:
        out.append(tuple(held[:3]))
    return out


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans that the tagger adds to each text's rule spans."""
    jobs = [(k, *w) for k, s in enumerate(texts) for w in windows_of(s)]
    cands: list[set[Span]] = [set() for _ in texts]
    pieces: list[list[tuple]] = [[] for _ in texts]
    for n in range(0, len(jobs), 256):
        lot = jobs[n : n + 256]
        ids = np.zeros((WINDOW, len(lot)), np.int64)
        for c, (k, a, b, _, _) in enumerate(lot):
            ids[: b - a, c] = encode(texts[k][a:b])
        tags = model.decode(ids)
        for c, (k, a, b, lo, hi) in enumerate(lot):
            for raw in spans_of(tags[: b - a, c], a):
                left, right = raw[1] == a and a > lo, raw[2] == b and b < hi
                if left or right:
                    pieces[k].append((*raw, left, right))
                span = tightened(texts[k], raw)
                cut_off = span[1] == a and a > lo or span[2] == b and b < hi
                if not cut_off and plausible(texts[k], span):
                    cands[k].add(span)
    for k, cut in enumerate(pieces):
        whole = (tightened(texts[k], x) for x in whole_spans(cut))
        cands[k].update(x for x in whole if plausible(texts[k], x))
    return [reconcile(c, b) if c else [] for c, b in zip(cands, base)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame) -> DataFrame:
    """Rule and added spans of every document's whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            texts = [t or "" for t in ids_of(b, "text")]
            base = [base_spans(t) for t in texts]
            more = added_spans(model, texts, base)
            cols = [pa.array(ids_of(b), pa.int64())]
            cols += [pa.array([sum(x[0] == k for x in s) for s in base], pa.int64()) for k in BASE]
            cols.append(pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base]))
            cols.append(pa.array([joined([*s, *m]) for s, m in zip(base, more)], pa.string()))
            cols.append(pa.array([len(m) for m in more], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
