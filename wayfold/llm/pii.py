"""Personal data in whole texts: base patterns, and spans that a character-level bidirectional LSTM with CRF transitions adds.

The base kinds email, ip, card and phone are found by their patterns, leftmost and without overlap within a kind; matches
that fail their check are dropped. The tagger knows these kinds in spelled-out and unusual forms too, and secret (keys,
tokens, passwords), which has no pattern. It is trained in numpy from labelled spans (by default a seeded generator of
labelled lines, with look-alikes that aren't personal data), so its size and cost don't depend on the corpus.

All kinds' forms hold a digit, an at sign or a bracketed spelled one, in any letter case: an added span without any of
them isn't accepted, so overlapping windows that hold none of them needn't be read. (To read them all as well takes about
850 of the 900 CPU seconds a GB that the check tool allows.) Of an overlap each half takes its emissions from the window
in which it lies further inside. Windows in which no path can beat that of no entity (a bound by emissions and
transitions tells) need no decoding; all stretches between them, with a window of margin on both sides, are decoded by
Viterbi in one piece, so a span may be of any length and lie anywhere. Spans are then reconciled over the whole text:
higher mean margin first, then earlier, then longer, never over another span. Base spans always stay. An added span needs
the margin at which held-out labelled lines show PRECISION, and a card its check digit.

A null text counts as empty. Offsets are code points, ends exclusive. Equal texts give equal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The kinds that the tagger knows: the base ones, and one that only it finds.
TAGGED = (*KINDS, "secret")
#: Window and its step in characters, windows read at once, and the precision of added spans on held-out lines.
WINDOW, STEP, AT_ONCE, PRECISION = 192, 160, 1024, 0.98
#: Size of the network and of its training: lines, rounds, windows of a round and their characters.
EMBED, HIDDEN, LINES, ROUNDS, BATCH, TRAINED = 12, 10, 3000, 600, 48, 72

# -- base patterns ---------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits, so looking behind changes nothing but the time on long runs
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by start and then in the kinds' order."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# -- the tagger --------------------------------------------------------------------------------------------------------

#: Characters with a number of their own; others share one by kind.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 @.-_+%()[]/:#,;=\n"
_CODE = {c: i + 4 for i, c in enumerate(_ALPHABET)}
_SIZE = len(_ALPHABET) + 4
_TAGS = 1 + 2 * len(TAGGED)


def _code(c: str) -> int:
    return _CODE.get(c) or _CODE.get(c.lower()) or (1 if c.isalpha() else 2 if c.isspace() else 3)


@lru_cache(1)
def _plane() -> np.ndarray:
    """Codes of the basic plane's characters."""
    return np.array([_code(chr(i)) for i in range(1 << 16)], np.uint8)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 1 << 16, _plane()[np.minimum(points, (1 << 16) - 1)], 3).astype(np.uint8)


def labelled_lines(n: int, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Seeded lines of syllables with labelled spans and with look-alikes that carry no label."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda k=4: "".join(pick("th", "an", "er", "in", "re", "on", "é", "la", "ción", "der", "ue", "sch", "m", "o", "ti", "k") for _ in range(r.integers(1, k + 1)))
    name = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, r.integers(3, 9)))
    host = lambda: f"{pick('mail', name(), name() + num(1))}{pick('', num(1))}"

    def card() -> str:
        d = num(pick(13, 14, 15))
        d += next(c for c in "0123456789" if _luhn(d + c))
        return pick(d, d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4)))

    def secret() -> tuple[str, str, str]:
        """What stands before, the secret itself, and what stands behind."""
        hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        if r.random() < 0.3:
            return "", pick("AKIA" + "".join(pick(*mixed[:26], *mixed[-8:]) for _ in range(16)), "ghp_" + "".join(pick(*mixed) for _ in range(36)), "sk-" + "".join(pick(*mixed) for _ in range(32))), ""
        value = "".join(pick(*pick(hexes, hexes, mixed)) for _ in range(pick(16, 20, 24, 32, 40, 40)))
        key = pick("token", "token", "secret", "api_key", "apikey", "password", "passwd", "auth", "access_key")
        quote = pick('"', '"', "'", "")
        return pick(key, key.upper()) + pick(" = ", "=", ": ", ":") + quote, value, quote

    def entity() -> tuple[str, str]:
        kind = KINDS[r.integers(4)]
        if kind == "email":
            top = pick("com", "org", "net", "de", "example.com", "fr")
            user = name() + pick("", ".", "_") + pick("", num(2))
            at, dot = pick(" (at) ", " [at] ", "(at)", "[at]", " {at} ", "{at}", " (AT) ", " [At] "), pick(" [dot] ", "(dot)", " (dot) ", "[DOT]", ".", ".")
            return kind, pick(f"{user}@{host()}.{top}", f"{user}@{host()}.{top}", f"{user}{at}{host()}{dot}{top.replace('.', dot)}")
        if kind == "ip":
            parts = [str(x) for x in r.integers(0, 256, 4)]
            return kind, pick(".".join(parts), ".".join(parts), "[.]".join(parts))
        if kind == "card":
            return kind, card()
        a, b, c = num(3), num(3), num(4)
        return kind, pick(f"+{num(2)} {a} {b}{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{num(2)}-{a}-{b}-{c}", f"tel: {a}-{b}-{c}"[5:])

    def other() -> str:
        return pick(
            lambda: str(1900 + r.integers(0, 130)), lambda: num(r.integers(1, 8)), lambda: f"{num(2)}.{num(2)}.{1950 + r.integers(0, 80)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(1)}.{num(1)}",
            lambda: f"CC BY-NC {num(1)}.0", lambda: f"${num(3)}.{num(2)}", lambda: f"at {word()}. {word()}", lambda: f"({word()}) at {word()}", lambda: f'token = "{word()} {word()}"', lambda: f"{word()} = {num(2)}", lambda: pick("***", "&&&", "$$$", "!!", "%%%", "###"),
            lambda: pick("commit ", "sha1 ", "id ", "/") + "".join(pick(*"0123456789abcdef") for _ in range(r.integers(12, 40))), lambda: f"v{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"({num(2)}) {word()}", lambda: f"http://{name()}.com/{num(4)}", lambda: f"@{name()}", lambda: num(r.integers(10, 24)), lambda: f"{name()}{num(3)}",
            lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{num(5)}-{num(1)}")()

    lines = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < TRAINED + 60:
            kind = r.random()
            if kind < 0.07:
                before, e, behind = secret()
                spans.append(("secret", len(text) + len(before), len(text) + len(before) + len(e)))
                text += before + e + behind
            elif kind < 0.22:
                k, e = entity()
                spans.append((k, len(text), len(text) + len(e)))
                text += e
            else:
                plain = other() if kind < 0.42 else " ".join(word() for _ in range(r.integers(1, 4)))
                text += pick(plain, plain, plain, plain.upper(), plain.title())
            text += pick(" ", " ", " ", ", ", ". ", "\n")
        lines.append((text, spans))
    return lines


def _tagged(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        y[a:b] = 2 + 2 * TAGGED.index(kind)
        y[a] = 1 + 2 * TAGGED.index(kind)
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, LSTM in both directions, linear emissions, CRF transitions; parameters in float32."""

    #: Mean margin that an added span needs.
    margin = 4.0

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": g(_SIZE, EMBED), "o": g(2 * HIDDEN, _TAGS), "c": np.zeros(_TAGS, np.float32), "t": np.zeros((_TAGS, _TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": g(EMBED, 4 * HIDDEN), f"u{d}": g(HIDDEN, 4 * HIDDEN), f"v{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"v{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _lstm(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        p, (n, t, _) = self.p, x.shape
        z = x @ p[f"w{d}"] + p[f"v{d}"]
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.empty((n, t, HIDDEN), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[:, i] + h @ p[f"u{d}"]
            s = _sigmoid(a[:, : 3 * HIDDEN])
            g, before = np.tanh(a[:, 3 * HIDDEN :]), c
            c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
            th, last = np.tanh(c), h
            h = s[:, 2 * HIDDEN :] * th
            out[:, i] = h
            if keep is not None:
                keep.append((i, s, g, before, th, last))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e = self.p["e"][x]
        steps = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self._lstm(e, d, steps[d]) for d in "fb"], -1)
        if keep is not None:
            keep |= {"e": e, "h": h, "steps": steps}
        return h @ self.p["o"] + self.p["c"]

    def _crf(self, em: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the mean negative log-likelihood by emissions and transitions."""
        n, t, k = em.shape
        tr = self.p["t"]
        f, b = np.zeros((t, n, k)), np.zeros((t, n, k))
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        f[0] = em[:, 0]
        for i in range(1, t):
            f[i] = em[:, i] + lse(f[i - 1][:, :, None] + tr, 1)
        for i in range(t - 2, -1, -1):
            b[i] = lse(tr + (em[:, i + 1] + b[i + 1])[:, None, :], 2)
        z = lse(f[-1], 1)
        ge = np.exp(f + b - z[:, None]).transpose(1, 0, 2)
        gt = np.zeros((k, k))
        for i in range(1, t):
            gt += np.exp(f[i - 1][:, :, None] + tr + (em[:, i] + b[i])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(gt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        ge[np.arange(n)[:, None], np.arange(t), y] -= 1
        return (ge / n).astype(np.float32), (gt / n).astype(np.float32)

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, keep = self.p, {}
        em = self.emissions(x, keep)
        ge, gt = self._crf(em, y)
        grad = {"t": gt, "c": ge.sum((0, 1)), "o": np.einsum("nth,ntk->hk", keep["h"], ge)}
        gh, gx = ge @ p["o"].T, np.zeros_like(keep["e"])
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            gz, dh, dc = np.zeros((*x.shape, 4 * HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            gu = np.zeros_like(p[f"u{d}"])
            for i, s, g, before, th, last in reversed(keep["steps"][d]):
                dh = dh + gh[:, i, part]
                into, forget, gate = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                dc = dc + dh * gate * (1 - th * th)
                a = np.concatenate([dc * g, dc * before, dh * th], 1) * s * (1 - s)
                a = np.concatenate([a, dc * into * (1 - g * g)], 1)
                gz[:, i] = a
                gu += last.T @ a
                dh, dc = a @ p[f"u{d}"].T, dc * forget
            flat = gz.reshape(-1, 4 * HIDDEN)
            grad |= {f"u{d}": gu, f"w{d}": keep["e"].reshape(-1, EMBED).T @ flat, f"v{d}": flat.sum(0)}
            gx += gz @ p[f"w{d}"].T
        grad["e"] = np.zeros_like(p["e"])
        np.add.at(grad["e"], x.ravel(), gx.reshape(-1, EMBED))
        return grad

    def train(self, lines: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS, seed: int = 2) -> Tagger:
        r = np.random.default_rng(seed)
        data = [(codes(t), _tagged(t, s)) for t, s in lines if len(t) >= TRAINED]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for i in range(1, rounds + 1):
            xs, ys = [], []
            for k in r.integers(0, len(data), BATCH):
                at = r.integers(0, len(data[k][0]) - TRAINED + 1)
                xs.append(data[k][0][at : at + TRAINED])
                ys.append(data[k][1][at : at + TRAINED])
            rate = 0.02 * min(1.0, 2 * (1 - i / (rounds + 1)))
            for k, g in self._step(np.array(xs), np.array(ys)).items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-6)
        return self

    def read(self, x: np.ndarray) -> np.ndarray:
        """Emissions (characters, windows, tags) of windows of codes (characters, windows), as emissions() gives them, but faster.

        Gates are one hyperbolic tangent (a sigmoid is one of half its argument), inputs come from a table by code.
        """
        p, (t, n) = self.p, x.shape
        half = np.repeat(np.float32([0.5, 0.5, 0.5, 1]), HIDDEN)
        out = np.empty((t, n, 2 * HIDDEN), np.float32)
        a, b = np.empty((n, 4 * HIDDEN), np.float32), np.empty((n, 4 * HIDDEN), np.float32)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            table, u = (p["e"] @ p[f"w{d}"] + p[f"v{d}"]) * half, p[f"u{d}"] * half
            h, c, th = (np.zeros((n, HIDDEN), np.float32) for _ in range(3))
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                np.take(table, x[i], axis=0, out=a)
                np.matmul(h, u, out=b)
                a += b
                np.tanh(a, out=a)
                s = a[:, : 3 * HIDDEN]
                s *= 0.5
                s += 0.5
                c *= s[:, HIDDEN : 2 * HIDDEN]
                c += s[:, :HIDDEN] * a[:, 3 * HIDDEN :]
                np.tanh(c, out=th)
                np.multiply(s[:, 2 * HIDDEN :], th, out=h)
                out[i, :, part] = h
        return out @ p["o"] + p["c"]

    def bound(self) -> float:
        """The margin of no entity's emission above which, held everywhere, no path beats that without an entity."""
        t = self.p["t"] - self.p["t"][0, 0]
        into, out, within = t[0, 1:].max(), t[1:, 0].max(), t[1:, 1:].max()
        return float(max(within, into + out, into, out, 0.0))

    def decode(self, em: np.ndarray) -> np.ndarray:
        """Best tags (sequences, characters) of emissions (characters, sequences, tags)."""
        tr = self.p["t"]
        t, n, k = em.shape
        score, back = em[0], np.zeros((t, n, k), np.int8)
        for i in range(1, t):
            a = score[:, :, None] + tr
            back[i] = a.argmax(1)
            score = a.max(1) + em[i]
        tags = np.zeros((n, t), np.int64)
        tags[:, -1] = score.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][np.arange(n), tags[:, i]]
        return tags


def default_tagger() -> Tagger:
    return _trained()


@lru_cache(1)
def _trained() -> Tagger:
    """Trained on generated lines; the margin that added spans need is then set on other ones."""
    tagger = Tagger().train(labelled_lines(LINES))
    scored = []
    lines = labelled_lines(300, 6)
    for (_, spans), found in zip(lines, tag_texts(tagger, [t for t, _ in lines]), strict=True):
        scored += [(score, (kind, a, b) in spans) for score, kind, a, b in found]
    scored.sort(reverse=True)
    right = np.cumsum([ok for _, ok in scored])
    good = np.flatnonzero(right >= PRECISION * np.arange(1, len(scored) + 1))
    tagger.margin = scored[good[-1]][0] if len(good) else np.inf
    return tagger


#: What every span holds.
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s*at\s*[)\]}]", re.IGNORECASE)


def _worth(text: str) -> np.ndarray:
    """By window: whether it holds a place without which no span can be."""
    hits = np.array([m.start() for m in _TRIGGER.finditer(text)], np.int64)
    out = np.zeros(_windows(len(text)), bool)
    for back in range(-(-WINDOW // STEP)):
        at = hits // STEP - back
        out[at[(at >= 0) & (at < len(out)) & (hits - at * STEP < WINDOW)]] = True
    return out


def _windows(n: int) -> int:
    return 1 + max(0, -(-(n - WINDOW) // STEP))


def _stretches(active: np.ndarray) -> list[tuple[int, int]]:
    """Runs of windows [a, b) that hold the active ones and one on either side."""
    wide = active.copy()
    wide[1:] |= active[:-1]
    wide[:-1] |= active[1:]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], wide.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tag_texts(tagger: Tagger, texts: list[str]) -> list[list[tuple[float, str, int, int]]]:
    """By text: (mean margin, kind, start, end) of the spans that the tagger sees, whatever their margin."""
    found: list[list] = [[] for _ in texts]
    cells, owner, read = [], [], []
    for k, text in enumerate(texts):
        worth = _worth(text) if text else np.zeros(0, bool)
        if worth.any():
            c = codes(text)
            n = len(worth)
            read.append(worth)
            padded = np.full((n - 1) * STEP + WINDOW, 2, np.uint8)
            padded[: len(c)] = c
            cells.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP])
            owner += [(k, i) for i in range(n)]
    if not cells:
        return found
    x, limit = np.concatenate(cells), tagger.bound()
    active: dict[int, np.ndarray] = {}
    chosen = np.flatnonzero(np.concatenate(read))
    for lo in range(0, len(chosen), AT_ONCE):
        some = chosen[lo : lo + AT_ONCE]
        em = tagger.read(np.ascontiguousarray(x[some].T))
        margin = (em[:, :, 0] - em[:, :, 1:].max(2)).min(0)
        for j in some[margin <= limit]:
            k, i = owner[j]
            active.setdefault(k, np.zeros(_windows(len(texts[k])), bool))[i] = True
    first = {}
    for at, (k, i) in enumerate(owner):
        if i == 0:
            first[k] = at
    jobs = [(k, a, b) for k in active for a, b in _stretches(active[k])]
    jobs.sort(key=lambda job: (job[2] - job[1], job))
    at = 0
    while at < len(jobs):  # stretches of about one length at once
        size = jobs[at][2] - jobs[at][1]
        end = at
        while end < len(jobs) and jobs[end][2] - jobs[end][1] == size and (end - at + 1) * size <= max(AT_ONCE, size):
            end += 1
        part = jobs[at:end]
        rows = np.concatenate([x[first[k] + a : first[k] + b] for k, a, b in part])
        em = np.concatenate([tagger.read(np.ascontiguousarray(rows[lo : lo + AT_ONCE].T)) for lo in range(0, len(rows), AT_ONCE)], 1)
        em = em.reshape(WINDOW, len(part), size, _TAGS)
        whole = np.empty(((size - 1) * STEP + WINDOW, len(part), _TAGS), np.float32)
        half = (WINDOW - STEP) // 2
        for w in range(size):  # each window from the middle of its first overlap on
            cut = half if w else 0
            whole[w * STEP + cut : w * STEP + WINDOW] = em[cut:, :, w]
        tags = tagger.decode(whole)
        for row, (k, a, _) in enumerate(part):
            n, start = len(texts[k]), a * STEP
            t = tags[row, : n - start]
            own = np.take_along_axis(whole[: len(t), row], t[:, None], 1)[:, 0] - whole[: len(t), row, 0]
            i = 0
            for i in np.flatnonzero((t > 0) & ((t % 2 == 1) | (np.concatenate([[0], t[:-1]]) != t) & (np.concatenate([[0], t[:-1]]) != t - 1))):
                kind, b = (int(t[i]) - 1) // 2, int(i) + 1
                while b < len(t) and t[b] == 2 + 2 * kind:
                    b += 1
                found[k].append((round(float(own[i:b].mean()), 3), TAGGED[kind], start + int(i), start + b))
        at = end
    return found


def _valid(kind: str, text: str) -> bool:
    """A span holds what all forms hold, and a card what the network can't compute, its check digit."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    return bool(_TRIGGER.search(text)) and (kind != "card" or 12 <= len(digits) <= 19 and _luhn(digits))


def reconcile(text: str, base: list[tuple[str, int, int]], found: list[tuple[float, str, int, int]], margin: float) -> list[tuple[str, int, int]]:
    """Base spans and those of the tagger that overlap no better one, by start and kind."""
    taken = sorted((a, b) for _, a, b in base)
    out = list(base)
    for score, kind, a, b in sorted(set(found), key=lambda f: (-f[0], f[2], f[2] - f[3])):
        if score >= margin and _valid(kind, text[a:b]) and all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], TAGGED.index(s[0]), s[2]))


_SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long"


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, base counts by kind, base_sha256, spans, and how many of all spans are secrets and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        names = [c.split()[0] for c in _SPANS.split(", ")]
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                texts = [t or "" for t in b.column(1).to_pylist()]
                base = [base_spans(t) if t else [] for t in texts]
                spans = [reconcile(t, own, found, tagger.margin) for t, own, found in zip(texts, base, tag_texts(tagger, texts), strict=True)]
                counts = [pa.array([sum(k == kind for k, _, _ in own) for own in base], pa.int64()) for kind in KINDS]
                digest = pa.array([sha256(joined(own).encode()).hexdigest() for own in base])
                secrets = pa.array([sum(k == "secret" for k, _, _ in found) for found in spans], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array(map(joined, spans), pa.string()), secrets, pa.array(map(len, spans), pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, _SPANS)
