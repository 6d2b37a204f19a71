"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy, on windows of the corpus in which the base patterns give the spans, and on windows with
generated spans put in, among them forms that the patterns miss. A window of the corpus with a number that could be such a form
(doubtful) isn't trained on: nobody has said that it is none. Texts are then tagged in windows that overlap by half. Every
kind of span needs a digit or an @, so windows without either have no span and are not run. Each window is decoded by
Viterbi under the CRF's transitions, and its spans are reconciled over the whole text: a span counts in the window in whose
middle it begins, spans of one kind that overlap are joined, and of spans that clash the base span or else the earlier and
longer one stays. A decoded span must also look like its kind (enough digits, dots or an @).

The sample for training is bounded: of at most SAMPLE_ROWS documents, those with the least hashes of their ids, all windows with
a digit or an @ and one that a hash picks are candidates; SAMPLE_WINDOWS with such a mark and a third as many without are
taken, those with the least hashes. Decoding covers all texts.

Defined cases: null text counts as empty; an empty text has no spans, and base_sha256 is then the digest of the empty
string; repeated rows are tagged alike; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import only, slices, texts, unknown

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 4_000
SAMPLE_WINDOWS = 1_500
MADE_WINDOWS = 4_000
WINDOW = 96
STRIDE = WINDOW // 2
#: Windows that are run through the network at once.
AT_ONCE = 256

Span = tuple[str, int, int]

# --- base patterns

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number can't begin within a run of digits: had it matched there, it would have matched from the run's start
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches, found from each @ outwards, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", domain.end() if domain else at + 1)


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [("email", *x) for x in emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return ordered(found)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- the network

TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
OTHER = 128


def codes(texts_: list[str], width: int = WINDOW) -> np.ndarray:
    """Characters as numbers: ASCII as it is, one number for the rest, one for what lies beyond the end."""
    out = np.full((len(texts_), width), OTHER + 1, np.int64)
    for row, t in zip(out, texts_, strict=True):
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        row[: len(c)] = np.minimum(c, OTHER)
    return out


def tags(spans: list[Span], width: int = WINDOW) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 * k + 2
        out[a] = 2 * k + 1
    return out


def allowed() -> np.ndarray:
    """Inside follows begin or inside of its own kind only."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 * k + 2] = False
        ok[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
    return ok


BARRED = np.where(allowed(), 0.0, -1e4).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions; parameters are float32 arrays in a dict."""

    def __init__(self, seed: int = 0, width: int = 16, hidden: int = 24):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"embed": w(OTHER + 2, width) * 4, "out": w(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": w(width, 4 * hidden), f"h{d}": w(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def lstm(self, x: np.ndarray, keep: bool):
        """Hidden states of both directions (time, batch, 2 * hidden) and, if kept, what the way back needs.

        The second direction reads the time backwards; both go through the same steps at once.
        """
        steps, n, k = len(x), x.shape[1], self.hidden
        both = np.stack([x, x[::-1]])
        pre = np.matmul(both.reshape(2, steps * n, -1), self.both("x")).reshape(2, steps, n, 4 * k) + self.both("c")[:, None, None]
        wh = self.both("h")
        h = c = np.zeros((2, n, k), np.float32)
        out, kept = np.empty((2, steps, n, k), np.float32), []
        for t in range(steps):
            z = pre[:, t] + np.matmul(h, wh)
            gates = sigmoid(z[..., : 3 * k])
            i, f, o = gates[..., :k], gates[..., k : 2 * k], gates[..., 2 * k :]
            g = np.tanh(z[..., 3 * k :])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                kept.append((gates, g, c, tc, h))
            h, c = o * tc, c_new
            out[:, t] = h
        return np.concatenate([out[0], out[1, ::-1]], axis=2), (both, kept)

    def both(self, name: str) -> np.ndarray:
        return np.stack([self.p[f"{name}f"], self.p[f"{name}b"]])

    def emissions(self, chars: np.ndarray, keep: bool = False):
        h, kept = self.lstm(self.p["embed"][chars.T], keep)
        return h @ self.p["out"] + self.p["bias"], (h, kept)

    def loss(self, chars: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the gold tags and its gradient."""
        e, (h, kept) = self.emissions(chars, True)
        steps, n = e.shape[:2]
        y = gold.T
        trans, first = self.p["step"] + BARRED, self.p["first"]
        # the CRF's sums from the left, with the first tag's score, and from the right, each with its own emission
        sums = np.empty((2, steps, n, TAGS), e.dtype)
        sums[0, 0], sums[1, 0] = first + e[0], e[-1]
        moves = np.exp(np.stack([trans, trans.T]))
        back = e[::-1]
        for t in range(1, steps):
            top = sums[:, t - 1].max(axis=-1, keepdims=True)
            some = np.log(np.maximum(np.matmul(np.exp(sums[:, t - 1] - top), moves), 1e-37)) + top
            sums[0, t], sums[1, t] = some[0] + e[t], some[1] + back[t]
        alpha, right = sums[0], sums[1, ::-1]
        z = logsumexp(alpha[-1], 1)
        rows = np.arange(n)
        picked = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0]
        gold_score = first[y[0]] + picked.sum(axis=0) + trans[y[:-1], y[1:]].sum(axis=0)
        de = np.exp(alpha + right - e - z[:, None])
        # expected moves: the products of both sides' sums, added up over all steps by one product of matrices
        top_a, top_b = alpha[:-1].max(axis=2, keepdims=True), right[1:].max(axis=2, keepdims=True)
        left = np.exp(alpha[:-1] - top_a + np.minimum(top_a + top_b - z[:, None], 80))
        dtrans = moves[0] * (left.reshape(-1, TAGS).T @ np.exp(right[1:] - top_b).reshape(-1, TAGS))
        np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), -1)
        de[np.arange(steps)[:, None], rows, y] -= 1
        de /= n
        g = {"step": dtrans / n, "first": de[0].sum(axis=0), "bias": de.sum(axis=(0, 1)), "out": h.reshape(-1, h.shape[2]).T @ de.reshape(-1, TAGS)}
        dx = self.lstm_back(kept, de @ self.p["out"].T, g)
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], chars.T.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((z - gold_score).mean()), g

    def lstm_back(self, kept: tuple, dh: np.ndarray, g: dict) -> np.ndarray:
        """Adds the LSTMs' gradients to g; returns that of their input."""
        both, steps_kept = kept
        k, steps, n = self.hidden, len(dh), dh.shape[1]
        d = np.stack([dh[:, :, :k], dh[::-1, :, k:]])
        back = np.ascontiguousarray(self.both("h").transpose(0, 2, 1))
        dz, before = np.empty((2, steps, n, 4 * k), dh.dtype), np.empty((2, steps, n, k), dh.dtype)
        back_h = back_c = np.zeros((2, n, k), dh.dtype)
        for t in range(steps - 1, -1, -1):
            gates, gg, c, tc, h_before = steps_kept[t]
            before[:, t] = h_before
            i, f, o = gates[..., :k], gates[..., k : 2 * k], gates[..., 2 * k :]
            total = d[:, t] + back_h
            dc = back_c + total * o * (1 - tc * tc)
            now = dz[:, t]
            now[..., :k], now[..., k : 2 * k], now[..., 2 * k : 3 * k] = dc * gg, dc * c, total * tc
            now[..., : 3 * k] *= gates * (1 - gates)
            now[..., 3 * k :] = dc * i * (1 - gg * gg)
            back_h, back_c = np.matmul(now, back), dc * f
        flat = dz.reshape(2, steps * n, 4 * k)
        gh, gx = np.matmul(before.reshape(2, -1, k).transpose(0, 2, 1), flat), np.matmul(both.reshape(2, steps * n, -1).transpose(0, 2, 1), flat)
        for j, name in enumerate("fb"):
            g[f"h{name}"], g[f"x{name}"], g[f"c{name}"] = gh[j], gx[j], flat[j].sum(axis=0)
        dx = np.matmul(flat, self.both("x").transpose(0, 2, 1)).reshape(both.shape)
        return dx[0] + dx[1, ::-1]

    def fit(self, chars: np.ndarray, gold: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 1) -> list[float]:
        """Adam with gradients clipped by norm and a rate that falls to a tenth."""
        r = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, step, steps = [], 0, max(1, epochs * -(-len(chars) // batch))
        for _ in range(epochs):
            order = r.permutation(len(chars))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                value, g = self.loss(chars[pick], gold[pick])
                losses.append(value)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.99 * square[k] + 0.01 * v * v
                    self.p[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tags of each window (batch, time), by Viterbi."""
        e, _ = self.emissions(chars)
        trans = self.p["step"] + BARRED
        start = np.where(allowed()[0], 0.0, -1e4)  # a window may not begin inside a span
        score, back = self.p["first"] + start + e[0], []
        for t in range(1, len(e)):
            s = score[:, :, None] + trans
            back.append(s.argmax(axis=1))
            score = s.max(axis=1) + e[t]
        best = [score.argmax(axis=1)]
        rows = np.arange(chars.shape[0])
        for b in reversed(back):
            best.append(b[rows, best[-1]])
        return np.stack(best[::-1], axis=1)


def spans_of(row: np.ndarray) -> list[Span]:
    out, t = [], 0
    row = row.tolist()
    while t < len(row):
        if row[t] % 2 == 1:
            inside, a = row[t] + 1, t
            t += 1
            while t < len(row) and row[t] == inside:
                t += 1
            out.append((KINDS[(inside - 2) // 2], a, t))
        else:
            t += 1
    return out


# --- windows of a whole text and their reconciliation

MARK = re.compile(r"[0-9@]")


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @, over the whole text."""
    last = -(-max(0, len(text) - WINDOW) // STRIDE)
    places = {k for m in MARK.finditer(text) for k in (m.start() // STRIDE - 1, m.start() // STRIDE)}
    return [k * STRIDE for k in sorted(places) if 0 <= k <= last]


def plausible(kind: str, s: str) -> bool:
    d = len(digits_of(s))
    if kind == "email":
        return "@" in s and "." in s.split("@", 1)[1]
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 14 <= d <= 19 and luhn(digits_of(s))
    return 10 <= d <= 15 and not s.isdigit()


def reconcile(text: str, found: list[tuple[int, Span]], base: list[Span]) -> list[Span]:
    """found: (window start, span within it). Base spans and, where nothing clashes, the plausible decoded ones."""
    edge = STRIDE // 2
    spans = []
    for start, (kind, a, b) in found:
        first, last = start == 0, start + WINDOW >= len(text)
        if (first or a >= edge) and (last or a < WINDOW - edge):
            spans.append((kind, start + a, start + b))
    joined: list[Span] = []
    for kind in KINDS:
        end = -1
        for k, a, b in sorted(s for s in spans if s[0] == kind):
            if a < end:
                joined[-1] = (k, joined[-1][1], max(end, b))
            else:
                joined.append((k, a, b))
            end = max(end, b)
    taken, ends = union([(a, b) for _, a, b in base])  # disjoint, so both are in order
    out, last = list(base), 0
    for k, a, b in sorted(joined, key=lambda s: (s[1], s[1] - s[2])):
        at = bisect_right(ends, a)  # the first base span that ends behind the start
        if a >= last and (at == len(taken) or b <= taken[at]) and plausible(k, text[a:b]):
            out.append((k, a, b))
            last = b
    return ordered(out)


def union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def tag_texts(model: Tagger | None, batch: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in batch]
    todo = [(i, s) for i, t in enumerate(batch) for s in window_starts(t)] if model else []
    found: list[list[tuple[int, Span]]] = [[] for _ in batch]
    for a in range(0, len(todo), AT_ONCE):
        part = todo[a : a + AT_ONCE]
        for (i, s), row in zip(part, model.decode(codes([batch[i][s : s + WINDOW] for i, s in part])), strict=True):
            found[i] += [(s, x) for x in spans_of(row)]
    return [(b, reconcile(t, f, b) if f else b) for t, f, b in zip(batch, found, base, strict=True)]


# --- training


def made_span(r: np.random.Generator) -> tuple[str, str]:
    """A generated span and its kind, among them forms that the base patterns miss."""
    number = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, r.integers(2, 9)))
    pick = lambda *x: x[int(r.integers(0, len(x)))]
    kind = pick(*KINDS, "phone", "phone")  # which has the most forms
    if kind == "email":
        return kind, f"{word()}{pick('', '.', '_', '-')}{pick(word(), number(2))}@{word()}{pick('', number(1))}.{pick('com', 'org', 'net', 'example.com', 'de', 'fr')}"
    if kind == "ip":
        return kind, ".".join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        body = pick("4", "5", "37") + number(14)
        body = body[:15]
        check = next(c for c in "0123456789" if luhn(body + c))
        return kind, pick(str, lambda x: " ".join(x[i : i + 4] for i in range(0, 16, 4)), lambda x: ".".join(x[i : i + 4] for i in range(0, 16, 4)), lambda x: "-".join(x[i : i + 4] for i in range(0, 16, 4)))(body + check)
    a, b, c = number(3), number(3), number(4)
    return kind, pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{number(2)} {a} {b}{c}", f"{a}-{b}-{c}", f"+1 {a}.{b}.{c}", f"0{number(2)}/{b}{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{number(2)} {a} {b}{c}", f"{a} {b} {c}")


def made_noise(r: np.random.Generator) -> str:
    """Things with digits that are no personal data."""
    number = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    hexa = lambda n: "".join("0123456789abcdef"[x] for x in r.integers(0, 16, n))
    return (f"{r.integers(1, 9)}.0.", f"password={hexa(18)}", f'"{hexa(40)}"', f"AKIA{hexa(16).upper()}", f"({number(3)})", number(int(r.integers(1, 9))), f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"v{number(1)}.{number(1)}.{number(2)}", f"{number(3)}.{number(3)}")[int(r.integers(0, 10))]


DOUBTFUL = re.compile(r"[0-9](?:[ ()./_-]{0,2}[0-9]){9,18}(?![0-9])")


def doubtful(window: str, base: list[Span]) -> bool:
    """Whether a window has 10 to 19 digits with signs among them that no base span covers."""
    return any(not m.group().isdigit() and not any(a < m.end() and m.start() < b for _, a, b in base) for m in DOUBTFUL.finditer(window))


def examples(windows: list[str], made: int = MADE_WINDOWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows with their base spans, and as many as asked for with generated spans and noise put between their words."""
    r = np.random.default_rng(seed)
    plain = windows or ["the of and to in is that for it was"]
    rows = [(w[:WINDOW], base_spans(w[:WINDOW])) for w in windows]
    rows = [(w, base) for w, base in rows if not doubtful(w, base)]
    for i in range(made):
        words = MARK.sub("", plain[i % len(plain)]).split(" ")[: int(r.integers(2, 12))]
        text, spans = "", []
        for j, w in enumerate(words):
            u = r.random()
            if u < 0.14:
                kind, s = made_span(r)
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            elif u < 0.24:
                text += made_noise(r)
            else:
                text += w
            text += (" ", " ", " ", ", ", ". ", "\n")[int(r.integers(0, 6))]
        rows.append((text[:WINDOW], [(k, a, b) for k, a, b in spans if b <= WINDOW]))
        if any(a < WINDOW < b for _, a, b in spans):
            rows[-1] = (text[: next(a for _, a, b in spans if a < WINDOW < b)], rows[-1][1])
    return codes([t for t, _ in rows]), np.stack([tags(s) for _, s in rows])


def plain_window(text: str) -> int:
    """Start of a window, anywhere in a text, that a hash of the text picks."""
    return zlib.crc32(text.encode()) % (max(0, len(text) - WINDOW) // STRIDE + 1) * STRIDE


def train(df: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_WINDOWS, made: int = MADE_WINDOWS) -> Tagger:
    """A tagger trained on a bounded sample; the executors cut the windows."""
    unknown(df, ["doc_id", "text"])
    chosen = df.select("doc_id").filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                out = [t[s : s + WINDOW] for t in texts(b) for s in (*window_starts(t), plain_window(t))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["window"])

    found = only(df, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(cut, "window string")
    marked = found.filter(F.col("window").rlike("[0-9@]")).orderBy(F.xxhash64("window"), "window").limit(most)
    plain = found.filter(~F.col("window").rlike("[0-9@]")).orderBy(F.xxhash64("window"), "window").limit(most // 3)
    windows = [r[0] for r in marked.unionByName(plain).collect()]
    model = Tagger()
    model.fit(*examples(windows, made))
    return model


def tagged(df: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    unknown(df, ["doc_id", "text"])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for b in slices(whole):
                rows = tag_texts(m, texts(b))
                count = lambda kind: pa.array([sum(s[0] == kind for s in base) for base, _ in rows], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        *(count(k) for k in KINDS),
                        pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                        pa.array([written(every) for _, every in rows], pa.string()),
                        pa.array([len(every) - len(base) for base, every in rows], pa.int64()),
                    ],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return only(df, "doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string, n_added bigint")


def find(df: DataFrame) -> DataFrame:
    return tagged(df, train(df))
