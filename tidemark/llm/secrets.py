"""Secret scans with a linear-chain conditional random field.

Base patterns find assignments, access keys and long hexadecimal runs. A linear
chain over tokens tags further secrets as begin, inside or outside, from the
shape of a token, its neighbouring words and features of the whole file, decoded
by Viterbi.

The chain looks at every token with a letter or digit that follows a cue word
(password, key, bearer and the like) within ``NEAR`` characters of its line, of any
length and alphabet, at the lines of a private key block, and anywhere at tokens of
``MIN_TOKEN`` characters or more with both a digit and a letter. Single marks that
glue such tokens together can continue a secret. All other tokens are outside by
rule. A chain therefore falls apart into short runs between outside tokens, and
decoding the runs gives the same tags as decoding the whole text.

The chain is fitted by conditional likelihood on the driver, from runs of a
bounded sample of documents (``FIT_ROWS`` rows expected, at most ``FIT_RUNS``
runs), labelled by the base patterns, and ``MADE_RUNS`` groups of labelled lines made
from a seeded generator, so that secrets outside the base patterns are seen too.

Edge cases: a null text counts as empty and has no spans; repeated rows each get
a row; an empty table gives no rows and still fits the chain from the made lines.
Of a span found by the chain that a base span overlaps, the parts outside stay.
Columns other than
doc_id and text are not read by ``scan``; ``redact`` keeps all columns.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")

MIN_TOKEN = 10
FIT_ROWS = 500
FIT_RUNS = 4000
MADE_RUNS = 450

TOKEN = re.compile(r"[A-Za-z0-9_+/=-]+|[^\sA-Za-z0-9_+/=-]")
#: Starts of tokens that hold a digit; possessive, so a long run costs one pass.
START = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{%d,}+" % MIN_TOKEN)
GLUE = frozenset(".:~!@#$%^&*?")
CUES = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|private|signature", re.I)
#: Cues as whole words: what follows one on its line is looked at whatever its shape.
CUE = re.compile(r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secrets?|tokens?|keys?|auth(?:orization)?"
                 r"|bearer|credentials?|signature)(?![A-Za-z])", re.I)
#: A short lower-case issuer before a longer body.
ISSUED = re.compile(r"[a-z]{2,5}[_-](?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])[A-Za-z0-9_-]{20,}")
LINKS = frozenset(["is", "was", "equals", "bearer", "basic"])
QUOTES = frozenset("\"'`")
NEAR = 64
#: Header of a private key block, the characters its body has at most, and its lines.
BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
BLOCK_END = "-----END"
BLOCK_CHARS = 8192
BLOCK_LINE = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9_+/=-])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns: leftmost and non-overlapping
    per kind, short ones dropped after matching."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def candidate(token: str) -> bool:
    return (len(token) >= MIN_TOKEN and any(c.isdigit() for c in token)
            and any(c.isalpha() for c in token))


def watched(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that may begin a secret, in order. Those that only a cue
    or a key block brings in are left out where a base span covers them."""
    own = {m.span() for m in START.finditer(text) if candidate(m[0])}
    near, at = set(), 0
    for m in CUE.finditer(text):
        line = text.find("\n", m.end(), m.end() + NEAR)
        stop = line if line >= 0 else m.end() + NEAR
        for t in TOKEN.finditer(text, max(at, m.end())):
            if t.start() >= stop:
                break
            at = t.start()
            cut = t.start() > 0 and TOKEN.match(text, t.start() - 1)       # the rest of a token
            if not (cut and cut.end() >= t.end()) and any(c.isalnum() for c in t[0]):
                near.add(t.span())
    for m in BLOCK.finditer(text):
        end = text.find(BLOCK_END, m.end(), m.end() + BLOCK_CHARS)
        near |= {t.span() for t in BLOCK_LINE.finditer(text, m.end(), end if end >= 0 else m.end() + BLOCK_CHARS)}
    near -= own
    if near:
        base = base_spans(text)
        own |= {(s, e) for s, e in near if outside(s, e, base) == [(s, e)]}
    return sorted(own)


def in_block(text: str, s: int) -> bool:
    """Whether place ``s`` lies in the body of a private key block."""
    head = text.rfind("PRIVATE KEY-----", max(0, s - BLOCK_CHARS), s)
    return head >= 0 and text.find(BLOCK_END, head, s) < 0


def shape(token: str) -> list[bool]:
    """Features of a token alone."""
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    upper = sum(c.isupper() for c in token)
    lower = sum(c.islower() for c in token)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in token]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    distinct = len(set(token))
    marks = n - digits - upper - lower
    return [n < 6, n < 8, n < 10, n < 12, 12 <= n < 16, 16 <= n < 20, 20 <= n < 32, 32 <= n < 40, n >= 40,
            digits / n < 0.1, 0.1 <= digits / n < 0.35, 0.35 <= digits / n < 0.75, digits / n >= 0.75,
            upper > 0 and lower > 0, upper > 0 and not lower, lower > 0 and not upper,
            turns < 0.12, 0.12 <= turns < 0.3, turns >= 0.3, distinct >= 10, distinct >= 16,
            ISSUED.fullmatch(token) is not None, not marks, marks >= 3, "/" in token, "=" in token[:-2],
            all(c in "0123456789abcdef" for c in token.lower()), n == 1]


def file_features(text: str) -> list[bool]:
    n = max(1, len(text))
    return [CUES.search(text) is not None, text.count("=") + text.count(";") + text.count("{") > n / 200,
            n < 200]


#: Shape, eleven features of the neighbours, three of the file, one constant.
N_FEATURES = len(shape("a1")) + 11 + 3 + 1


def runs(text: str) -> Iterator[tuple[list[tuple[int, int]], list[bool]]]:
    """Runs of consecutive tokens that may carry a tag: spans, and whether each may
    begin a secret."""
    starts = watched(text)
    may = frozenset(starts)
    at = 0
    for span in starts:
        if span[0] < at:
            continue
        spans, begins = [span], [True]
        end = span[1]
        while True:
            nxt = TOKEN.search(text, end)
            if nxt is None:
                break
            if nxt.span() in may:
                spans.append(nxt.span())
                begins.append(True)
                end = nxt.end()
                continue
            after = TOKEN.match(text, nxt.end())
            if nxt[0] in GLUE and nxt.start() == end and after is not None and after.span() in may:
                spans += [nxt.span(), after.span()]
                begins += [False, True]
                end = after.end()
                continue
            break
        at = end
        yield spans, begins


def features(text: str, spans: list[tuple[int, int]], whole: list[bool]) -> np.ndarray:
    """One row of 0/1 features per token of a run."""
    rows = []
    for s, e in spans:
        line = max(text.rfind("\n", max(0, s - NEAR), s) + 1, s - NEAR, 0)
        left, right = text[line:s], text[e:e + 8]
        tight, tail = left.rstrip(" "), right.lstrip(" ")
        words = re.findall(r"[A-Za-z_]+", left)
        token = text[s:e]
        told = any(CUE.search(w) for w in words[-3:]) and (
            tight.rstrip("\"'` ")[-1:] in ("=", ":") or words[-1].lower() in LINKS)
        digits, letters = any(c.isdigit() for c in token), any(c.isalpha() for c in token)
        rows.append(shape(token) + [
            in_block(text, s), told and digits and letters,
            told and digits and not letters and e - s >= 12,
            told and not digits and e - s >= 16 and token[1:] not in (token[1:].lower(), token[1:].upper()),
            bool(words) and CUES.search(words[-1]) is not None,
            any(CUES.search(w) for w in words[-4:-1]),
            tight.rstrip("\"'` ")[-1:] in ("=", ":") and bool(tight), tight[-1:] in QUOTES and bool(tight),
            tail[:1] in QUOTES and bool(tail), "//" in left.split(" ")[-1], "@" in (left[-1:], right[:1]),
        ] + whole + [True])
    return np.array(rows, np.float64).reshape(len(rows), N_FEATURES)


O, B, I = range(3)                                                     # noqa: E741


def allowed(text: str, spans: list[tuple[int, int]], begins: list[bool]) -> np.ndarray:
    """Which tags each token may take: inside needs the token before to touch it."""
    ok = np.ones((len(spans), 3), bool)
    ok[:, B] = begins
    for i, (s, _) in enumerate(spans):
        ok[i, I] = i > 0 and spans[i - 1][1] == s
    return ok


#: Tag changes a chain may make: inside follows begin or inside only.
STEP = np.zeros((3, 3))
STEP[O, I] = -np.inf


def decode(x: np.ndarray, ok: np.ndarray, weights: np.ndarray, change: np.ndarray) -> list[int]:
    """Viterbi over one run that stands between outside tokens."""
    score = np.where(ok, x @ weights, -np.inf)
    best = score[0] + change[O]
    back = []
    for row in score[1:]:
        step = best[:, None] + change
        back.append(step.argmax(0))
        best = step.max(0) + row
    tag = int((best + change[:, O]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return tags[::-1]


def fit(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 250,
        penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, tag) and tag changes by gradient ascent on the conditional
    likelihood; runs are padded with outside tokens and handled together."""
    n, longest = len(examples), max(len(y) for _, _, y in examples)
    x = np.concatenate([a for a, _, _ in examples])
    ok = np.zeros((n, longest, 3), bool)
    ok[:, :, O] = True
    y = np.zeros((n, longest), int)
    live = np.zeros((n, longest), bool)
    for k, (_, b, c) in enumerate(examples):
        ok[k, :len(c)], y[k, :len(c)], live[k, :len(c)] = b, c, True
    w, t = np.zeros((N_FEATURES, 3)), STEP.copy()
    free = np.isfinite(STEP)
    truth = np.eye(3)[y]
    seen = np.zeros((3, 3))
    path = np.concatenate([np.zeros((n, 1), int), y, np.zeros((n, 1), int)], 1)
    np.add.at(seen, (path[:, :-1], path[:, 1:]), 1)
    mw = vw = mt = vt = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(1, steps + 1):
            score = np.zeros((n, longest, 3))
            score[live] = x @ w
            e = np.exp(np.where(ok, score, -np.inf))
            move = np.exp(t)
            fwd = np.zeros((n, longest + 1, 3))
            bwd = np.zeros((n, longest + 1, 3))
            fwd[:, 0, O] = 1
            for i in range(longest):
                fwd[:, i + 1] = (fwd[:, i] @ move) * e[:, i]
                fwd[:, i + 1] /= fwd[:, i + 1].sum(1, keepdims=True)
            bwd[:, longest] = move[:, O]
            for i in range(longest - 1, -1, -1):
                bwd[:, i] = (bwd[:, i + 1] * e[:, i]) @ move.T
                bwd[:, i] /= bwd[:, i].sum(1, keepdims=True)
            node = fwd[:, 1:] * bwd[:, 1:]
            node /= node.sum(2, keepdims=True)
            pair = fwd[:, :-1, :, None] * move * (e * bwd[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            expected = pair.sum((0, 1))
            last = node[:, -1]
            expected[:, O] += last.sum(0)
            gw = x.T @ (truth - node)[live] / n - penalty * w
            gt = np.where(free, (seen - expected) / n - penalty * np.where(free, t, 0), 0)
            mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw ** 2
            mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt ** 2
            rate = 0.15 * (1 - k / (steps + 1)) / (1 - 0.9 ** k) * np.sqrt(1 - 0.99 ** k)
            w = w + rate * mw / (np.sqrt(vw) + 1e-9)
            t = np.where(free, t + rate * mt / (np.sqrt(vt) + 1e-9), t)
    return w, t


def labelled(text: str, secrets: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(features, allowed tags, tags) of every run, given the true spans."""
    whole = file_features(text)
    for spans, begins in runs(text):
        y, inside = [], -1
        for s, e in spans:
            hit = next((k for k, (a, b) in enumerate(secrets) if s < b and a < e), -1)
            y.append(O if hit < 0 else I if hit == inside else B)
            inside = hit
        ok = allowed(text, spans, begins)
        y = [tag if ok[i, tag] else O for i, tag in enumerate(y)]
        yield features(text, spans, whole), ok, np.array(y)


def made(count: int, seed: int = 11) -> Iterator[tuple[np.ndarray, ...]]:
    """Labelled runs of invented lines: keys after cues, and harmless look-alikes."""
    rnd = random.Random(seed)
    letters, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    mixed = letters + "0123456789"
    filler = "the of and when system order where value page item list report north".split()
    plain = ("required wrong safe kept changed expired lost hidden needed simple strong invalid generation code "
             "lime garden people ring player holder note idea points to a not that for in our room London JavaScript "
             "GitHub McDonald 5 12 2024 1999 two 3rd").split()

    def pick(chars: str, n: int) -> str:
        return "".join(rnd.choice(chars) for _ in range(n))

    def short() -> str:
        word = pick("abcdefghijklmnoprstuvw", rnd.randint(4, 8))
        return rnd.choice([f"{word}{rnd.randint(1, 99)}{pick('xyz', 1)}", f"{word[:3]}0{word[3:]}{rnd.choice('!@#$%&')}"
                           f"{rnd.randint(1, 2030)}", f"{word.title()}{rnd.randint(10, 999)}",
                           f"{word[:1]}@{word[1:]}0{pick(letters, 3)}!{rnd.randint(10, 2030)}"])
    for _ in range(count):
        cue = rnd.choice(["api key", "client_secret", "Authorization: Bearer", "password is", "auth_key",
                          "private key", "access token", "credential", "PWD", "signature"])
        good = rnd.choice([pick(mixed, rnd.randint(20, 48)), pick(mixed + "+/", 40), pick(low, 40),
                           f"{pick(mixed, 24)}.{pick(mixed, 32)}.{pick(mixed, 30)}",
                           f"sk_live_{pick(mixed, 24)}", f"ghp_{pick(mixed, 36)}",
                           f"{pick('abcdrstx', 4)}-{pick('0123456789', 12)}-{pick(letters, 12)}"])
        bad = rnd.choice([f"item-{rnd.randint(10**6, 10**9)}", f"2024-0{rnd.randint(1, 9)}-12T10",
                          f"version_{rnd.randint(1, 99)}_{rnd.randint(1, 99)}", f"covid19{pick('abcdefgh', 6)}",
                          f"page/{rnd.randint(1, 9999)}/section", pick("abcdefghij", 9) + str(rnd.randint(1, 99)),
                          f"{pick('aeioulmnrt', 12)}{rnd.randint(1900, 2030)}", f"img_{rnd.randint(10**5, 10**8)}x",
                          f"{rnd.randint(10**5, 10**6)}-{rnd.randint(10**5, 10**6)}mm",
                          f"https://site.example/{pick(letters[26:], 4)}/{rnd.randint(1, 99999)}/{pick(mixed, 12)}"])
        sep, quote = rnd.choice([" ", " = ", ": ", "="]), rnd.choice(["", '"', "'"])
        before, after = (" ".join(rnd.choices(filler, k=rnd.randint(3, 25))) for _ in range(2))
        head = f"{before} {cue}{sep}{quote}"
        yield from labelled(f"{head}{good}{quote} {after} {bad} {before}", [(len(head), len(head) + len(good))])
        yield from labelled(f"{before} {bad} {after}{sep}{quote}{bad}{quote} {before}", [])
        issued = rnd.choice([good, f"{pick('abcdrstx', 4)}-{pick('0123456789', 12)}-{pick(letters, 12)}",
                             f"{pick('ghpos', 3)}_{pick(mixed, 36)}"])
        if ISSUED.fullmatch(issued):
            yield from labelled(f"{before} {issued} {after}", [(len(before) + 1, len(before) + 1 + len(issued))])
        told = rnd.choice(["password is", "PWD is", "api key =", "credential is", "passphrase:", "the key is",
                           "auth key:", "pwd:", "Authorization: Bearer", "pwd was"])
        weak = rnd.choice([short(), short(), pick("0123456789", rnd.randint(14, 24)), pick(letters, rnd.randint(16, 32))])
        head = f"{before} {told} {quote}"
        yield from labelled(f"{head}{weak}{quote} {after}", [(len(head), len(head) + len(weak))])
        said = rnd.choice(["password is", "the key", "key:", "secret", "this token was", "pass the", "the secret is",
                           "credentials:", "signature of", "keys:", "a key is", "auth:"])
        yield from labelled(f"{before} {said} {' '.join(rnd.choices(plain + filler, k=rnd.randint(1, 6)))}. {after}", [])
        if rnd.random() < 0.2:
            body = [pick(mixed + "+/", 64) for _ in range(rnd.randint(2, 6))] + [pick(mixed, rnd.randint(16, 60)) + "=="]
            head = f"{before}\n-----BEGIN {rnd.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n"
            places = [(len(head) + sum(len(x) + 1 for x in body[:k]), len(x)) for k, x in enumerate(body)]
            yield from labelled(head + "\n".join(body) + "\n-----END PRIVATE KEY-----\n" + after,
                                [(a, a + n) for a, n in places])


Model = tuple[np.ndarray, np.ndarray]


def train(docs: DataFrame) -> Model:
    """Fit on made lines and on runs of a bounded sample of ``docs``."""
    share = int(min(1.0, FIT_ROWS / max(1, docs.count())) * (1 << 30))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                text = t.as_py() or ""
                out += [(x.astype(np.uint8).tobytes(), ok.tobytes(), y.astype(np.int64).tobytes())
                        for x, ok, y in labelled(text, [(s, e) for s, _, e in base_spans(text)])
                        if len(y) <= 40]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], pa.binary()) for k in range(3)], ["x", "ok", "y"])
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("text")
    rows = sample.mapInArrow(gather, "x binary, ok binary, y binary").limit(FIT_RUNS).collect()
    seen = [(np.frombuffer(r.x, np.uint8).reshape(-1, N_FEATURES).astype(float),
             np.frombuffer(r.ok, bool).reshape(-1, 3), np.frombuffer(r.y, np.int64)) for r in rows]
    seen.sort(key=lambda e: (e[0].tobytes(), e[2].tobytes()))
    return fit([*made(MADE_RUNS), *seen])


def outside(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of [start, end) that no base span covers; base spans come by start."""
    out = []
    for a, _, b in base:
        if a >= end:
            break
        if b > start:
            if a > start:
                out.append((start, a))
            start = b
    return [*out, (start, end)] if start < end else out


def find(text: str | None, model: Model, parts: bool = False) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all spans of a text, by start and kind. Of a chain
    span that overlaps a base span nothing is given, or with ``parts`` what lies
    outside."""
    text = text or ""
    base = base_spans(text)
    out = list(base)
    whole = None
    for spans, begins in runs(text):
        whole = file_features(text) if whole is None else whole
        tags = decode(features(text, spans, whole), allowed(text, spans, begins), *model)
        begin = None
        for k, ((s, e), tag) in enumerate(zip(spans, tags)):
            if tag == B:
                begin = s
            goes_on = k + 1 < len(tags) and tags[k + 1] == I and spans[k + 1][0] == e
            if tag != O and begin is not None and not goes_on:
                rest = outside(begin, e, base)
                out += [(a, 3, b) for a, b in rest if parts or (a, b) == (begin, e)]
                begin = None
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_crf, base, spans) per row: span lists
    as text, of the base patterns and of all."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t.as_py(), model, True) for t in b.column("text")]
            counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *counts,
                 pa.array([joined([s for s in f if s[1] < 3]) for f in found], pa.string()),
                 pa.array([joined(f) for f in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base string, spans string")


def hide(text: str | None, model: Model, mark: str) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s, _, e in find(text, model, True):
        if e > at:
            out += [text[at:max(s, at)], mark if s >= at else ""]
            at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans by one
    mark. All rows and columns stay."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            new = pa.array([hide(t.as_py(), model, mark) for t in b.column("text")], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)
    return docs.mapInArrow(run, docs.schema)
