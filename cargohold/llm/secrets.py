"""Secrets by pattern, and by a battery of randomness tests with length-aware control of false discoveries."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import staged

#: The base kinds, in this order, with the least length of what must be long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
#: Strings that the battery tests: this long at least, cut at anything else and at `=`, save the padding at the end.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
_BETWEEN_EQUALS = re.compile(r"[^=]+(?:=+$)?")
#: Where no alphabet fits: parts without the letters of one or the other base 64, or without both.
_PARTS = (re.compile(r"[^/]+"), re.compile(r"[^_-]+"), re.compile(r"[^/_-]+"))
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Share of text among the strings called secrets, within each class of lengths; lengths that bound the classes.
RATE, LENGTHS = 0.05, (20, 24, 32, 48, 64, 128)
#: A string whose battery has a smaller p-value isn't drawn evenly; one in a hundred keys is lost by this.
UNEVEN = 0.01
#: Shares of letter pairs, single letters and even letters in the text model.
PAIRS, SINGLES, EVEN = 0.6, 0.25, 0.15
#: Chance that a name goes on with lower case, upper case, a digit or a sign, behind each of these: words are runs of
#: one case that may begin with a capital, so a change is rarer than in a key.
NEXT = {"lower": (0.80, 0.07, 0.06, 0.07), "upper": (0.45, 0.45, 0.05, 0.05), "digit": (0.08, 0.07, 0.78, 0.07), "sign": (0.45, 0.25, 0.20, 0.10)}
#: Steps of the decimal logarithm of a p-value in the counts of a class, and the smallest.
STEPS, SMALLEST = 20, 16
_MAYBE = ("password", "passwd", "secret", "token", "apikey", "api_key")


def encoding(s: str) -> str | None:
    """The narrowest alphabet that holds the string; none for digits or letters of one case alone, which no key generator prints."""
    body = s.rstrip("=")
    if body.isdigit() or (body.isalpha() and (body.islower() or body.isupper())):
        return None
    return next((name for name, letters in ALPHABETS.items() if not set(body) - set(letters)), None)


def _upper_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def _chi_tail(x: float, k: float) -> float:
    """P(chi squared with k degrees >= x), by the cube root approximation."""
    return _upper_tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def not_random(s: str) -> float | None:
    """p-value of the string being drawn evenly from its encoding's alphabet: small for words and patterns.

    Chi squared of the letter counts, runs above and below the middle of the alphabet, and serial correlation of
    neighbours and of letters up to eight apart, combined by the smallest of the three times three. None if no
    encoding fits.
    """
    name = encoding(s)
    if name is None:
        return None
    body, letters = s.rstrip("="), ALPHABETS[name]
    place = {c: i for i, c in enumerate(letters)}
    x, n, k = [place[c] for c in body], len(body), len(letters)
    # Counts in few cells, so that a short string expects five letters or more in each.
    cells = max(2, min(k, n // 5))
    seen = [0] * cells
    for v in x:
        seen[v * cells // k] += 1
    width = [0] * cells
    for v in range(k):
        width[v * cells // k] += 1
    uneven = sum((o - n * w / k) ** 2 / (n * w / k) for o, w in zip(seen, width, strict=True))
    ps = [_chi_tail(uneven, cells - 1)]
    high = [2 * v >= k for v in x]
    a, b = sum(high), n - sum(high)
    if a and b:
        runs = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        spread = (mean - 1) * (mean - 2) / max(1, n - 1)
        ps.append(2 * _upper_tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    middle = sum(x) / n
    apart = [v - middle for v in x]
    power = sum(v * v for v in apart)
    if power:
        lags = range(1, min(8, n // 4) + 1)
        r = [sum(p * q for p, q in zip(apart, apart[k:], strict=False)) / power for k in lags]
        ps.append(_chi_tail(n * (n + 2) * sum(v * v / (n - k) for k, v in zip(lags, r, strict=True)), len(lags)))
    else:
        ps.append(0.0)
    return min(1.0, 3 * min(ps))


_OTHER = 26
_LETTER = np.full(256, _OTHER, np.uint16)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _LETTER[ord(_c)] = _LETTER[ord(_c.upper())] = _i


def pair_counts(text: str) -> np.ndarray:
    """How often each letter follows each, without regard to case; 26 stands for anything else.

    Strings that the battery tests are left out, or a table full of keys would teach the model its keys.
    """
    codes = _LETTER[np.frombuffer(CANDIDATE.sub(" ", text).encode("ascii", "replace"), np.uint8)]
    return np.bincount(codes[:-1] * np.uint16(27) + codes[1:], minlength=27 * 27)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(27 * 27, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                total += pair_counts(text)
    yield pa.record_batch({"pair": np.arange(27 * 27, dtype=np.int32), "n": total})


def text_model(counts: np.ndarray) -> list[list[float]]:
    """-log of the chance of each letter behind each (26: behind a digit, a sign or nothing), from `pair_counts`.

    Letters and even chances are mixed in, so that pairs the table hasn't are possible, and an empty table is even.
    """
    pairs = counts.reshape(27, 27)[:, :26].astype(float)
    single = pairs.sum(0)
    single = single / single.sum() if single.sum() else np.full(26, 1 / 26)
    behind = pairs.sum(1, keepdims=True)
    pair = np.where(behind > 0, pairs / np.maximum(behind, 1), single)
    return (-np.log(PAIRS * pair + SINGLES * single + EVEN / 26)).tolist()


def is_text(s: str, model: list[list[float]]) -> float:
    """p-value of the string being a name, path or word, under the text model: small for keys.

    The chance of the string under the model over its chance when drawn evenly from its encoding's alphabet. Under the
    model the inverse has mean 1, so it exceeds x with a chance of at most 1/x, whatever the string's length.
    """
    body, cost, before, kind = s.rstrip("="), 0.0, _OTHER, "sign"
    for c in body:
        now = "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit() else "sign"
        cost += _NEXT[kind][now]
        if now in ("lower", "upper"):
            letter = ord(c.lower()) - 97
            cost += model[before][letter]
            before = letter
        else:
            cost += _DIGIT if now == "digit" else _SIGN
            before = _OTHER
        kind = now
    return min(1.0, math.exp(min(0.0, len(body) * math.log(len(ALPHABETS[encoding(s)])) - cost)))


_NEXT = {k: dict(zip(NEXT, (-math.log(p) for p in v), strict=True)) for k, v in NEXT.items()}
_DIGIT, _SIGN = math.log(10), math.log(4)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _MAYBE):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: A run matches HEX as long as it goes, so the runs of HEX_LENGTH or more are these.
_LONG_HEX = re.compile(HEX.pattern[:-1] + "{%d,}" % HEX_LENGTH)


def _cut(s: str) -> Iterator[tuple[int, int]]:
    """The strings to test in a run: itself where an alphabet fits, else its parts; of parts that overlap, the longest."""
    for m in _BETWEEN_EQUALS.finditer(s):
        if m.end() - m.start() < LEAST:
            continue
        if set(m[0].rstrip("=")) <= _WEB or set(m[0].rstrip("=")) <= _PLAIN:
            yield m.span()
            continue
        parts = {x.span() for p in _PARTS for x in p.finditer(m[0]) if x.end() - x.start() >= LEAST and encoding(x[0]) is not None}
        taken: list[tuple[int, int]] = []
        covered: set[int] = set()
        for a, b in sorted(parts, key=lambda x: (x[0] - x[1], x[0])):
            if a not in covered and b - 1 not in covered:
                taken.append((a, b))
                covered.update(range(a, b))
        yield from sorted((m.start() + a, m.start() + b) for a, b in taken)


#: Every alphabet lies in one of these.
_PLAIN, _WEB = set(ALPHABETS["base64"]), set(ALPHABETS["base64url"])


def candidates(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, p) of each string that an encoding fits."""
    for m in CANDIDATE.finditer(text):
        for a, b in _cut(m[0]):
            p = not_random(m[0][a:b])
            if p is not None:
                yield m.start() + a, m.start() + b, p


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS)


def p_step(p: float) -> int:
    return min(STEPS * SMALLEST, int(-STEPS * math.log10(max(p, 1e-300))))


def _scanner(model: list[list[float]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, extra = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base.append([{"kind": k, "start": a, "end": b} for a, b, k in base_spans(text)])
                extra.append([
                    {"start": a, "end": b, "len_class": length_class(b - a), "step": p_step(is_text(text[a:b], model)), "even": p >= UNEVEN}
                    for a, b, p in candidates(text)
                ])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "base": pa.array(base, _BASE), "extra": pa.array(extra, _EXTRA)})

    return scan


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_EXTRA = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("len_class", pa.int32()), ("step", pa.int32()), ("even", pa.bool_())]))
_SCHEMA = (
    "doc_id long, base array<struct<kind:string,start:long,end:long>>, extra array<struct<start:long,end:long,len_class:int,step:int,even:boolean>>"
)


def limits(counts: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """For each class of lengths the least step of -log p that is called not text (Benjamini and Hochberg)."""
    result = {}
    for c in {x[0] for x in counts}:
        steps = sorted(((s, n) for k, s, n in counts if k == c), reverse=True)
        total, upto = sum(n for _, n in steps), 0
        for s, n in steps:
            upto += n
            if 10 ** (-s / STEPS) <= rate * upto / total:
                result[c] = s
    return result


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id and spans (kind, start, end, in code points, by start and then kind) of each row of `docs`.

    The base kinds are always there. Of kind `random` are the strings that an encoding fits, that the battery doesn't
    call uneven, and that aren't text: the letter pairs of the whole table are counted first, and `is_text` says how
    likely they make a string. For this decision the p-values of all strings of a class of lengths are counted over the
    whole table and the limit keeps the share of text among the strings called secrets at `rate`: short strings, of
    which there are many, get a limit of their own. A random string inside a base span is not shown again. Null and empty texts
    have no spans; other columns are ignored; rows that repeat an id each give a row, and so do equal texts. A text is
    scanned whole, however long. Of an empty table nothing comes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pairs = np.zeros(27 * 27, np.int64)
    # 729 sums, whatever the table's size.
    for r in rows.select("text").mapInArrow(_count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    found = staged(rows.mapInArrow(_scanner(text_model(pairs)), _SCHEMA), "spans")
    counts = found.select(F.explode("extra").alias("e")).groupBy("e.len_class", "e.step").agg(F.count("*").alias("n")).collect()
    least = limits([tuple(r) for r in counts], rate)
    even = lambda e: e["even"] & (e["step"] >= F.element_at(F.array(*[F.lit(least.get(c, STEPS * SMALLEST + 1)) for c in range(len(LENGTHS) + 1)]), e["len_class"] + 1))
    outside = lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"]))
    more = F.transform(F.filter("extra", lambda e: even(e) & outside(e)), lambda e: F.struct(F.lit("random").alias("kind"), e["start"].alias("start"), e["end"].alias("end")))
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    ordered = F.array_sort(F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their list and the list of all spans, from the result of `secrets`."""
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def sha256_of_spans(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
