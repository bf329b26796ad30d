"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field beside them.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check; a match
that fails is dropped whole. That loses data where two numbers stand together ("+1 (269) 555-3296
4524132264652876" is one failing phone match and one failing card match). So every run of digits and
separators is also cut by a semi-Markov model: a candidate segment (whole tokens, bounded length, valid
for its kind) is scored by features of the whole span, the rest of the run goes token by token, and
dynamic programming chooses boundaries and kinds of the run jointly. Segments that touch no base span
are added; base spans always stay.

The weights are fitted by likelihood on at most ``SAMPLE_RUNS`` different runs of up to ``LEARNED_RUN`` characters,
those of least hash, with base spans as the truth.

Offsets are code points, ends exclusive. Defined cases: null and empty texts have no spans; very long
texts are read whole, in time linear in their length; a run of any length is cut with segments of at
most ``MOST_TOKENS`` tokens; equal scores go to the segmentation with fewer added spans; a sample
without base spans leaves the weights at 0 but for a bias against spans; repeated rows get equal
results; an empty table gives no rows; other columns are kept or not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clinspan.llm.stored import discard, store

KINDS = ("email", "ip", "card", "phone")
SAMPLE_RUNS = 1500
LEARNED_RUN = 200  # characters of a run that is learned from at most; runs of any length are searched
ROUNDS, RATE, SHRINK = 6, 0.1, 1e-4
MOST_TOKENS = 12
LEAST_RUN_DIGITS = 9
BIAS = -2.0  # weight of any span before fitting

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # no match starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[+(]?[0-9](?:[\x20().+-]{0,3}[0-9])++")
_TOKEN = re.compile(r"[0-9]+|[^0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(digits: str) -> bool:
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of the base spans of each kind, in order."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if "@" in text:
        last = 0
        for m in _HOST.finditer(text):
            at = m.start()
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found["email"].append((start, m.end()))
                last = m.end()
    found["ip"] = [m.span() for m in _IP.finditer(text) if is_ip(m[0])]
    found["card"] = [m.span() for m in _CARD.finditer(text) if is_card(_DIGITS.sub("", m[0]))]
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if is_phone(_DIGITS.sub("", m[0]))]
    return found


def runs(text: str) -> list[tuple[int, int]]:
    """Runs of digits and separators with enough digits for a span."""
    return [m.span() for m in _RUN.finditer(text)
            if m.end() - m.start() >= 7 and sum(map(str.isdigit, m[0])) >= 4
            and (m[0].count(".") >= 3 or sum(map(str.isdigit, m[0])) >= LEAST_RUN_DIGITS)]


def _side(char: str) -> str:
    return "word" if char.isalnum() else "space" if not char or char.isspace() else "mark"


def segments(run: str, left: str, right: str) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """(token starts and the end, candidate segments as first token, last token + 1, kind, span features)."""
    tokens = [m.span() for m in _TOKEN.finditer(run)]
    starts = [a for a, _ in tokens] + [len(run)]
    out = []
    for i, (a, b) in enumerate(tokens):
        head = run[a]
        if not head.isdigit() and head not in "+(":
            continue
        before = _side(run[a - 1] if a else left)
        groups, size = [], 0
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            x, y = tokens[j]
            if not run[x].isdigit():
                continue
            groups.append(y - x)
            size += y - x
            if size > 19:
                break
            span = run[a:y]
            digits = _DIGITS.sub("", span)
            marks = "".join(sorted(set(_TOKEN.sub(lambda m: "" if m[0][0].isdigit() else m[0], span))))
            shape = ",".join(map(str, groups))
            after = _side(run[y] if y < len(run) else right)
            sides = [f"left={before}", f"right={after}"]
            if head in "+(" and is_phone(digits):
                out.append((i, j + 1, "phone", [
                    f"head={head}", f"digits={size}", f"shape={shape}", f"marks={marks}", *sides]))
            if head.isdigit():
                if not set(marks) - set(" -") and is_card(digits):
                    out.append((i, j + 1, "card", [
                        f"first={digits[0]}", f"digits={size}", f"shape={shape}", f"marks={marks}", *sides]))
                if len(groups) == 4 and is_ip(span):
                    out.append((i, j + 1, "ip", [f"digits={size}", *sides]))
    return starts, out


def names(kind: str, features: list[str]) -> list[str]:
    return [kind, *(f"{kind}:{f}" for f in features)]


def value(weights: dict[str, float], kind: str, features: list[str]) -> float:
    return BIAS + sum(weights.get(n, 0.0) for n in names(kind, features))


def best(count: int, spans: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The segmentation of ``count`` tokens with the highest score; a token outside spans scores 0."""
    ending: dict[int, list] = {}
    for span in spans:
        ending.setdefault(span[1], []).append((span[0], span[2], value(weights, span[2], span[3])))
    score, back = [0.0] * (count + 1), [None] * (count + 1)
    for j in range(1, count + 1):
        score[j] = score[j - 1]
        for i, kind, v in ending.get(j, ()):
            if score[i] + v > score[j]:
                score[j], back[j] = score[i] + v, (i, j, kind)
    out, j = [], count
    while j:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def chances(count: int, spans: list, weights: dict[str, float]) -> list[float]:
    """The probability of each candidate segment over all segmentations."""
    values = [value(weights, kind, features) for _, _, kind, features in spans]
    ending, starting = {}, {}
    for k, (i, j, *_) in enumerate(spans):
        ending.setdefault(j, []).append(k)
        starting.setdefault(i, []).append(k)
    forward, backward = [0.0] * (count + 1), [0.0] * (count + 1)
    for j in range(1, count + 1):
        forward[j] = forward[j - 1]
        for k in ending.get(j, ()):
            forward[j] = _add(forward[j], forward[spans[k][0]] + values[k])
    for i in range(count - 1, -1, -1):
        backward[i] = backward[i + 1]
        for k in starting.get(i, ()):
            backward[i] = _add(backward[i], backward[spans[k][1]] + values[k])
    return [math.exp(forward[i] + v + backward[j] - forward[count]) for (i, j, *_), v in zip(spans, values)]


def fit_runs(samples: list[tuple[str, str, str, frozenset]]) -> dict[str, float]:
    """Weights that maximise the likelihood of the true spans of (run, left, right, {(kind, start, end)})."""
    weights: dict[str, float] = {}
    items = []
    for run, left, right, truth in samples:
        starts, spans = segments(run, left, right)
        real = [(kind, starts[i], starts[j]) in truth for i, j, kind, _ in spans]
        if sum(real) == len(truth):  # else the truth is no segmentation into candidates
            items.append((len(starts) - 1, spans, real))
    for _ in range(ROUNDS):
        for count, spans, real in items:
            for (_, _, kind, features), true, chance in zip(spans, real, chances(count, spans, weights)):
                step = RATE * (true - chance)
                if abs(step) > 1e-9:
                    for n in names(kind, features):
                        weights[n] = weights.get(n, 0.0) * (1 - SHRINK) + step
    return weights


def all_spans(text: str, weights: dict[str, float]) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind as listed, then start."""
    base = base_spans(text)
    out = [(kind, a, z, True) for kind in KINDS for a, z in base[kind]]
    taken = sorted((a, z) for spans in base.values() for a, z in spans)
    at = 0
    for low, high in runs(text):  # ascending, as are the base spans
        while at < len(taken) and taken[at][0] < low and not any(z > low for _, z in taken[at:at + 4]):
            at += 1
        near, k = [], at
        while k < len(taken) and taken[k][0] < high:
            if taken[k][1] > low:
                near.append(taken[k])
            k += 1
        starts, spans = segments(text[low:high], text[max(low - 1, 0):low], text[high:high + 1])
        for i, j, kind in best(len(starts) - 1, spans, weights):
            a, z = low + starts[i], low + starts[j]
            if not any(x < z and a < y for x, y in near):
                out.append((kind, a, z, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Weights from at most ``SAMPLE_RUNS`` different runs of up to ``LEARNED_RUN`` characters, those of least hash.

    The driver gets a share of the hashes that holds just over so many runs, whatever the number of tasks.
    """
    names = ["run", "left", "right", "spans", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text in batch.column(0).to_pylist():
                found = None
                for low, high in runs(text) if text else ():
                    if high - low > LEARNED_RUN:
                        continue
                    found = found or base_spans(text)
                    inside = [f"{kind}:{a - low}:{z - low}" for kind in KINDS[1:] for a, z in found[kind]
                              if low <= a and z <= high]
                    rows.add((text[low:high], text[max(low - 1, 0):low], text[high:high + 1], " ".join(inside)))
            hashes = [int.from_bytes(hashlib.md5(repr(r).encode()).digest()[:7]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[k] for r in rows], pa.string()) for k in range(4)], pa.array(hashes, pa.int64())], names)

    found = store(docs.select(text_col).mapInArrow(
        run, "run string, left string, right string, spans string, hash long").distinct(), "runs")
    share = 2 * SAMPLE_RUNS / max(found.count(), 1)
    rows = found.where(F.col("hash") < int(min(share, 1.0) * (1 << 56))).collect()
    if len(rows) < SAMPLE_RUNS and share < 1:  # hashes as uneven as this do not happen; the exact way for them
        rows = found.orderBy("hash").limit(SAMPLE_RUNS).collect()
    discard(found)
    samples = []
    for row in sorted(rows, key=lambda r: (r["hash"], r["run"], r["left"], r["right"], r["spans"]))[:SAMPLE_RUNS]:
        truth = frozenset((k, int(a), int(z)) for k, a, z in (f.split(":") for f in row["spans"].split()))
        samples.append((row["run"], row["left"], row["right"], truth))
    return fit_runs(samples)


def find_private(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``spans``): array of {kind, start, stop, base} of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "stop": z, "base": b} for k, a, z, b in all_spans(text or "", weights)]
                     for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], ["__id", "spans"])

    return (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .mapInArrow(run, f"__id {kind}, spans array<struct<kind:string,start:long,stop:long,base:boolean>>")
        .withColumnRenamed("__id", id_col))


def mask(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each stretch of touching spans replaced by the kind of its first in brackets."""
    out, at = [], 0
    for kind, a, z, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, weights: dict[str, float], text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of the text masked, and ``length_col`` set to the new length if given."""
    at = docs.columns.index(text_col)
    sized = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not t else mask(t, all_spans(t, weights)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sized is not None:
                columns[sized] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, StructType(docs.schema.fields))
