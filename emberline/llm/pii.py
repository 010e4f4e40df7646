"""Personal data: fixed base patterns, to which a character-level BiLSTM-CRF adds spans.

Base spans (email, ip, card, phone) are leftmost and do not overlap within a kind. A
bounded sample of text windows, labelled with its base spans, some in varied spelling,
trains the tagger in numpy on the driver; its parameters (a fixed number) go to the tasks.
Each fifth window is held out: the least posterior of an added span is the lowest at
which the held-out windows' spans reach the precision ``PRECISE``.

Every text is cut into overlapping windows. A span needs a digit or an at sign, spelt @, [at]
or (at), so windows without them cannot give one and are not run. Each window is decoded with
the CRF; spans that touch an inner window edge are left to the neighbour, which holds them
whole, and spans that their kind's digits or domain rule out are dropped. All spans of a
text are then reconciled: base spans stay, and of the tagger's the surest stay that overlap
no other, no base span and no match that the base pattern of the same kind has ruled out.

Null and empty texts have no spans. Offsets are code points, the end exclusive. Repeated
rows get equal answers; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import slices
from emberline.llm.crf import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 128, 64
#: Training windows of each kind, and of windows with digits but no span: a bound, whatever the corpus.
TRAIN_WINDOWS = 160
TRAIN_STEPS = 250
#: Least posterior of every character of an added span, where the held-out windows decide nothing.
SURE = 0.99
#: Share of the held-out windows' added spans that must be right, and each how many windows are held out.
PRECISE, HELD_OUT = 0.98, 5
LEAST_CHARS, MOST_CHARS = 7, STRIDE

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|\[at\]|\(at\)", re.I)
_AT = re.compile(r"\s?(?:@|\[at\]|\(at\))\s?", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(part: str) -> str:
    return "".join(c for c in part if "0" <= c <= "9")


def plausible(kind: str, form: str) -> bool:
    """Whether a text that no base pattern matches can be of the kind: its digits, or its at sign and domain, as in the base checks."""
    if kind == "email":
        parts = _AT.split(form)
        return len(parts) == 2 and parts[0] != "" and set(parts[0]) <= _LOCAL and _DOMAIN.fullmatch(parts[1]) is not None
    digits = _digits(form)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return _IP.fullmatch(form) is not None and all(int(p) <= 255 for p in form.split("."))


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str]]]:
    """(spans by start and kind, matches that their checks ruled out, with the kind)."""
    found, ruled_out = [], []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))

    for kind, pattern, check in (
            (1, _IP, lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.split("."))),
            (2, _CARD, lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
            (3, _PHONE, lambda m: 10 <= len(_digits(m)) <= 15)):
        for m in pattern.finditer(text):
            if check(m[0]):
                found.append((m.start(), kind, m.end()))
            elif kind != 2 or len(m[0]) >= 14:
                ruled_out.append((*m.span(), KINDS[kind]))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)], ruled_out


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _tags(width: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """0 outside, then begin and inside of each kind."""
    out = np.zeros(width, dtype=np.int64)
    for kind, start, end in spans:
        tag = 1 + 2 * KINDS.index(kind)
        out[max(0, start):end] = tag + 1
        if start >= 0:
            out[start:start + 1] = tag
    return out


def training_windows(docs: DataFrame, text: str = "text", each: int = TRAIN_WINDOWS) -> DataFrame:
    """(kind, window): at most ``each`` windows of every kind and of ``none``, those with the smallest hash."""
    schema = "kind string, mark long, window string"

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, str]] = {}
        for batch in slices(batches, text):
            for value in batch.column(text).to_pylist():
                if not value or not _MARK.search(value):
                    continue
                spans, _ = base_spans(value)
                first = _MARK.search(value).start()
                places = [(kind, start) for kind, start, _ in spans] or [("none", first)]
                for kind, start in places:
                    mark = int.from_bytes(hashlib.blake2b(f"{start}:{value[start:start + 40]}".encode(), digest_size=7).digest(), "little")
                    begin = max(0, start - 16 - mark % 48)
                    kept = held.setdefault(kind, {})
                    kept[mark] = value[begin:begin + WIDTH]
                    if len(kept) > 2 * each:
                        held[kind] = dict(sorted(kept.items())[:each])
        rows = [(kind, mark, window) for kind, kept in held.items() for mark, window in sorted(kept.items())[:each]]
        if rows:
            kinds, marks, windows = zip(*rows, strict=True)
            yield pa.record_batch({"kind": pa.array(kinds), "mark": pa.array(marks, pa.int64()), "window": pa.array(windows)})

    rows = docs.select(text).mapInArrow(sampled, schema)
    # a task passes on ``each`` rows of a kind at most; equal marks are equal windows
    once = rows.groupBy("kind", "mark").agg(F.min("window").alias("window"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("mark"))
    return once.withColumn("turn", place).filter(F.col("turn") <= each).select("kind", "window", "mark")


def varied(window: str, spans: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The window with its phones, cards and at signs spelt in ways that the base patterns do not know."""
    parts, out, at, size = [], [], 0, 0
    for kind, start, end in spans:
        if start < at:
            continue
        form = window[start:end]
        digits = "".join(c for c in form if c.isdigit())
        if kind == "phone":
            local = digits[-10:]
            form = str(rng.choice([f"{local[:3]}-{local[3:6]}-{local[6:]}", f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"1-{local[:3]}-{local[3:6]}-{local[6:]}", form]))
        elif kind == "card":
            form = str(rng.choice([".".join(digits[k:k + 4] for k in range(0, len(digits), 4)), "-".join(digits[k:k + 4] for k in range(0, len(digits), 4)), form]))
        elif kind == "email":
            form = form.replace("@", str(rng.choice([" @ ", " [at] ", "(at)", "@"])))
        parts += [window[at:start], form]
        size += start - at
        out.append((kind, size, size + len(form)))
        size += len(form)
        at = end
    return "".join(parts) + window[at:], out


def train(docs: DataFrame, text: str = "text", each: int = TRAIN_WINDOWS, steps: int = TRAIN_STEPS, seed: int = 5) -> Tagger | None:
    """The tagger, from the bounded sample; None when the sample holds no span."""
    sample = sorted((row["kind"], row["mark"], row["window"]) for row in training_windows(docs, text, each).collect())
    return learned([window for _, _, window in sample], steps, seed)


def learned(windows: list[str], steps: int = TRAIN_STEPS, seed: int = 5) -> Tagger | None:
    """The tagger and its least posterior, from windows sorted by kind; None when they hold no span."""
    rng = np.random.default_rng(seed)
    rows, gold, held = [], [], []
    for k, window in enumerate(windows):
        spans, _ = base_spans(window)
        for form, spans in ((window, spans), varied(window, spans, rng)):
            if k % HELD_OUT == HELD_OUT - 1:
                held.append((form[:WIDTH], spans))
            else:
                rows.append(symbols(form, WIDTH))
                gold.append(_tags(WIDTH, spans))
    if not rows or not np.any(gold):
        return None
    tagger = Tagger.new(1 + 2 * len(KINDS), seed=seed)
    tagger.train(np.stack(rows), np.stack(gold), steps=steps, batch=32, seed=seed)
    tagger.sure, tagger.precision, tagger.recall = held_out(tagger, held)
    return tagger


def held_out(tagger: Tagger, held: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[float, float, float]:
    """(least posterior, precision, recall) over the spans that the base patterns leave in held-out windows; SURE and zeros if no posterior is precise enough."""
    tried, wanted = [], 0
    for (form, spans), more in zip(held, added_spans(tagger, [form for form, _ in held], 0.0), strict=True):
        own, ruled_out = base_spans(form)
        wanted += sum(end <= len(form) and not any(a < end and start < b for _, a, b in own) for _, start, end in spans)
        tried += [(span[0], span[1:] in spans) for span in more if len(reconciled(own, ruled_out, [span])) > len(own)]
    tried.sort(reverse=True)
    best, right = (SURE, 0.0, 0.0), 0
    for n, (value, good) in enumerate(tried, 1):
        right += good
        if right >= PRECISE * n:
            best = value, right / n, right / max(1, wanted)
    return best


def _window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign, in any spelling."""
    wanted: set[int] = set()
    at = _MARK.search(text)
    while at:
        last = at.start() // STRIDE  # a span that holds the sign lies whole in this window or the one before
        wanted.update((last, max(0, last - 1)))
        at = _MARK.search(text, (last + 1) * STRIDE)
    return sorted(k * STRIDE for k in wanted)


def added_spans(tagger: Tagger, texts: list[str], sure: float | None = None) -> list[list[tuple[float, str, int, int]]]:
    """(posterior, kind, start, end) of every span that the tagger finds, text by text."""
    least = tagger.sure if sure is None else sure
    places = [(k, start) for k, text in enumerate(texts) for start in _window_starts(text)]
    out: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    for low in range(0, len(places), 256):
        part = places[low:low + 256]
        rows = np.stack([symbols(texts[k][start:start + WIDTH], WIDTH) for k, start in part])
        scores, (*_, mask) = tagger.emissions(rows)
        tags = np.where(mask, tagger.decode(scores, mask), 0)
        some = np.flatnonzero((tags > 0).any(axis=1))
        if len(some) == 0:
            continue
        sure = tagger.marginals(scores[some], mask[some])
        for row, posterior in zip(some, sure, strict=True):
            k, start = part[row]
            line = tags[row]
            begins = np.flatnonzero((line > 0) & ((np.diff(line, prepend=0) != 0) & (line % 2 == 1) | (np.diff(line, prepend=0) != 0) & (np.concatenate([[0], line[:-1]]) == 0)))
            for begin in begins.tolist():
                kind = (line[begin] - 1) // 2
                end = begin + 1
                while end < WIDTH and line[end] == 2 * kind + 2:
                    end += 1
                inner = (begin > 0 or start == 0) and (end < WIDTH or start + WIDTH >= len(texts[k]))
                if inner and LEAST_CHARS <= end - begin <= MOST_CHARS:
                    value = float(posterior[np.arange(begin, end), line[begin:end]].min())
                    if value >= least and plausible(KINDS[kind], texts[k][start + begin:start + end]):
                        out[k].append((value, KINDS[kind], start + begin, start + end))
    return out


def reconciled(base: list[tuple[str, int, int]], ruled_out: list[tuple], added: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and the surest added ones that overlap nothing, by start and kind; what is ruled out (start, end[, kind]) bars its kind, or all."""
    kept: list[tuple[str, int, int]] = []
    free = []
    barred = {}
    for of in {kind for _, kind, _, _ in added}:
        taken = sorted([(start, end) for _, start, end in base] + [t[:2] for t in ruled_out if of in t[2:] or len(t) == 2])
        barred[of] = [t[0] for t in taken], np.maximum.accumulate([t[1] for t in taken]).tolist() if taken else []
    for value, kind, start, end in added:
        starts, reach = barred[kind]
        at = int(np.searchsorted(starts, end, side="left")) - 1
        if at < 0 or reach[at] <= start:
            free.append((value, kind, start, end))
    busy: set[int] = set()
    for _, kind, start, end in sorted(set(free), key=lambda s: (-s[0], s[2], s[3], s[1])):
        if busy.isdisjoint(range(start, end)):
            busy.update(range(start, end))
            kept.append((kind, start, end))
    return sorted([*base, *kept], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def find(docs: DataFrame, tagger: Tagger | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans, masked): spans written kind:start:end, comma-joined."""
    kind = docs.select(key).schema.simpleString()[7:-1].replace(":", " ", 1)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text, 2 << 20):
            values = [value or "" for value in batch.column(text).to_pylist()]
            extra = added_spans(model, values) if model is not None else [[] for _ in values]
            base, every, clean = [], [], []
            for value, more in zip(values, extra, strict=True):
                own, ruled_out = base_spans(value)
                spans = reconciled(own, ruled_out, more) if more else own
                base.append(shown(own))
                every.append(shown(spans))
                clean.append(masked(value, spans))
            yield pa.record_batch([batch.column(key), pa.array(base), pa.array(every), pa.array(clean)], names=[key, "base", "spans", "masked"])

    return docs.select(key, text).mapInArrow(found, f"{kind}, base string, spans string, masked string")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the bounded sample, then find the spans of every text."""
    return find(docs, train(docs, text), key, text)


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their personal data replaced; n_chars, if there, follows the text. Null stays null."""
    tagger = train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text, 2 << 20):
            values = batch.column(text).to_pylist()
            extra = added_spans(model, [v or "" for v in values]) if model is not None else [[] for _ in values]
            done = []
            for value, more in zip(values, extra, strict=True):
                if value is not None:
                    own, ruled_out = base_spans(value)
                    value = masked(value, reconciled(own, ruled_out, more))
                done.append(value)
            columns = [pa.array(done, pa.string()) if name == text else
                       pa.array([None if v is None else len(v) for v in done], batch.column(name).type) if name == "n_chars" else batch.column(name) for name in names]
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
