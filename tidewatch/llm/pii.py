"""Personal data: patterns with validity tests, and a character tagger that adds what they miss.

Base spans come from four patterns, leftmost and non-overlapping for each kind, and must pass their test
(Luhn, parts of at most 255, numbers of digits). The tagger (``pii_model``) reads every text as a whole, in overlapping windows. Where it
is sure enough of a span, what has the written form of the kind there (``_SHAPES``; wider than the patterns: no ``+``, other separators, ``[at]``) and the kind's digits
(a card must also pass Luhn) is added, unless it overlaps a base span. Offsets are code points, ends exclusive.

Defined cases: a null text has no spans; repeated rows are searched each; a null doc_id stays; empty tables give
no rows; further columns are kept by ``mask`` and ignored by ``find``; long texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewatch.llm import pii_model
from tidewatch.llm.common import released
from tidewatch.llm.pii_model import KINDS

Span = tuple[int, int, int]  # kind, start, end

SURE = 0.7

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]")
#: Written forms of the kinds that the tagger may add.
_SHAPES = (
    re.compile(r"[A-Za-z0-9._%+-]++ ?(?:@|[(\[] ?[aA][tT] ?[)\]]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9](?:[\x20./-]?[0-9])+"),
    re.compile(r"(?<![0-9.])(?:\+|\((?=[0-9]{1,5}\)))?[0-9](?:[\x20().-]{0,2}[0-9])+"),
)


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 if d > 4 else 2 * d for d in back[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @, so that long runs of name characters cost no more than once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at)  # characters before this @ can't lead to a later one
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """The patterns' spans by start, then kind."""
    if not text:
        return []
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if _NUMBER.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NUMBER.findall(m.group())) <= 15:
                    found.append((3, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def plausible(kind: int, value: str) -> bool:
    digits = "".join(_NUMBER.findall(value))
    if kind == 1:
        return all(int(p) <= 255 for p in re.findall("[0-9]+", value))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 10 <= len(digits) <= 15 and len(digits) < len(value)


def shaped(kind: int, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What has the form of the kind and overlaps the span; the tagger may have stopped inside it, or taken two in a row for one."""
    at = start
    while at > 0 and start - at < 320 and (_LOCAL.match(text[at - 1]) if kind == 0 else text[at - 1] in "+(0123456789"):
        at -= 1
    for m in _SHAPES[kind].finditer(text, at):
        if m.start() >= end:
            break
        if m.end() > start and plausible(kind, m.group()):
            yield m.span()


def all_spans(texts: list[str | None], tagger: pii_model.Tagger) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and base and added spans together."""
    for text, tagged in zip(texts, tagger.decode([t or "" for t in texts]), strict=True):
        base = base_spans(text)
        every = list(base)
        for kind, start, end, sure in tagged:
            if sure >= SURE:
                for x, y in shaped(kind, text, start, end):
                    if not any(x < d and c < y for _, c, d in every):
                        every.append((kind, x, y))
        yield base, sorted(every, key=lambda s: (s[1], s[0], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of at most 1,000 rows, so that few windows are held at once."""
    for batch in batches:
        for k in range(0, len(batch), 1000):
            yield batch.iloc[k : k + 1000]


def find(docs: DataFrame, tagger: pii_model.Tagger | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all) and added (how many the tagger adds)."""
    held = docs.sparkSession.sparkContext.broadcast(tagger or pii_model.trained())
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_" + k for k in KINDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = []
            for own, every in all_spans(batch[text].tolist(), held.value):
                counts = np.bincount([k for k, _, _ in own], minlength=len(KINDS)).tolist()
                rows.append((*counts, hashlib.sha256(written(own).encode()).hexdigest(), written(every), len(every) - len(own)))
            out = pd.DataFrame(rows, columns=[*names, "base_sha256", "spans", "added"])
            out.insert(0, key, batch[key].values)
            yield out

    return docs.select(key, text).mapInPandas(released(run), f"{key} {kind}, {', '.join(n + ' long' for n in names)}, base_sha256 string, spans string, added long")


def masked(text: str, spans: list[Span]) -> str:
    """Each span, or overlapping spans together, as <KIND> of the first."""
    out, at = [], 0
    for k, (kind, s, e) in enumerate(spans):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = e
        for _, s2, e2 in spans[k + 1 :]:
            if s2 >= at:
                break
            at = max(at, e2)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, tagger: pii_model.Tagger | None = None, text: str = "text") -> DataFrame:
    """docs with every span replaced; the same columns and rows."""
    held = docs.sparkSession.sparkContext.broadcast(tagger or pii_model.trained())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            texts = batch[text].tolist()
            new = [masked(t, every) if every else t for t, (_, every) in zip(texts, all_spans(texts, held.value), strict=True)]
            yield batch.assign(**{text: pd.Series(new, index=batch.index, dtype=object)})

    return docs.mapInPandas(released(run), docs.schema)
