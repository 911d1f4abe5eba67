"""Measures between two texts that SQL functions lack, over Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _trimmed(a: list, b: list) -> tuple[list, list]:
    """Without what both have in common at the start and at the end; distances stay the same."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
        k += 1
    return (a[: len(a) - k], b[: len(b) - k])


def _places(a: list) -> dict:
    """Each element's places in ``a`` as the bits of one number."""
    at: dict = {}
    for k, c in enumerate(a):
        at.setdefault(c, []).append(k)
    out = {}
    for c, ks in at.items():
        bits = bytearray(len(a) // 8 + 1)
        for k in ks:
            bits[k >> 3] |= 1 << (k & 7)
        out[c] = int.from_bytes(bits, "little")
    return out


def edit_distance(a: list, b: list, substitute: int = 1) -> int:
    """Edits that make b of a; with ``substitute`` 2 only insertions and deletions count.

    Bit-parallel: a column of the table is two numbers of len(a) bits, so texts of a whole issue take
    seconds, in memory that grows with their length alone.
    """
    a, b = _trimmed(list(a), list(b))
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at, full, top = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    if substitute > 1:  # the longest common subsequence, one bit a step along it
        row = full
        for c in b:
            met = row & at.get(c, 0)
            row = ((row + met) | (row - met)) & full
        return len(a) + len(b) - 2 * (len(a) - row.bit_count())
    up, down, distance = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        straight = (((eq & up) + up) ^ up) | eq | down
        higher = down | (full & ~(straight | up))
        lower = up & straight
        distance += bool(higher & top) - bool(lower & top)
        higher = (higher << 1 | 1) & full
        up = (lower << 1 & full) | (full & ~(straight | higher))
        down = higher & straight
    return distance


#: Characters up to which the fallback distance is made.
FALLBACK_MOST = 120_000


def block_distance(a: list, b: list) -> int | None:
    """Edits by matching blocks, an upper bound of the exact distance: a replaced block counts its longer side. None beyond FALLBACK_MOST."""
    if max(len(a), len(b)) > FALLBACK_MOST:
        return None
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in blocks if tag != "equal")


@F.pandas_udf(T.DoubleType())
def word_error_rate(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Word edits divided by the words of the reference, 4 places; null for null."""
    return pd.Series([None if h is None or r is None else round(edit_distance(h.split(), r.split()) / max(1, len(r.split())), 4) for h, r in zip(hyp, ref)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def character_error_rate(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Character edits divided by the characters of the reference, 4 places; null for null."""
    return pd.Series([None if h is None or r is None else round(edit_distance(list(h), list(r)) / max(1, len(r)), 4) for h, r in zip(hyp, ref)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def substitution_share(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Of all wrong characters the share that is misread, not missing or added, 3 places; null for null."""

    def share(h: str | None, r: str | None) -> float | None:
        if h is None or r is None:
            return None
        edits, indels = edit_distance(list(h), list(r)), edit_distance(list(h), list(r), 2)
        subs, rest = max(0, indels - edits), max(0, 2 * edits - indels)
        return round(subs / max(1, subs + rest), 3)

    return pd.Series([share(h, r) for h, r in zip(hyp, ref)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Python's SequenceMatcher ratio with its popular-element rule, 3 places; null for null."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else round(difflib.SequenceMatcher(None, x, y).ratio(), 3) for x, y in zip(a, b)], dtype="float64")


DIFF = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]))


@F.pandas_udf(DIFF)
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Word-level edits that are not equal: tag, old words, new words. Null reads as ''."""

    def diff(a: str | None, b: str | None) -> list[dict]:
        x, y = (a or "").split(), (b or "").split()
        return [{"tag": t, "old": " ".join(x[i:j]), "new": " ".join(y[k:n])} for t, i, j, k, n in difflib.SequenceMatcher(None, x, y).get_opcodes() if t != "equal"]

    return pd.Series([diff(a, b) for a, b in zip(old, new)])


def best_window(probe: str, hay: str, least: float) -> tuple[int, int] | None:
    """Start and end of the part of ``hay`` most like ``probe``, if its similarity reaches ``least``.

    Runs of characters of the probe are looked up in an index of hay; the most voted offset is compared
    exactly. Shorter runs are tried where longer ones show nothing, down to pairs.
    """
    return next((found for step in (8, 4, 2) if (found := _voted(probe, hay, least, step))), None)


def _voted(probe: str, hay: str, least: float, step: int) -> tuple[int, int] | None:
    where: dict[str, list[int]] = {}
    wanted = {probe[i : i + step] for i in range(len(probe) - step + 1)}
    for i in range(len(hay) - step + 1):
        piece = hay[i : i + step]
        if piece in wanted:
            where.setdefault(piece, []).append(i)
    votes: dict[int, int] = {}
    for i in range(len(probe) - step + 1):
        for at in where.get(probe[i : i + step], ()):
            votes[(at - i) // 16] = votes.get((at - i) // 16, 0) + 1
    if not votes:
        return None
    start = max(0, max(votes, key=lambda k: (votes[k] + votes.get(k + 1, 0), -k)) * 16)
    window = hay[start : start + len(probe) + 16]
    blocks = [b for b in difflib.SequenceMatcher(None, probe, window, autojunk=False).get_matching_blocks() if b.size]
    if not blocks or 2 * sum(b.size for b in blocks) / (len(probe) + max(len(probe), 1)) < least:
        return None
    first, last = blocks[0], blocks[-1]
    return start + first.b, start + last.b + last.size


def locate_span(hay: str | None, ref: str | None, probe: int = 300, places: tuple[float, ...] = (0.1, 0.5, 0.9), least: float = 0.6, least_end: float = 0.55) -> str | None:
    """The part of ``hay`` that carries ``ref``: probes are sought, and at least two of them must be found.

    How far the found probes lie from where they would in a faithful copy tells where the span's ends are
    to be expected; each end is then sought in a stretch about that place, wide enough for a twentieth of
    the text to be missing or added. An end that isn't found is the expected one. Null for a reference of
    fewer than three probes' length, or an empty text.
    """
    if not hay or not ref or len(ref) < 3 * probe:
        return None
    shifts = []
    for share in places:
        at = min(int(len(ref) * share), len(ref) - probe)
        found = best_window(ref[at : at + probe], hay, least)
        if found:
            shifts.append(found[0] - at)
    if len(shifts) < 2:
        return None
    slack = probe + len(ref) // 20

    def end(piece: str, expected: int, side: int) -> int:
        low = min(max(0, expected - slack - (probe if side else 0)), len(hay))
        found = best_window(piece, hay[low : expected + slack + (0 if side else probe)], least_end)
        return low + found[side] if found else min(max(0, expected), len(hay))

    first, last = end(ref[:probe], shifts[0], 0), end(ref[-probe:], shifts[-1] + len(ref), 1)
    return hay[first:last] if first < last else None


@F.pandas_udf(T.StringType())
def located(hay: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([locate_span(h, r) for h, r in zip(hay, ref)], dtype="object")
