"""Problem 5: noise in text from scanned pages.

Words are grouped by their confusable-glyph skeleton. In a group the frequent forms are the supported
ones; a rare form that the known confusions make out of a frequent one is misread, unless it stands in
unscanned texts just as often. Heads are lines whose key, digits masked and glyphs made equal, comes back
with other page numbers, and single lines that are the magazine's or the story's name. Broken words are
joined over lines, heads and numbers between them left out, and the page is reflowed into paragraphs by
SQL windows.

The frequent forms are all that are used five times or more. As many of them as a worker can hold are sent
once to each executor; where there are more, the rarer ones meet the records by a join on the strokes of
their glyphs, so the result does not depend on the size. So it is with the magazines' names: those that
no worker holds meet the lines that look like heads by a join on parts of both. Null and empty texts have
no lines and no defects. Exact duplicate rows count once.
"""

from __future__ import annotations

import re
from collections import ChainMap
from collections.abc import Iterable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.confusables import consistent_form
from leafmill.session import cut

#: A frequent form has at least this count; at most so many forms, and as many names, are sent to the workers.
LEAST, MOST_FORMS = 5, 300_000
#: A form with more than this share of its likely source's count is a word of its own.
RARE = 0.05
#: Numbers that a masked line must have been seen with to be a head.
HEAD_NUMBERS = 3

# --- fixed values: what scans make of letters (letter or letters: readings) ---
MISREADINGS = {
    "e": "c", "a": "o", "t": "f", "y": "v", "i": "l 1 | j", "l": "1 | i", "o": "0", "s": "5", "b": "6 8", "g": "9 q", "z": "2", "q": "g 9",
    "h": "li", "d": "cl", "m": "rn", "n": "ri", "u": "ii", "w": "vv", "rn": "m", "in": "m", "ri": "n", "cl": "d", "vv": "w", "ii": "u", "li": "h",
}
DIGIT_LETTERS = {"0": "o", "1": "il", "|": "li", "5": "s", "6": "b", "8": "b", "9": "gq", "3": "e", "4": "a", "2": "z", "7": "t"}
SKELETON_PAIRS = [("ii", "u"), ("ri", "n"), ("li", "h"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("in", "m")]
SKELETON_CLASSES = ["ceoa034", "il1|!j", "tf7", "hb68", "un", "s5z2", "g9q", "yv"]
#: Capital lines that are no heads.
NO_HEADS = "the end|end of|to be continued|continued|conclusion|concluded|chapter|part|by"

_CLASS = str.maketrans({c: g[0] for g in SKELETON_CLASSES for c in g})
_READ = [(a, r) for a, rs in MISREADINGS.items() for r in rs.split()]
_WORD = re.compile(r"[^\W_]+(?:\|[^\W_]*)*|\|[^\W_]+(?:\|[^\W_]*)*")
_TAIL = re.compile(r"([^\W_]+(?:[-|'][^\W_]+)*) ?[-¬=] ?$")
_SIGNS = frozenset("-¬=")
_HEAD_OF = re.compile(r"\W*?([^\W_]+(?:[|'-][^\W_]+)*)")
_DIGITAL = re.compile(r"[^\W\d_]{2}[0-9|]|[^\W\d_][0-9|][^\W\d_]|[0-9|][^\W\d_]{2}")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|s|d|ers?|ème|er)$")
_NUMBER = re.compile(r"[^\w$]*(?:page|pg|p)?[^\w$]*(?:\d[\dlIOSBgo|]{0,3}|[lIOSBo|]{1,3}\d[\dlIOSBgo|]{0,2}|[lI|][lIOS|]{1,2}|[\dlIOS|](?: [\dlIOS|]){1,3})[^\w$.,;:!?]*", re.I)
_LOWER = re.compile(r"(?<![\w'’|-])[a-z]")
_FRAME = re.compile(r"^[\W_]*(?:\d[\dlIOSBgo|]{0,3}(?=\s))?[\W_]*|[\W_]*(?:(?<=\s)[\dlIOSB|]{1,4})?[\W_]*$")
_JOINED = re.compile(r"^(\S+?)- \+ (\S+) -> (\S+?)[^\w|]*$")


def skeleton(word: str) -> str:
    """Equal for words that differ by confusable glyphs."""
    for a, b in SKELETON_PAIRS:
        if a in word:
            word = word.replace(a, b)
    return word.translate(_CLASS)


#: The strokes that glyphs are made of; the known misreadings cut the same strokes another way.
_STROKES = str.maketrans(
    {c: strokes for glyphs, strokes in (("m", "iii"), ("nuhb68", "ii"), ("d", "ci"), ("w", "vv"), ("yv", "v"), ("rl1|ij", "i"), ("tf7", "t"), ("ceoa034", "c"), ("s5z2", "s"), ("g9q", "g"), ("-", "")) for c in glyphs}
)


def strokes_of(word: str) -> str:
    """Equal for a word, whatever misreadings it suffered, and with or without its hyphens."""
    return word.translate(_STROKES)


@F.pandas_udf(T.StringType())
def _strokes(words: pd.Series) -> pd.Series:
    return words.map(strokes_of, na_action="ignore")


def readable_as(true: str, seen: str, most: int = 3) -> bool:
    """Whether one to ``most`` known misreadings make ``seen`` of ``true``."""
    if abs(len(true) - len(seen)) > most:
        return False
    stack = [(0, 0, 0)]
    while stack:
        i, j, n = stack.pop()
        if i == len(true) and j == len(seen):
            if n:
                return True
            continue
        if i < len(true) and j < len(seen) and true[i] == seen[j]:
            stack.append((i + 1, j + 1, n))
        if n < most:
            stack += [(i + len(a), j + len(r), n + 1) for a, r in _READ if true.startswith(a, i) and seen.startswith(r, j)]
    return False


class Forms:
    """Frequent forms with their counts, and what else a word may be a misreading of."""

    def __init__(self, rows: list[tuple[str, int, float]], least: int) -> None:
        self.least = least
        self.by_length: dict[int, list[str]] = {}
        self.n = {w: n for w, n, _ in rows}
        self.own = {w for w, _, clean in rows if clean > 0.55}
        self.groups: dict[str, list[tuple[int, str]]] = {}
        for w, n, _ in rows:
            if not any(c.isdigit() or c == "|" for c in w):
                self.groups.setdefault(skeleton(w), []).append((n, w))
        for g in self.groups.values():
            g.sort(reverse=True)
        self.known: dict[str, str] = {}

    def truth(self, word: str) -> str:
        """The word that ``word`` (lower case) is misread from, or ''."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 400_000:
                self.known.clear()
            found = self.known[word] = self._truth(word)
        return found

    def _truth(self, word: str) -> str:
        if len(word) < 2 or word.isdigit():
            return ""
        if any(c in DIGIT_LETTERS for c in word):
            if not _DIGITAL.search(word) or _ORDINAL.fullmatch(word) or sum(c.isalpha() for c in word) < 2:
                return ""
            places = [DIGIT_LETTERS.get(c, c) for c in word]
            if sum(len(p) > 1 for p in places) <= 6:
                tries = ["".join(p) for p in product(*places)]
                best = max(tries, key=lambda w: self.n.get(w, 0))
            else:  # fewer forms have the length than there are readings
                best = max((w for w in self._of_length(len(word)) if all(c in p for c, p in zip(w, places))), key=self.n.__getitem__, default="")
            if self.n.get(best, 0):
                return best
            plain = "".join(p[0] for p in places)
            return self._truth(plain) or plain
        n = self.n.get(word, 0)
        if word in self.own and n > 12:
            return ""
        for m, v in self.groups.get(skeleton(word), ()):
            if m < 2 * self.least or n > RARE * m:
                break
            if v != word and readable_as(v, word):
                return v
        best = max(self._undone(word), key=lambda w: self.n.get(w, 0), default="")  # misreadings that run into one another
        m = self.n.get(best, 0)
        return best if m >= 2 * self.least and n <= RARE * m else ""

    def _of_length(self, n: int) -> list[str]:
        if not self.by_length:
            for w in self.n:
                self.by_length.setdefault(len(w), []).append(w)
        return self.by_length.get(n, [])

    @staticmethod
    def _undone(word: str) -> set[str]:
        """What the word may have been before one or two misreadings."""
        once = {word[:i] + a + word[i + len(r) :] for a, r in _READ for i in range(len(word)) if word.startswith(r, i)}
        twice = {w[:i] + a + w[i + len(r) :] for w in once for a, r in _READ for i in range(len(w)) if w.startswith(r, i)} if len(word) > 5 else set()
        return (once | twice) - {word}


class _Either:
    """Membership and groups of two collections, none of them copied."""

    def __init__(self, few, many) -> None:
        self.few, self.many = few, many

    def __contains__(self, x: str) -> bool:
        return x in self.few or x in self.many

    def get(self, key: str, default=()) -> list:
        few, many = self.few.get(key), self.many.get(key)
        return sorted([*few, *(many or ())], reverse=True) if few else many or default


class Extended(Forms):
    """The forms that every worker has, with the rarer ones that a record's words may stand for."""

    def __init__(self, base: Forms, rows: list[tuple[str, int, float]]) -> None:
        more = Forms(rows, base.least)
        self.least, self.by_length, self.known = base.least, {}, {}
        self.n = ChainMap(more.n, base.n)
        self.own, self.groups = _Either(more.own, base.own), _Either(more.groups, base.groups)


def for_record(forms: Forms, status: "Status", rare) -> tuple[Forms, "Status"]:
    """The forms and their cache for a record: the common ones where it has no rarer forms of its own."""
    if rare is None or not len(rare):
        return forms, status
    own = Extended(forms, [(r["word"], r["n"], r["clean"]) for r in rare])
    return own, Status(own)


class Status(dict):
    """Piece of text between spaces to whether one of its words may be misread, or it is broken."""

    def __init__(self, forms: Forms) -> None:
        super().__init__()
        self.forms = forms

    def __missing__(self, piece: str) -> bool:
        if len(self) > 400_000:
            self.clear()
        found = self[piece] = bool(misread_words(piece, self.forms)) or piece[-1:] in "-¬="
        return found


def misread_words(text: str, forms: Forms) -> list[tuple[int, str, str]]:
    """Place, word as read and true word of the misread words of a text without breaks."""
    if not text.isascii():
        text = consistent_form(text)
    low = text.lower()
    out = []
    for m in _WORD.finditer(low):
        true = forms.truth(m[0].rstrip("|") if m[0].count("|") == 1 and m[0].endswith("|") and m[0][:-1] in forms.n else m[0])
        if true:
            out.append((m.start(), m[0], true))
    return out


def fold_head(line: str) -> str:
    """A line's letters and digits with glyphs made equal: the masked key of a head."""
    return "".join(c for c in consistent_form(line).lower() if c.isalnum() or c == "|").translate(_CLASS)


def _most_unlike(length: int) -> int:
    """In how many places two close names of that length may differ."""
    return max(1, length // 6) if length > 5 else 0


def _close(a: str, b: str) -> bool:
    """Equal but for one glyph in six, places kept."""
    return a == b or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= _most_unlike(len(a))


def parts_of(key: str) -> list[str]:
    """Parts of a folded name with its length and their places, one more than close names have differences: these share one at least."""
    n = _most_unlike(len(key)) + 1
    at = [len(key) * k // n for k in range(n + 1)]
    return [f"{len(key)}/{k}/{key[at[k] : at[k + 1]]}" for k in range(n)]


def may_be_head(line: str) -> str:
    """The line without its margins if it has the shape of a head, else ''."""
    s = line.strip()
    return "" if not 4 < len(s) <= 160 or s[-1] in ".,;:!?\"”" or _LOWER.search(s) else s


def head_keys(s: str) -> set[str]:
    """The folded names that a line of the shape of a head may stand for, with and without its numbers."""
    keys = {fold_head(_FRAME.sub("", s)), fold_head(s), fold_head(re.sub(r"[\W_]*\d{1,4}[\W_]*$", "", s)), fold_head(re.sub(r"^[\W_]*\d{1,4}[\W_]+", "", s))}
    return {k for k in keys if len(k) > 3}


class Heads:
    """Names that stand as heads: those of the magazines, and the story's own."""

    def __init__(self, magazines: Iterable[str], folded: Iterable[str] = ()) -> None:
        self.by_part: dict[str, list[str]] = {}
        self.near: frozenset[str] = frozenset()  # keys known to be close to names that are not held
        for m in {fold_head(m) for m in magazines} | set(folded):
            if len(m) > 4:
                for part in parts_of(m):
                    self.by_part.setdefault(part, []).append(m)

    def for_record(self, near) -> "Heads":
        """These names with a record's keys that are close to one of the others."""
        if near is None or not len(near):
            return self
        own = Heads(())
        own.by_part, own.near = self.by_part, frozenset(near)
        return own

    def is_name(self, key: str) -> bool:
        return key in self.near or any(_close(key, m) for part in parts_of(key) for m in self.by_part.get(part, ()))

    def is_head(self, line: str, title: str | None, alone: bool) -> bool:
        """Whether the line is a name; ``alone``: no capital lines stand around it, so it is no shouted sentence."""
        s = may_be_head(line)
        if not s:
            return False
        bare, keys = _FRAME.sub("", s), head_keys(s)
        if title and any(_close(k, t) for k in keys for t in (fold_head(title),)):
            return True
        if any(map(self.is_name, keys)):
            return True
        letters = [c for c in bare if c.isalpha()]
        if len(letters) < 8 or re.match(rf"(?:{NO_HEADS})\b", bare.lower()):
            return False
        spaced = bool(re.match(r"(?:\S ){4}", bare))
        if any(c.islower() for c in letters):  # every word has a capital, as in a printed name; leaders stand in contents pages
            return title is None and ".." not in s and " " in bare and bool(re.search(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$|^\*.*\*$", s))
        framed = s != bare and bool(re.search(r"^[\d*]|[\d*lIOS]$", s)) and (" " in bare or spaced)
        return spaced or framed or (title is None and alone and " " in bare)


def line_kinds(lines: list[str], title: str | None, heads: Heads) -> list[str]:
    """For each line: 'blank', 'number', 'head' or 'text'."""
    kinds = []
    for at, line in enumerate(lines):
        s = line.strip()
        if not s:
            kinds.append("blank")
        elif len(s) <= 16 and _NUMBER.fullmatch(s) and not (s.isalpha() and s.lower() in ("is", "so", "il", "los", "lo", "si", "go", "ll")):
            kinds.append("number")
        elif heads.is_head(line, title, not any(x.isupper() and " " in x.strip() for x in (lines[at - 1] if at else "", lines[at + 1] if at + 1 < len(lines) else ""))):
            kinds.append("head")
        else:
            kinds.append("text")
    return kinds


def defects_of(text: str, title: str | None, heads: Heads, forms: Forms, status: Status) -> list[tuple[int, str]]:
    """line_no and defect of all defects of a text."""
    if "\n" not in text:
        if not any(map(status.__getitem__, text.split())):
            return []
    lines = text.split("\n")
    kinds = line_kinds(lines, title, heads)
    out = [(k + 1, "running_head" if kind == "head" else "page_number") for k, kind in enumerate(kinds) if kind in ("head", "number")]
    printed = [k for k, kind in enumerate(kinds) if kind == "text"]
    carried = ""  # what the line before left of a word
    for at, k in enumerate(printed):
        line = lines[k]
        tail = _TAIL.search(line) if line.rstrip()[-1:] in _SIGNS else None
        after = _HEAD_OF.match(lines[printed[at + 1]]) if tail and at + 1 < len(printed) else None
        broken = bool(after and lines[printed[at + 1]].lstrip()[:1].isalnum() and (after[1][0].islower() or after[1][0].isdigit() or tail[1].isupper()))
        if broken:
            out.append((k + 1, "hyphen_break"))
            whole = (tail[1] + after[1]).lower()
            true = "" if whole in forms.n or f"{tail[1]}-{after[1]}".lower() in forms.n else _whole_truth(tail[1].lower(), after[1].lower(), forms)
            if true:
                upper, lower = _where(true, tail[1].lower(), after[1].lower())
                out += [(k + 1, "misread")] * upper + [(printed[at + 1] + 1, "misread")] * lower
        body = line[: tail.start()] if broken else line
        if carried:
            start = _HEAD_OF.match(body)
            body = body[start.end() :] if start else body
        carried = tail[1] if broken else ""
        if any(map(status.__getitem__, body.split())) and misread_words(_inner_joined(body), forms):
            out.append((k + 1, "misread"))
    return sorted(set(out))


def _inner_joined(line: str) -> str:
    return re.sub(r"(?<=[^\W\d_]) ?[-¬=] (?=[a-z])", "", line)


def _whole_truth(left: str, right: str, forms: Forms) -> str:
    """The true form of a word broken after ``left``."""
    found = forms.truth(left + right)
    if found:
        return found
    if f"{left}-{right}" != left + right:
        compound = next((v for m, v in forms.groups.get(skeleton(f"{left}-{right}"), ()) if readable_as(v, f"{left}-{right}")), "")
        return compound
    return ""


def _where(true: str, left: str, right: str) -> tuple[int, int]:
    """Whether the misread letters stand in the left and in the right part."""
    true = true.replace("-", "")
    lefts = [i for i in range(len(true) + 1) if true[:i] == left or readable_as(true[:i], left)]
    for i in lefts:
        rest = true[i:]
        if rest == right or readable_as(rest, right):
            return int(true[:i] != left), int(rest != right)
    return 1, 0


def joined_defect(joined: str | None, forms: Forms) -> list[str]:
    """'misread' or 'lost_hyphen' of a joined word written ``left- + right -> result``."""
    m = _JOINED.match(joined or "")
    if not m:
        return []
    left, right, result = (x.lower().strip("|") if x.count("|") > 1 else x.lower() for x in m.groups())
    compound = f"{left}-{right}"
    if "-" in result:
        return ["misread"] if misread_words(result, forms) else []
    if forms.n.get(compound, 0) > 2 * forms.n.get(result, 0):
        return ["lost_hyphen"]
    out = []
    near = next((v for n, v in forms.groups.get(skeleton(compound), ()) if readable_as(v, compound)), "") if result not in forms.n else ""
    if near and forms.n[near] > 2 * forms.n.get(near.replace("-", ""), 0):
        return ["lost_hyphen", "misread"]
    if misread_words(result, forms):
        out.append("misread")
    return out


def shaped(true: str, seen: str) -> str:
    """``true`` in capitals where ``seen`` is."""
    return true.upper() if len(seen) > 1 and seen.isupper() else true[:1].upper() + true[1:] if seen[:1].isupper() else true


def put_right(text: str, forms: Forms) -> str:
    """The text with its misread words put right."""
    text = consistent_form(text)
    for at, seen, true in reversed(misread_words(text, forms)):
        text = text[:at] + shaped(true, text[at : at + len(seen)]) + text[at + len(seen) :]
    return text


def joined_word(left: str, right: str, forms: Forms) -> str:
    """The word broken into ``left`` and ``right``: misread letters put right, the hyphen kept where the compound is the frequent form."""
    left, right = consistent_form(left), consistent_form(right)
    whole, compound = f"{left}{right}", f"{left}-{right}"
    n, m = forms.n.get(whole.lower(), 0), forms.n.get(compound.lower(), 0)
    if m > 2 * n or left.isdigit():
        return compound
    true = "" if n else _whole_truth(left.lower(), right.lower(), forms)
    true = true or forms.truth(whole.lower())
    return shaped(true, whole) if true else whole


def joined_right(joined: str, forms: Forms) -> str:
    """The correct word of a joined word written ``left- + right -> result``; what is written otherwise, with misread words put right."""
    m = _JOINED.match(joined)
    if not m:
        return put_right(joined, forms)
    left, right, result = (x.strip("|") if x.count("|") > 1 else x for x in m.groups())
    return put_right(result, forms) if "-" in result else joined_word(left, right, forms)


JOINED = T.StructType([T.StructField("source_table", T.StringType()), T.StructField("record_key", T.StringType()), T.StructField("text", T.StringType())])


def right_joins(joins: DataFrame, forms: Forms, rare: DataFrame | None = None) -> DataFrame:
    """source_table, record_key, text (the correct word) of every joined word; without rarer forms there is no shuffle."""
    held = joins.sparkSession.sparkContext.broadcast(forms)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = held.value
        status = Status(forms)
        for b in batches:
            text = [joined_right(t, for_record(forms, status, more)[0]) for t, more in zip(b["text"], b["_rare"])]
            yield b[["source_table", "record_key"]].assign(text=text)

    rows = joins.where("text is not null").select("source_table", "record_key", "text")
    return with_rare(rows, ["source_table", "record_key"], rare).mapInPandas(put, JOINED)


def words(text):
    """The words of a text column: lower case, words broken over lines joined, hyphens kept inside."""
    joined = F.regexp_replace(F.lower(text), r" ?[-¬=] ?\n *", "")
    return F.transform(F.split(joined, r"[^\p{L}\p{N}|-]+"), lambda w: F.trim(w, F.lit("-")))


def forms_of(texts: DataFrame, least: int = LEAST, most: int = MOST_FORMS) -> tuple[Forms, DataFrame | None]:
    """The frequent forms of all texts (column ``text``), and the rarer rest (word, n, clean), null where there is none.

    Frequent are all forms of at least ``least`` uses, wherever there are no more than ``most`` of them; in
    a larger collection as many as ``most`` of the most frequent ones go to the workers, and the rest
    meets the records by a join (``with_rare``), with the same result. Counts are partial before the
    shuffle and cover all texts.
    """
    scanned = F.col("text").rlike(r"\p{L}[0-9|]\p{L}")
    per_text = texts.where("text is not null").select(words(F.col("text")).alias("_words"), scanned.alias("_scanned"))
    counted = per_text.select(F.explode("_words").alias("word"), "_scanned").where("word <> ''")
    counts = cut(counted.groupBy("word").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_scanned"), 0).otherwise(1)).alias("_clean")))
    # how many forms there are of each count up to a power of two: a few dozen rows
    sizes = counts.where(F.col("n") >= least).groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("forms")).collect()
    bound, left = least, sum(r.forms for r in sizes)
    for r in sorted(sizes, key=lambda r: r.b):
        if left <= most:
            break
        bound, left = 2 ** (r.b + 1), left - r.forms
    known = counts.select("word", "n", (F.col("_clean") / F.col("n")).alias("clean"))
    forms = Forms([(r.word, r.n, r.clean) for r in known.where(F.col("n") >= bound).collect()], least)
    return forms, known.where((F.col("n") >= least) & (F.col("n") < bound)) if bound > least else None


def with_rare(records: DataFrame, keys: list[str], rare: DataFrame | None) -> DataFrame:
    """records with ``_rare``: the rarer forms that have the strokes of any of the record's words; null without any.

    Whatever known misreadings make of a form, its strokes stay, so no form that a word may stand for is missed.
    """
    if rare is None:
        return records.withColumn("_rare", F.lit(None).cast("array<struct<word string, n bigint, clean double>>"))
    mine = records.select(*keys, F.explode(F.array_distinct(words(F.col("text")))).alias("word")).where("word <> ''")
    mine = mine.select(*keys, _strokes("word").alias("_s")).distinct()
    hits = mine.join(rare.withColumn("_s", _strokes("word")), "_s").groupBy(*keys).agg(F.collect_set(F.struct("word", "n", "clean")).alias("_rare"))
    return records.join(hits, keys, "left")


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(fold_head, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parts(keys: pd.Series) -> pd.Series:
    return keys.map(parts_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys_of_lines(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted({k for line in t.split("\n") if (s := may_be_head(line)) for k in head_keys(s)}))


@F.pandas_udf(T.BooleanType())
def _are_close(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_close(x, y) for x, y in zip(a, b)], dtype=bool)


def heads_of(issues: DataFrame, most: int = MOST_FORMS) -> tuple[Heads, DataFrame | None]:
    """The magazines' names, and those beyond the most frequent ``most`` (column ``name``, folded like all of them), null where there are none.

    The rest meets the records by a join (``with_near``), with the same result.
    """
    spelled = issues.where("magazine is not null").groupBy("magazine").agg(F.count("*").alias("_n"))
    names = spelled.groupBy(_folded("magazine").alias("name")).agg(F.sum("_n").alias("_n")).where(F.length("name") > 4)
    top = names.orderBy(F.desc("_n"), "name").limit(most + 1).collect()
    heads = Heads((), [r.name for r in top[:most]])
    if len(top) <= most:
        return heads, None
    first = top[most]  # of the rest
    return heads, names.where((F.col("_n") < first._n) | ((F.col("_n") == first._n) & (F.col("name") >= first.name))).select("name")


def with_near(records: DataFrame, keys: list[str], names: DataFrame | None) -> DataFrame:
    """records with ``_near``: the keys of a record's lines that are close to one of ``names``; null without any.

    Every different key is compared once, with the names that share a part with it, which all close ones do.
    """
    if names is None:
        return records.withColumn("_near", F.lit(None).cast("array<string>"))
    mine = records.where("text is not null").select(*keys, F.explode(_keys_of_lines("text")).alias("_k")).distinct()
    split = lambda df, key: df.withColumn("_part", F.explode(_parts(key)))
    pairs = split(mine.select("_k").distinct(), "_k").join(split(names.select("name"), "name"), "_part")
    near = pairs.where(_are_close("_k", "name")).select("_k").distinct()
    hits = mine.join(near, "_k", "left_semi").groupBy(*keys).agg(F.collect_set("_k").alias("_near"))
    return records.join(hits, keys, "left")


def masked_heads(records: DataFrame, keys: list[str], least: int = HEAD_NUMBERS) -> DataFrame:
    """keys, line_no of lines that are heads by their masked key.

    A line in capitals, or with a capital at every word, that begins or ends with a page number is masked:
    the number goes, glyphs are made equal. A key that was seen with ``least`` different numbers is a
    head, whatever its name. Keys are counted by key and number first, so the head of the largest
    magazine is a few rows when it meets in one task.
    """
    lines = records.where("text is not null").select(*keys, F.posexplode(F.split("text", "\n")).alias("_at", "_line"))
    s = F.trim(F.col("_line"))
    shape = (F.length(s) > 4) & (F.length(s) <= 80) & s.rlike(r"^[\W_]*\d{1,4}[\W_]*\s[^\d]*$|^[^\d]*\s[\W_]*\d{1,4}[\W_]*$") & ~s.rlike(r"[.,;:!?\"”]$|(?<![\p{L}\p{N}_'’|-])[a-z]|\.\.|\$")
    bare = F.regexp_replace(F.lower(s), r"[^\p{L}|]+", "")
    named = ~F.lower(s).rlike(rf"^[\W_\d]*(?:{NO_HEADS}|vol|no|book|page)\b")
    glyphs = "".join(g[1:] for g in SKELETON_CLASSES)
    key = F.translate(bare, glyphs, "".join(g[0] * (len(g) - 1) for g in SKELETON_CLASSES))
    seen = lines.where(shape & named & (F.length(bare) >= 8)).select(*keys, (F.col("_at") + 1).alias("line_no"), key.alias("_key"), F.regexp_extract(s, r"(\d{1,4})", 1).alias("_number"))
    seen = cut(seen)  # few lines have the shape, and all lines are looked at
    heads = seen.groupBy("_key", "_number").agg(F.count("*").alias("_n")).groupBy("_key").agg(F.count("*").alias("_numbers")).where(F.col("_numbers") >= least)
    return seen.join(heads, "_key", "left_semi").select(*keys, "line_no").distinct()


DEFECTS = T.StructType([T.StructField("source_table", T.StringType()), T.StructField("record_key", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("defect", T.StringType())])


def find_defects(records: DataFrame, heads: Heads, forms: Forms, rare: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """source_table, record_key, line_no, defect of records (source_table, record_key, title, text).

    Heads are lines of a masked key that recurs with other numbers, and lines that are the magazine's or
    the story's name; other defects of a masked line are none. The forms are sent once to each executor.
    ``rare`` and ``names`` are the forms and names that no worker holds.
    """
    held = records.sparkSession.sparkContext.broadcast((heads, forms))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, forms = held.value
        status = Status(forms)
        for b in batches:
            rows = []
            for source, key, title, text, more, near in zip(b["source_table"], b["record_key"], b["title"], b["text"], b["_rare"], b["_near"]):
                if not text:
                    continue
                own, seen = for_record(forms, status, more)
                if source == "change_log":
                    rows += [(source, key, 1, d) for d in joined_defect(text, own)]
                else:
                    rows += [(source, key, n, d) for n, d in defects_of(text, title if isinstance(title, str) else None, heads.for_record(near), own, seen)]
            yield pd.DataFrame(rows, columns=DEFECTS.names).astype({"line_no": "int32"})

    ids = ["source_table", "record_key"]
    ready = with_near(with_rare(records.select(*ids, "title", "text"), ids, rare), ids, names)
    found = ready.mapInPandas(find, DEFECTS)
    masked = masked_heads(records.where("source_table <> 'change_log'"), ["source_table", "record_key"])
    others = found.join(masked, ["source_table", "record_key", "line_no"], "left_anti")
    return others.unionByName(masked.withColumn("defect", F.lit("running_head")))


LINES = T.StructType([T.StructField("record_key", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("indent", T.BooleanType()), T.StructField("joins", T.BooleanType())])


def _repaired(text: str, title: str | None, heads: Heads, forms: Forms, status: Status) -> list[tuple[int, str, str, bool, bool]]:
    """line_no, line, kind, indent, joins of a text's lines. A word broken over lines stands whole in the later one, which joins the line before."""
    lines = text.split("\n")
    kinds = line_kinds(lines, title, heads)
    out = [(k + 1, line.strip(), kind, line[:2] == "  ", False) for k, (line, kind) in enumerate(zip(lines, kinds))]
    printed = [k for k, kind in enumerate(kinds) if kind == "text"]
    carried = ""  # the whole word that the line before broke
    for at, k in enumerate(printed):
        line, joins = lines[k], bool(carried)
        if carried:
            line = carried + line[_HEAD_OF.match(line).end() :]
        whole, carried = carried, ""
        end = len(line)
        tail = _TAIL.search(line) if line.rstrip()[-1:] in _SIGNS else None
        if tail and at + 1 < len(printed):
            following = lines[printed[at + 1]]
            after = _HEAD_OF.match(following)
            if after and following.lstrip()[:1].isalnum() and (after[1][0].islower() or after[1][0].isdigit() or tail[1].isupper()):
                carried, end = joined_word(tail[1], after[1], forms), tail.start()
        body = line[len(whole) : end]
        if any(map(status.__getitem__, body.split())):
            body = put_right(body, forms)
        out[k] = (k + 1, (line[: min(len(whole), end)] + body).strip(), "text", lines[k][:2] == "  ", joins)
    return out


def repaired_lines(records: DataFrame, heads: Heads, forms: Forms, rare: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """record_key, line_no, line (misread words put right, broken ones whole), kind, indent, joins of every line."""
    held = records.sparkSession.sparkContext.broadcast((heads, forms))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, forms = held.value
        status = Status(forms)
        for b in batches:
            rows = []
            for key, title, text, more, near in zip(b["record_key"], b["title"], b["text"], b["_rare"], b["_near"]):
                rows += [(key, *line) for line in _repaired(text or "", title if isinstance(title, str) else None, heads.for_record(near), *for_record(forms, status, more))]
            yield pd.DataFrame(rows, columns=LINES.names).astype({"line_no": "int32", "indent": bool, "joins": bool})

    ready = with_near(with_rare(records.select("record_key", "title", "text"), ["record_key"], rare), ["record_key"], names)
    lines = ready.mapInPandas(repair, LINES)
    # by record alone: the partitioning that reflow needs anyway, so the lines are shuffled once
    masked = masked_heads(records, ["record_key"]).groupBy("record_key").agg(F.collect_set("line_no").alias("_masked"))
    head = F.coalesce(F.array_contains("_masked", F.col("line_no")), F.lit(False))
    return lines.join(masked, "record_key", "left").withColumn("kind", F.when(head, "head").otherwise(F.col("kind"))).drop("_masked")


def reflow(lines: DataFrame) -> DataFrame:
    """record_key, text: heads and numbers dropped, paragraphs of continuous lines.

    A paragraph starts after a blank line or at an indented one, but not within a word. A blank line
    beside a dropped head is part of the furniture where the text goes on in the middle of a sentence.
    """
    w = Window.partitionBy("record_key").orderBy("line_no")
    marked = lines.withColumn("_gap", F.max(F.when(F.col("kind") == "text", None).otherwise(F.col("line_no"))).over(w)).withColumn("_furniture", F.max(F.when(F.col("kind").isin("head", "number"), F.col("line_no"))).over(w))
    text = marked.where("kind = 'text'")
    text = text.withColumn("_prev", F.lag("line").over(w)).withColumn("_prev_no", F.lag("line_no").over(w))
    inside = F.col("_furniture").isNotNull() & (F.col("_furniture") > F.col("_prev_no")) & ~F.coalesce(F.col("_prev").rlike(r"[.!?][\"”’']?$"), F.lit(True))
    starts = F.col("_prev").isNull() | (~F.col("joins") & ~inside & (F.col("indent") | (F.coalesce(F.col("_gap"), F.lit(0)) > F.col("_prev_no"))))
    text = text.withColumn("_para", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    paras = text.groupBy("record_key", "_para").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("line").alias("p")))).alias("_lines"))
    joined = paras.select("record_key", "_para", F.trim(F.array_join(F.filter(F.transform("_lines", lambda x: x["p"]), lambda p: p != ""), " ")).alias("p"))
    return joined.groupBy("record_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_para", "p"))), lambda x: x["p"]), "\n\n").alias("text"))
