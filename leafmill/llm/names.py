"""Problem 4: variant spellings of names typed by people, linked to an authority list by trie join.

The names of the authority are sharded into tries of bounded size. Each distinct spelling walks a trie
with a Levenshtein automaton (a swap of neighbours is one step) that enumerates the entries whose key
lies within the allowed distance: the surname for persons, the whole normal form for titles. What is
left of a person's name is then checked in every order of its parts: given names, short forms,
initials, middle names.

Only distinct spellings are compared, so a spelling that a third of all records share is walked once.
Null and empty fields name nobody. A field may name two persons.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.confusables import consistent_form
from leafmill.session import cut

#: Names in one trie; an authority with more of them is walked shard by shard.
SHARD = 20_000

# --- fixed values: short forms of given names ---
SHORT_FORMS = """
abigail abby gail, alexander alec alex sandy xander al, anthony tony, benjamin ben benny benjie, charles charlie chuck chas charley, dorothy dot dottie dolly dora, edward ned ed eddie ted teddy, eleanor nell ellie nora nelly elly, elizabeth betty liz beth eliza lizzie bess libby betsy,
francis frank fran, frederick fred freddy freddie, gertrude trudy gert gertie, harold hal harry, henry hal harry hank, james jim jimmy jamie, joseph joe joey jos, katherine kate kathy kitty kay katie, lawrence larry laurie, margaret peg meg maggie peggy marge madge,
michael mike mick mickey, nathaniel nat nate, patricia pat patty patsy trish tricia, richard dick rick rich richie, robert bob rob bobby bert robbie, samuel sam sammy, susannah sue susan susie suzy, theodore ted theo teddy, thomas tom tommy thos, walter walt wally wat, william bill will billy wm willie,
george geo georgie, john jack johnny jon, david dave davy, daniel dan danny, andrew andy drew, peter pete, stephen steve, philip phil, ronald ron, donald don, raymond ray, arthur art artie, albert al bert, leonard len leo, matthew matt, christopher chris kit, catherine kate cathy kitty, helen nell nellie, mary molly polly may, martha patty mattie, rebecca becky, florence flo flossie, virginia ginny, deborah deb debbie, jessica jess, victoria vicky, caroline carrie, josephine jo josie
"""
# --- fixed values: words that stand around a name or a title ---
TITLES = "mr mrs miss ms dr prof capt maj lt col gen sgt rev sir lady professor doctor captain major lieutenant colonel general sergeant reverend hon esq jr sr phd md"
PLACEHOLDERS = "anonymous unknown anon unsigned various none n/a na ? staff editor editors"
PART = r"[\s,;:(\[–—-]*\b(?:part|pt|chapter|ch|installment|instalment|episode|no)\b\.?\s*(?:[0-9]+|[ivx]+|one|two|three|four|five|six|seven|eight|nine|ten)\b\s*(?:of\s+\w+)?[)\].\s]*$|[\s,;:(\[–—-]*\b(?:conclusion|concluded|continued|cont'?d|the end|to be continued|a serial)\b[)\].\s]*$"

_SHORT: dict[str, set[str]] = {}
for _line in SHORT_FORMS.replace("\n", " ").split(","):
    _full, *_rest = _line.split()
    for _w in _rest:
        _SHORT.setdefault(_w, set()).add(_full)
_TITLES, _NOBODY = frozenset(TITLES.split()), frozenset(PLACEHOLDERS.split())
_PART = re.compile(PART)
_AND = re.compile(r"\s+(?:and|with|&|und|et|y)\s+|\s*[&;/]\s*")
_NAME_PART = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")


def plain(text: str) -> str:
    """Lower case, without accents, with ordinary characters only."""
    text = unicodedata.normalize("NFD", consistent_form(text).lower())
    return "".join(c for c in text if not unicodedata.combining(c)).replace("’", "'").replace("‘", "'")


def distance(a: str, b: str, most: int) -> int:
    """Edits between a and b, a swap of neighbours being one; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before2, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


class Trie:
    """Keys with their entries; ``near`` is the automaton's walk."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, entry: object) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(entry)

    def near(self, word: str, most: int) -> list[tuple[int, object]]:
        """Distance and entry of all keys within ``most`` edits: the automaton's state is one row per node."""
        found: list[tuple[int, object]] = []
        first = list(range(len(word) + 1))
        stack: list[tuple[dict, str, list[int], list[int] | None]] = [(self.root, "", first, None)]
        while stack:
            node, came, row, before = stack.pop()
            if "" in node and row[-1] <= most:
                found += [(row[-1], e) for e in node[""]]
            for c, n in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for j, x in enumerate(word, 1):
                    d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != c))
                    if before is not None and j > 1 and x == came and word[j - 2] == c:
                        d = min(d, before[j - 2] + 1)
                    new.append(d)
                if min(new) <= most:
                    stack.append((n, c, new, row))
        return found


def title_form(text: str) -> str:
    """A title without its article, part and punctuation."""
    t = plain(text).strip()
    for _ in range(2):
        t = _PART.sub("", t).strip()
    t = re.sub(r"[,\s]+(?:the|an|a)\s*$", "", t)
    t = re.sub(r"\bo'(?=\s)", "of", t.replace("&", " and "))
    words = ["doctor" if w == "dr" else w for w in re.findall(r"[^\W_]+", t.replace("'", ""))]
    return " ".join(words[1:] if words[:1] in (["the"], ["a"], ["an"]) else words)


def _given(seen: str, full: str, most: int = 1) -> float:
    """Edits by which ``seen`` may stand for a given name, 9 if it can't: initials and short forms cost little."""
    if seen == full:
        return 0
    if len(seen) == 1:
        return 0.2 if full[:1] == seen else 9
    if full in _SHORT.get(seen, ()):
        return 0.1
    if len(full) == 1:
        return 0.2 if seen[:1] == full else 9
    d = distance(seen, full, most)
    if d <= most and len(full) >= 4:
        return d
    return min((1.1 for s, names in _SHORT.items() if full in names and len(s) >= 4 and distance(seen, s, 1) <= 1), default=9)


class Persons:
    """An authority of persons, by surname."""

    def __init__(self, names: list[tuple[int, str]]) -> None:
        self.trie = Trie()
        self.names = dict(names)
        for entity, name in names:
            parts = [p for p in _NAME_PART.findall(plain(name)) if p not in _TITLES]
            if parts:
                self.trie.add(parts[-1], (entity, parts[:-1], parts[-1]))

    @staticmethod
    def _rest(seen: list[str], given: list[str]) -> float:
        """Edits by which the parts beside the surname stand for the given names in their order, 9 if they can't."""
        if not given or not seen:
            return 0 if not given and not seen else 9
        if len(seen) == 1 and len(given) > 1 and 2 <= len(seen[0]) <= 3 and seen[0] == "".join(g[0] for g in given)[: len(seen[0])]:
            return 0.4
        first = _given(seen[0], given[0])
        if first >= 9:
            return 9
        if len(seen) > len(given):
            extra = 9 if len(given) > 1 or len(seen) - len(given) > 1 else 0.6
            return first + sum(_given(s, g) for s, g in zip(seen[1:], given[1:])) + extra
        row = [0.1 * (k > 0) for k in range(len(given))]  # given names left out cost little, however many
        for n, s in enumerate(seen[1:], 1):
            new = [9.0] * len(given)
            for k in range(n, len(given)):
                new[k] = min(row[k - 1] + _given(s, given[k]), new[k - 1] + 0.1 * (new[k - 1] < 9))
            row = new
        return first + min(row[-1], 9)

    @classmethod
    def _shuffled(cls, seen: list[str], given: list[str]) -> float:
        """The same in any order: the least sum over all ways to match every part, 9 if some part is left."""
        if len(seen) != len(given) or not seen:
            return 9
        best = {0: 0.0}  # given names used so far, as bits
        for s in seen:
            after: dict[int, float] = {}
            for used, cost in best.items():
                for k, g in enumerate(given):
                    if not used >> k & 1:
                        total = cost + _given(s, g)
                        if total < min(2.3, after.get(used | 1 << k, 9)):
                            after[used | 1 << k] = total
            best = after
        return min(best.values(), default=9)

    def find(self, text: str) -> list[tuple[int, float]]:
        """Entries that one person's name may mean, with their cost.

        A comma puts the surname's parts last. Every part is tried as the surname: the last or the first
        with the others in any order, one from the middle only where all parts find their counterpart.
        """
        t = re.sub(r"^\s*(?:written |story |told )?by\b[\s:.]*", "", plain(text)).strip(" .,;:()[]")
        head, comma, tail = t.partition(",")
        keep = lambda ps: [p for p in ps if p not in _TITLES or len(p) == 1]
        first, last = keep(_NAME_PART.findall(head)), keep(_NAME_PART.findall(tail))
        turned = bool(comma and last)
        parts = last + first if turned else first
        best: dict[int, float] = {}
        for at in reversed(range(len(parts))):
            surname, given = parts[at], parts[:at] + parts[at + 1 :]
            ends = at == len(parts) - 1 or (at == 0 and not turned)
            if len(surname) < 2:
                continue
            for d, (entity, names, _) in self.trie.near(surname, 1 if len(surname) >= 4 else 0):
                rest = self._rest(given, names) if ends else 9
                if rest >= 0.5 and len(given) > 1:
                    rest = min(rest, self._shuffled(given, names) + (0.5 if ends else 1.0))
                if d + rest < min(2.3, best.get(entity, 9)):
                    best[entity] = d + rest
        least = min(best.values(), default=0)
        return [(e, c) for e, c in best.items() if c <= least]

    def meant(self, text: str) -> list[tuple[int, float, int]]:
        """entity, cost, which of the field's names it is."""
        if plain(text).strip(" .()[]") in _NOBODY:
            return []
        several = [p for p in _AND.split(consistent_form(text)) if p and p.strip()]
        several = several if len(several) > 1 else re.split(r"(?i)\s+(?:and|with|&)\s+", consistent_form(text))
        return [(e, c, k) for k, p in enumerate(several) for e, c in self.find(p)]


class Works:
    """An authority of titles, by normal form."""

    def __init__(self, names: list[tuple[int, str]]) -> None:
        self.trie = Trie()
        for entity, name in names:
            if title_form(name):
                self.trie.add(title_form(name), entity)

    def meant(self, text: str) -> list[tuple[int, float, int]]:
        form = title_form(text)
        if len(form) < 3:
            return []
        near = self.trie.near(form, 0 if len(form) < 8 else 1 if len(form) < 14 else 2)
        least = min((d for d, _ in near), default=0)
        return [(e, float(d), 0) for d, e in near if d == least]


LINKS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("spelling", T.StringType()), T.StructField("entity_id", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("name_no", T.IntegerType())])


def _walk(shard: list[tuple[int, str, str]]):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = {"author": Persons([(e, n) for e, k, n in shard if k == "author"]), "title": Works([(e, n) for e, k, n in shard if k == "title"])}
        for b in batches:
            rows = [(k, s, *m) for k, s in zip(b["kind"], b["spelling"]) if k in tries for m in tries[k].meant(s)]
            yield pd.DataFrame(rows, columns=LINKS.names).astype({"entity_id": "int64", "cost": "float64", "name_no": "int32"})

    return walk


def link(spellings: DataFrame, authority: DataFrame, shard: int = SHARD) -> DataFrame:
    """kind, spelling, entity_id, cost, name_no for distinct spellings (kind, spelling).

    The authority is read in shards of a bounded number of names; a shard is what is sent to the
    workers, so nothing sent grows with the authority. Of each name in a field the nearest entries of
    all shards remain, so the shards' size does not change the result.
    """
    rows = authority.where("name is not null").select("entity_id", "kind", "name").distinct()
    total = rows.count()
    n = max(1, -(-total // shard))
    out = None
    for k in range(n):
        names = [(r.entity_id, r.kind, r.name) for r in rows.where(F.pmod(F.xxhash64("entity_id"), F.lit(n)) == k).collect()]
        part = spellings.mapInPandas(_walk(names), LINKS)
        out = part if out is None else out.unionByName(part)
    if n > 1:
        out = cut(out)
        least = out.groupBy("kind", "spelling", "name_no").agg(F.min("cost").alias("_least"))
        out = out.join(least, ["kind", "spelling", "name_no"]).where("cost <= _least").drop("_least")
    return out.select("kind", "spelling", "entity_id", "cost", "name_no")


def fields(df: DataFrame, source: str, key: str) -> DataFrame:
    """source_table, record_key, kind, spelling of a table's author and title."""
    pair = lambda c: F.struct(F.lit(c).alias("kind"), F.col(c).alias("spelling"))
    rows = df.select(F.lit(source).alias("source_table"), F.col(key).cast("string").alias("record_key"), F.explode(F.array(pair("author"), pair("title"))).alias("_f"))
    return rows.select("source_table", "record_key", "_f.kind", "_f.spelling").where("spelling is not null and trim(spelling) <> ''")


def links_of_records(records: DataFrame, authority: DataFrame) -> DataFrame:
    """source_table, record_key, field, entity_id, exact, name_no: every entry a record's field means."""
    spellings = records.select("kind", "spelling").distinct()
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = link(spellings.repartition(tasks, F.xxhash64("spelling", "kind")), authority)  # few bytes, much work: another key than that of distinct(), or the engine drops this and merges the tasks
    names = authority.select("entity_id", "name")
    named = links.join(names, "entity_id").select("kind", "spelling", "entity_id", "name_no", (F.col("spelling") == F.col("name")).alias("exact")).distinct()
    return records.join(named, ["kind", "spelling"]).select("source_table", "record_key", F.col("kind").alias("field"), "entity_id", "exact", "name_no").distinct()
