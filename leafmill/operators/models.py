"""Pages sent through a model that corrects or reads them, with a guard and no page lost.

The model is any function from a list of texts to a list of replies; it runs on the executors, a batch of
rows at a time. ``identity`` stands in for it where there is none.
"""

from __future__ import annotations

import difflib
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.ranks import running_totals_by

#: A reply less similar to its page than this is not taken.
GUARD = 0.85
_THINK = re.compile(r"<think>.*?</think>", re.S)


def identity(texts: list[str]) -> list[str]:
    return list(texts)


def corrected(pages: DataFrame, keys: list[str], predict: Callable[[list[str]], list[str]] = identity, guard: float = GUARD, tries: int = 3, wait: float = 15.0, most_failures: int = 20) -> DataFrame:
    """keys, text, similarity, accepted, error: each page's reply, or its own text where the reply is not taken.

    A blank page is asked nothing: its text is '', the rest null. A failed or empty reply leaves the page
    as it was, with accepted false and the error. A batch that fails is tried again after ``wait``
    seconds, twice as many the next time and so on, then page by page, so one bad page fails alone; after
    ``most_failures`` pages in a row the task gives up, as the model is down (the engine tries the task again).
    """

    def ask(texts: list[str]) -> list[tuple[str | None, str | None]]:
        error = "empty reply"
        for attempt in range(tries):
            try:
                replies = [_THINK.sub("", r or "").strip() for r in predict(texts)]
                if len(replies) != len(texts):
                    raise ValueError(f"{len(replies)} replies to {len(texts)} pages")
                return [(r, None) if r else (None, "empty reply") for r in replies]
            except Exception as e:
                error = str(e)[:200]
                time.sleep(wait * (attempt + 1) if attempt + 1 < tries else 0)
        if len(texts) == 1:
            return [(None, error)]
        out: list[tuple[str | None, str | None]] = []
        for t in texts:
            out += ask([t])
            if len(out) >= most_failures and not any(reply for reply, _ in out[-most_failures:]):
                raise RuntimeError(f"{most_failures} failures in a row, the last: {out[-1][1]}")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            todo = [k for k, t in enumerate(texts) if t.strip()]
            replies = dict(zip(todo, ask([texts[k] for k in todo]))) if todo else {}
            rows = []
            for k, text in enumerate(texts):
                if k not in replies:
                    rows.append(("", None, None, None))
                    continue
                reply, error = replies[k]
                like = None if reply is None else 1.0 if reply == text else round(difflib.SequenceMatcher(None, text, reply).ratio(), 3)
                taken = like is not None and like >= guard
                rows.append((reply if taken else text, like, taken, error))
            out = pd.DataFrame(rows, columns=["text", "similarity", "accepted", "error"]).astype({"similarity": "float64", "accepted": "boolean"})
            yield pd.concat([b[keys].reset_index(drop=True), out], axis=1)

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string, similarity double, accepted boolean, error string"
    return pages.select(*keys, "text").mapInPandas(run, schema)


# ---- units and works as a model sees them ----
#: Characters of a region that the model is shown, and fragments that it is shown at once.
SNIPPET, CHUNK = 180, 240
_BLOCK = re.compile(r"\{.*\}", re.S)
UNITS = "issue string, page int, unit_no int, kind string, segments array<int>, title string, author string, continues boolean"
WORKS = "issue string, chunk bigint, work int, art_type string, title string, author string, fragments array<struct<page int, unit_no int>>, by_rule boolean"


def _parsed(predict: Callable[[list[str]], list[str]], prompt: str) -> dict | None:
    """The first JSON object of the reply; asked once more where there is none, then null."""
    for _ in range(2):
        try:
            block = _BLOCK.search(_THINK.sub("", predict([prompt])[0] or ""))
            found = json.loads(block[0]) if block else None
            if isinstance(found, dict):
                return found
        except Exception:  # noqa: S112
            continue
    return None


def _text_or_none(x: object) -> str | None:
    return x if isinstance(x, str) else None


def units_by_model(regions: DataFrame, predict: Callable[[list[str]], list[str]], instructions: str = "") -> DataFrame:
    """Rows of UNITS: what the model makes of each page's regions (issue, page, region_order, label, text).

    The model is shown a line a region, number, label and the first SNIPPET characters, and answers with
    ``{"units": [{"segments": [...], "kind", "title", "author", "continues_previous"}]}``. Numbers that the
    page does not have are dropped, and units without any. A page without a readable reply is one
    unsorted unit of all its regions, so none is lost.
    """
    text = F.substring(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), "\n", " "), 1, SNIPPET)
    rows = regions.where("issue is not null and page is not null").groupBy("issue", "page").agg(F.array_sort(F.collect_set(F.struct("region_order", F.coalesce("label", F.lit("")).alias("label"), text.alias("snippet")))).alias("regions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for issue, page, own in zip(b["issue"], b["page"], b["regions"]):
                prompt = instructions + "\n".join(f'[{k}] label={r["label"]} text="{r["snippet"]}"' for k, r in enumerate(own))
                reply = _parsed(predict, prompt)
                whole = {"segments": list(range(len(own))), "kind": "unsorted"}
                for n, u in enumerate((reply or {}).get("units", []) if reply is not None else [whole]):
                    segments = [k for k in u.get("segments", []) if isinstance(k, int) and not isinstance(k, bool) and 0 <= k < len(own)] if isinstance(u, dict) else []
                    if segments:
                        out.append((issue, page, n, u.get("kind") or "unsorted", [own[k]["region_order"] for k in segments], _text_or_none(u.get("title")), _text_or_none(u.get("author")), bool(u.get("continues_previous"))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in UNITS.split(", ")]).astype({"page": "int32", "unit_no": "int32", "continues": bool})

    return rows.mapInPandas(run, UNITS)


def stitched_by_rule(fragments: list[dict]) -> list[dict]:
    """Works of a chunk without a model: ads stand alone, a fragment that continues joins the open work, any other opens one."""
    works: list[dict] = []
    now: dict | None = None
    for f in fragments:
        here = (f["page"], f["unit_no"])
        if f["kind"] == "ad":
            works.append({"type": "ad", "title": f["title"], "author": None, "fragments": [here]})
        elif f["continues"] and now is not None:
            now["fragments"].append(here)
        else:
            now = {"type": "story", "title": f["title"], "author": f["author"], "fragments": [here]}
            works.append(now)
    return works


def works_by_model(units: DataFrame, predict: Callable[[list[str]], list[str]], instructions: str = "") -> DataFrame:
    """Rows of WORKS: fragments (UNITS with ``first_words`` and ``last_words``) joined over pages, CHUNK of an issue at a time.

    The chunks are cut by a running total over pages, so no issue is gathered; a chunk whose reply can't be
    read is stitched by rule (``by_rule``). Fragments that the reply names and the chunk lacks are dropped,
    and works without any keep their number.
    """
    shown = units.where("kind not in ('furniture', 'unsorted')")
    per_page = shown.groupBy("issue", "page").agg(F.count("*").alias("_n"))
    before = running_totals_by(per_page, ["issue"], "page", {"_before": F.col("_n")}, 1000).select("issue", "page", "_before")
    from pyspark.sql import Window

    at = F.col("_before") + F.row_number().over(Window.partitionBy("issue", "page").orderBy("unit_no")) - 1
    rows = shown.join(before, ["issue", "page"]).withColumn("chunk", F.floor(at / CHUNK))

    def stitch(batch: pd.DataFrame) -> pd.DataFrame:
        own = batch.sort_values(["page", "unit_no"]).to_dict("records")
        lines = [f"page={f['page']} frag={f['unit_no']} kind={f['kind']} title={json.dumps(f['title'])} author={json.dumps(f['author'])} continues={f['continues']} first=\"{f['first_words']}\" last=\"{f['last_words']}\"" for f in own]
        reply = _parsed(predict, instructions + "\n".join(lines))
        works = (reply or {}).get("articles")
        by_rule = not isinstance(works, list)
        known, out = {(f["page"], f["unit_no"]) for f in own}, []
        for n, w in enumerate(stitched_by_rule(own) if by_rule else works):
            held = [tuple(x) for x in w.get("fragments", []) if isinstance(x, (list, tuple)) and tuple(x) in known]
            if held:
                out.append((own[0]["issue"], own[0]["chunk"], n, _text_or_none(w.get("type")), _text_or_none(w.get("title")), _text_or_none(w.get("author")), held, by_rule))
        return pd.DataFrame(out, columns=[c.split()[0] for c in WORKS.split(", ")[:6]] + ["fragments", "by_rule"])

    return rows.select("issue", "chunk", "page", "unit_no", "kind", "title", "author", "continues", "first_words", "last_words").groupBy("issue", "chunk").applyInPandas(stitch, WORKS)
