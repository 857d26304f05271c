"""Fields of bug and log pages, and rows of attachments, by an HTML parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the fields, and the page texts that refuse a bug.
FIELD_IDS = {
    "status": "field-value-status-view", "assignedTo": "field-value-assigned_to", "reporter": "field-value-reporter", "product": "product-name", "component": "component-name",
    "version": "field-value-version", "target": "field-value-target_milestone", "keywords": "field-value-keywords",
}
DATE_IDS = {"reportDateText": "field-value-creation_ts", "modDateText": "field-value-delta_ts"}
REFUSALS = {"you are not authorized to access bug": -1, "you must enter a valid bug number!": -2}
_VOID = {"br", "img", "hr", "input", "meta", "link"}


class _Node:
    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def walk(self) -> Iterator:
        for k in self.kids:
            if not isinstance(k, str):
                yield k
                yield from k.walk()

    def under(self, tag: str) -> list:
        return [k for k in self.kids if not isinstance(k, str) and k.tag == tag]


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, dict(attrs), self.at)
        self.at.kids.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def _flat(s: str | None) -> str:
    return (s or "").replace("\n", "").strip()


def bug_fields(html: str | None) -> dict:
    """``state`` (1 read, -1 not authorised, -2 no such bug, 0 no page) and the fields; missing ones are ''."""
    out = {"state": 0, **dict.fromkeys([*FIELD_IDS, *DATE_IDS], "")}
    if not html:
        return out
    out["state"] = next((v for k, v in REFUSALS.items() if k in html), 1)
    if out["state"] < 0:
        return out
    ids = {n.attrs["id"]: n for n in _Tree(html).root.walk() if n.attrs.get("id")}
    for f, i in FIELD_IDS.items():
        out[f] = _flat(ids[i].text()) if i in ids else ""
    for f, i in DATE_IDS.items():
        title = next((s.attrs["title"] for s in ids[i].under("span") if s.attrs.get("title")), "") if i in ids else ""
        out[f] = _flat(title.upper())
    return out


def patches(html: str | None) -> list[dict]:
    """One row an attachment with a readable number."""
    if not html or any(k in html for k in REFUSALS):
        return []
    box = next((n for n in _Tree(html).root.walk() if n.attrs.get("id") == "attachments"), None)
    rows = []
    for tr in [n for n in box.walk() if n.tag == "tr"] if box else []:
        tds = tr.under("td")
        divs = tds[0].under("div") if tds else []
        link = divs[0].under("a") if divs else []
        number = link[0].attrs.get("href", "").rsplit("=", 1)[-1].strip() if link else ""
        if not number.isdigit():
            continue
        when = divs[1].under("a") if len(divs) > 1 else []
        title = next((s.attrs.get("title", "") for s in (when[0].under("span") if when else [])), "")
        who = [a for s in (divs[1].under("span") if len(divs) > 1 else []) for d in s.under("div") for a in d.under("a")]
        flags = tds[1].under("div") if len(tds) > 1 else []
        kinds = [a.text().strip() for d in flags for a in d.under("a")]
        users = [s.text().strip() for d in flags for i in d.under("div")[:1] for s in i.under("span")]
        rows.append({
            "patchId": int(number), "patchDateText": title.upper().strip(), "patchRowType": _flat(tr.attrs.get("class")), "author": _flat(who[0].text()) if who else "", "commentLink": when[0].attrs.get("href", "") if when else "", "patchText": _flat(link[0].text()),
            "patchSize": _flat(divs[2].text()) if len(divs) > 2 else "", "patchFlagUsers": ",".join(users), "patchFlagTypes": ",".join(kinds), "patchFlagStatus": ",".join(k[-1] for k in kinds if k),
        })
    return rows


def extract_bugs(pages: DataFrame, key: str = "bug", html: str = "html") -> DataFrame:
    """(key, state, fields): one row a page."""
    names = list(bug_fields(None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([bug_fields(h) for h in b["__h"]], columns=names)
            out.insert(0, key, b[key].to_numpy())
            yield out

    return pages.selectExpr(f"`{key}`", f"`{html}` AS __h").mapInPandas(run, f"{key} long, state int, " + ", ".join(f"{n} string" for n in names[1:]))


def extract_patches(pages: DataFrame, key: str = "bug", html: str = "html") -> DataFrame:
    """(key, patch fields): a row an attachment; pages without any give none."""
    names = ["patchId", "patchDateText", "patchRowType", "author", "commentLink", "patchText", "patchSize", "patchFlagUsers", "patchFlagTypes", "patchFlagStatus"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{key: k, **r} for k, h in zip(b[key], b["__h"]) for r in patches(h)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return pages.selectExpr(f"`{key}`", f"`{html}` AS __h").mapInPandas(run, f"{key} long, patchId long, " + ", ".join(f"{n} string" for n in names[1:]))


def push_date_text(html):
    """Column: the text of the cell after the one that says push date; null if there is none."""
    found = F.regexp_extract(html, r"(?s)<td>push date</td>.*?<td>(.*?)</td>", 1)
    return F.when(found != "", found)


def renamed(diff):
    """Column: array of (copy_from, copy_to) in a git-style diff text."""
    return F.transform(F.regexp_extract_all(diff, F.lit(r"(?:rename|copy) from [^\n]+\n(?:rename|copy) to [^\n]+"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"from ([^\n]+)", 1).alias("copy_from"), F.regexp_extract(x, r" to ([^\n]+)", 1).alias("copy_to")))
