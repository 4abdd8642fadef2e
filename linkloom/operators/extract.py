"""Structured extraction with CSS schemas (L6) and display of extracted
content (L7).

A page is a flat list of tag events; a selector is compiled to an automaton
whose states are sets of bits (one for each step of each alternative), and
runs over those events with the stack of open elements. There is no tree and
no recursion, so depth costs memory only. Spark partitions the pages and
carries the records (``mapInPandas``); only the work on one page is in Python.

Selectors: lists (``a, b``), descendant, ``>``, ``+``, ``~``, and compounds
of tag, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]`` (also ``~= |= ^= $=
*=``), ``:first-child``, ``:last-child``, ``:only-child``, ``:nth-child``,
``:first-of-type``, ``:nth-of-type``. Anything else raises ``SelectorError``
before a page is read. Steps match inside the scope (the record's element for
fields); a leading ``>`` means a child of the scope. Text is
whitespace-collapsed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json import json_value
from ..session import ship_package

VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class SelectorError(ValueError):
    """A selector that this library doesn't know."""


# ── selectors ───────────────────────────────────────────────────────────────

_NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w-]*"
_PART = re.compile(rf"""(?P<tag>\*|{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<word>[\w./:%-]+))\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?:\(\s*(?P<arg>[^()]*?)\s*\))?""", re.X)
_JOIN = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"(?:(?P<step>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<plus>\d+))?|(?P<only>[+-]?\d+))$")


@dataclass(frozen=True)
class Nth:
    """Position a*n + b (n = 0, 1 ...) among the siblings, of the same tag or of all; from the end with ``last``."""

    a: int
    b: int
    of_type: bool = False
    last: bool = False

    def holds(self, page: Page, i: int) -> bool:
        at = page.nth_of_type[i] if self.of_type else page.nth[i]
        if self.last:
            at = page.siblings(i) + 1 - at
        return at == self.b if self.a == 0 else (at - self.b) % self.a == 0 and (at - self.b) // self.a >= 0


@dataclass(frozen=True)
class Compound:
    tag: str | None
    classes: tuple[str, ...]
    ident: str | None
    attrs: tuple[tuple[str, str | None, str], ...]
    places: tuple[Nth, ...]

    def holds(self, page: Page, i: int) -> bool:
        if self.tag is not None and page.tags[i] != self.tag:
            return False
        own = page.attrs[i]
        if self.ident is not None and own.get("id") != self.ident:
            return False
        if self.classes:
            held = (own.get("class") or "").split()
            if any(c not in held for c in self.classes):
                return False
        return all(_attr_holds(own, *x) for x in self.attrs) and all(x.holds(page, i) for x in self.places)


def _attr_holds(own: dict[str, str | None], name: str, op: str | None, value: str) -> bool:
    if name not in own:
        return False
    has = own[name] or ""
    if op is None or op == "=":
        return op is None or has == value
    if op == "~=":
        return value in has.split()
    if op == "|=":
        return has == value or has.startswith(value + "-")
    if not value:
        return False
    return has.startswith(value) if op == "^=" else has.endswith(value) if op == "$=" else value in has


def _nth(selector: str, name: str, arg: str | None) -> tuple[Nth, ...]:
    plain = {"first-child": (Nth(0, 1),), "last-child": (Nth(0, 1, last=True),), "only-child": (Nth(0, 1), Nth(0, 1, last=True)), "first-of-type": (Nth(0, 1, True),)}
    if name in plain and arg is None:
        return plain[name]
    found = _NTH.match({"odd": "2n+1", "even": "2n"}.get(arg.lower(), arg.lower())) if name in ("nth-child", "nth-of-type") and arg else None
    if found is None:
        raise SelectorError(f"unknown selector {selector!r}: :{name}" + (f"({arg})" if arg is not None else ""))
    if found["only"]:
        return (Nth(0, int(found["only"]), name == "nth-of-type"),)
    step = {"": 1, "+": 1, "-": -1}.get(found["step"]) or int(found["step"])
    return (Nth(step, int((found["sign"] or "+") + (found["plus"] or "0")), name == "nth-of-type"),)


class Automaton:
    """A selector list as bit sets: what a step needs of the element, and where the step before it must have matched."""

    def __init__(self, selector: str):
        self.steps: list[Compound] = []
        self.first = self.child_of_scope = self.last = 0  # bits of steps that begin an alternative; that need the scope as parent; that end one
        self.within = self.child = self.next = self.after = 0  # bits of steps by the combinator before them
        at, text = 0, selector.strip()
        if not text:
            raise SelectorError("an empty selector")
        while at < len(text):
            at = self._alternative(text, at)

    def _alternative(self, text: str, at: int) -> int:
        combinator, begun = "scope", False
        lead = re.compile(r"\s*>\s*").match(text, at)
        if lead:
            combinator, at = ">scope", lead.end()
        while True:
            begin, at = at, self._compound(text, at)
            if at == begin:
                raise SelectorError(f"unknown selector {text!r} at {text[at:at + 20]!r}" if at < len(text) else f"selector {text!r} ends early")
            bit = 1 << (len(self.steps) - 1)
            if not begun:
                self.first |= bit if combinator == "scope" else 0
                self.child_of_scope |= bit if combinator == ">scope" else 0
            else:
                for kind, name in ((" ", "within"), (">", "child"), ("+", "next"), ("~", "after")):
                    if combinator == kind:
                        setattr(self, name, getattr(self, name) | bit)
            begun = True
            comma = re.compile(r"\s*,\s*").match(text, at)
            if at == len(text) or comma:
                self.last |= bit
                if comma and comma.end() == len(text):
                    raise SelectorError(f"selector {text!r} ends early")
                return comma.end() if comma else at
            joint = _JOIN.match(text, at)
            if joint is None:
                raise SelectorError(f"unknown selector {text!r} at {text[at:at + 20]!r}")
            combinator, at = joint[1] or " ", joint.end()

    def _compound(self, text: str, at: int) -> int:
        begin, tag, classes, ident, attrs, places = at, None, [], None, [], []
        while part := _PART.match(text, at):
            if part["tag"]:
                if at != begin:
                    break
                tag = None if part["tag"] == "*" else part["tag"].lower()
            elif part["cls"]:
                classes.append(part["cls"])
            elif part["id"]:
                if ident not in (None, part["id"]):
                    raise SelectorError(f"unknown selector {text!r}: two ids")
                ident = part["id"]
            elif part["attr"]:
                attrs.append((part["attr"].lower(), part["op"], next((x for x in (part["dq"], part["sq"], part["word"]) if x is not None), "")))
            else:
                places += _nth(text, part["pseudo"], part["arg"])
            at = part.end()
        if at > begin:
            self.steps.append(Compound(tag, tuple(classes), ident, tuple(attrs), tuple(places)))
        return at

    def matches(self, page: Page, start: int, stop: int) -> Iterator[int]:
        """Elements among events ``start`` to ``stop`` that match, in document order."""
        # An open element: its end, bits of it and its ancestors, its own bits, those of the element before, those of all before.
        ends, above, own, before, earlier = [stop], [0], [0], [0], [0]
        for i in range(start, stop):
            while i >= ends[-1] and len(ends) > 1:
                for held in (ends, above, own, before, earlier):
                    held.pop()
            if page.tags[i] is None:
                continue
            may = (self.first | (self.child_of_scope if len(ends) == 1 else 0) | (above[-1] << 1 & self.within) | (own[-1] << 1 & self.child)
                   | (before[-1] << 1 & self.next) | (earlier[-1] << 1 & self.after))
            here, rest = 0, may
            while rest:
                bit = rest & -rest
                rest ^= bit
                if self.steps[bit.bit_length() - 1].holds(page, i):
                    here |= bit
            if here & self.last:
                yield i
            before[-1] = here
            earlier[-1] |= here
            if page.ends[i] > i + 1:
                for held, x in zip((ends, above, own, before, earlier), (page.ends[i], above[-1] | here, here, 0, 0)):
                    held.append(x)


# ── pages ───────────────────────────────────────────────────────────────────

class Page(HTMLParser):
    """A page's events in document order: an element (tag, attributes) or a run of text, and where the element ends.

    Event i's content is events i + 1 to ``ends[i]``. An end tag closes the
    nearest open element of its name, and what is open within; others are ignored.
    """

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tags: list[str | None] = []
        self.attrs: list = []  # of a text run: the text
        self.ends: list[int] = []
        self.up: list[int] = []
        self.nth: list[int] = []
        self.nth_of_type: list[int] = []
        self._open: list[int] = []
        self._kinds: list[dict[str, int]] = [{}]
        self._names: dict[str, int] = {}  # open elements of each name
        self.feed(html or "")
        self.close()
        self._close_to(0)
        self._count = [0] * (len(self.tags) + 1)
        for i, tag in enumerate(self.tags):
            if tag is not None:
                self._count[self.up[i]] += 1

    def siblings(self, i: int) -> int:
        return self._count[self.up[i]]

    def _add(self, tag: str | None, held) -> None:
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(held)
        self.ends.append(i + 1)
        self.up.append(self._open[-1] if self._open else -1)
        kinds = self._kinds[-1]
        if tag is not None:
            kinds[""] = kinds.get("", 0) + 1
            kinds[tag] = kinds.get(tag, 0) + 1
        self.nth.append(kinds.get("", 0))
        self.nth_of_type.append(kinds.get(tag, 0))

    def _close_to(self, depth: int) -> None:
        while len(self._open) > depth:
            i = self._open.pop()
            self.ends[i] = len(self.tags)
            self._kinds.pop()
            self._names[self.tags[i]] -= 1

    def handle_starttag(self, tag, attrs):
        self._add(tag, dict(attrs))
        if tag not in VOID_TAGS:
            self._open.append(len(self.tags) - 1)
            self._kinds.append({})
            self._names[tag] = self._names.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag, dict(attrs))

    def handle_endtag(self, tag):
        if self._names.get(tag):
            depth = len(self._open) - 1
            while self.tags[self._open[depth]] != tag:
                depth -= 1
            self._close_to(depth)

    def handle_data(self, data):
        self._add(None, data)

    def text(self, i: int) -> str:
        return " ".join(" ".join(self.attrs[j] for j in range(i + 1, self.ends[i]) if self.tags[j] is None).split())

    def inner_html(self, i: int) -> str:
        out: list[str] = []
        open_: list[int] = []
        for j in range(i + 1, self.ends[i]):
            while open_ and self.ends[open_[-1]] <= j:
                out.append(f"</{self.tags[open_.pop()]}>")
            if self.tags[j] is None:
                out.append(self.attrs[j])
                continue
            out.append(f"<{self.tags[j]}" + "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in self.attrs[j].items()) + ">")
            if self.tags[j] not in VOID_TAGS:
                open_.append(j)
        out += [f"</{self.tags[j]}>" for j in reversed(open_)]
        return "".join(out)


class CompiledSchema:
    """A CSS schema: baseSelector, and fields (name, selector, type text / attribute / html, attribute)."""

    def __init__(self, schema: dict):
        self.base = Automaton(schema.get("baseSelector", ""))
        self.fields = []
        for f in schema.get("fields", []):
            selector, kind = (f.get("selector") or "").strip(), f.get("type", "text")
            if kind not in ("text", "attribute", "html"):
                raise SelectorError(f"unknown field type {kind!r}")
            self.fields.append((f["name"], Automaton(selector) if selector else None, kind, f.get("attribute", "").lower()))

    def records(self, html: str | None) -> list[dict]:
        """One record for each element of the base selector; a field without a match is None."""
        page, out = Page(html), []
        for i in self.base.matches(page, 0, len(page.tags)):
            record = {}
            for name, selector, kind, attribute in self.fields:
                at = i if selector is None else next(selector.matches(page, i + 1, page.ends[i]), None)
                record[name] = (None if at is None else page.attrs[at].get(attribute) if kind == "attribute"
                                else page.inner_html(at) if kind == "html" else page.text(at))
            out.append(record)
        return out


def extract_from_html(html: str | None, schema: dict) -> list[dict]:
    """The records of one page. Null and empty html give none."""
    return CompiledSchema(schema).records(html)


def extract_records(pages: DataFrame, schema: dict) -> DataFrame:
    """L6 as rows: (page_id, rec_no, record map<string,string>)."""
    compiled = CompiledSchema(schema)  # an unknown selector is refused here
    names = [f["name"] for f in schema.get("fields", [])]

    def run(batches):
        import pandas as pd
        for pdf in batches:
            ids, nos, recs = [], [], []
            for pid, html in zip(pdf["page_id"], pdf["html"]):
                for i, r in enumerate(compiled.records(html)):
                    ids.append(pid)
                    nos.append(i)
                    recs.append({k: r.get(k) for k in names})
            if ids:  # an empty frame cannot be typed as map<string,string>
                yield pd.DataFrame({"page_id": ids, "rec_no": nos, "record": recs})

    ship_package(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, rec_no long, record map<string,string>")


def extracted_json(pages: DataFrame, schema: dict) -> DataFrame:
    """L6 as the results' ``extracted_content``: one JSON list per page."""
    compiled = CompiledSchema(schema)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = [json.dumps(compiled.records(h), ensure_ascii=False) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "extracted_content": out})

    ship_package(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, extracted_content string")


def parse_extracted(df: DataFrame, col: str = "extracted_content", cap: int = 2000) -> DataFrame:
    """Parsed VARIANT when the text is JSON, else the raw text cut to 2000
    characters for display; ``k`` = top-level field k when present."""
    x = F.col(col)
    v = json_value(x)
    is_json = v.isNotNull()
    return df.select(
        "*", F.when(is_json, v).alias("parsed"), is_json.alias("is_json"),
        F.when(is_json, F.lit(None).cast("string")).otherwise(F.substring(x, 1, cap)).alias("shown"),
        F.when(is_json, F.try_variant_get(v, "$.k", "bigint")).alias("k"),
        F.when(is_json, F.to_json(v)).otherwise(F.substring(x, 1, cap)).alias("display"))
