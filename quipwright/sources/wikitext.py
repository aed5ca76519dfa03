"""Sayings in wikitext: citation templates, lists, raw HTML blocks and sentences that stand as templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf

from quipwright.sources.readers import strip_markup

# Templates that hold a saying, that wrap visible text, and that hold neither; arguments that name the saying.
CITATIONS = {"citation", "citazione", "цитат", "цитата", "quote"}
WRAPPERS = {"ruby", "nihongo", "lang", "nowrap", "small", "smallcaps", "sc"}
OTHERS = {"tema", "theme", "wikipedia", "commons", "indice", "index", "protetta", "protected", "sssk", "spiegazione", "explanation"}
SAYING_ARGUMENTS = ("citation", "texte", "citazione", "цитат", "1")
# Lengths of a saying; scripts in which a short one is whole; how pages and files begin.
LEAST, LEAST_DENSE, MOST, WORDS = 15, 3, 300, 4
DENSE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")
PREFIXES = ("catégorie:", "categoria:", "category:", "file:", "fichier:", "image:")
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_NAMED = re.compile(r"\s*([\w àâäéèêëîïôöùûüç'-]{1,30}?)\s*=(.*)", re.S)


def arguments(content: str) -> list[str]:
    """The parts of a template between the bars that stand in no inner template or link."""
    parts, begin, open_ = [], 0, []
    for m in _MARK.finditer(content):
        mark = m.group()
        if mark in ("{{", "[["):
            open_.append(mark)
        elif mark == "|":
            if not open_:
                parts.append(content[begin : m.start()])
                begin = m.end()
        elif open_ and (open_[-1], mark) in (("{{", "}}"), ("[[", "]]")):
            open_.pop()
    return [*parts, content[begin:]]


def templates(text: str) -> Iterator[tuple[str, str]]:
    """(name, content) of the outermost templates; what is never closed ends the search."""
    begin, depth = 0, 0
    for m in re.finditer(r"\{\{|\}\}", text):
        if m.group() == "{{":
            begin, depth = (m.end() if not depth else begin), depth + 1
        elif depth:
            depth -= 1
            if not depth:
                content = text[begin : m.start()]
                yield content.split("|", 1)[0].strip().casefold(), content


def _saying(content: str) -> str:
    """What a template shows: of a citation the argument that names it, of a wrapper its first; nothing of any other."""
    name, *given = arguments(content)
    name = name.strip().casefold()
    named, plain = {}, []
    for part in given:
        m = _NAMED.fullmatch(part)
        if m:
            named[m.group(1).strip().casefold()] = m.group(2)
        else:
            plain.append(part)
    wanted = SAYING_ARGUMENTS if name in CITATIONS else ("1",) if name in WRAPPERS else ()
    shown = next((named[k] for k in wanted if named.get(k)), plain[0] if plain and wanted else "")
    return shown


def expanded(text: str) -> str:
    """Text with its templates put in place of themselves by what they show, from the innermost outwards."""
    inner = re.compile(r"\{\{([^{}]*)\}\}")
    while True:
        shorter = inner.sub(lambda m: _saying(m.group(1)), text)
        if shorter == text:
            return text
        text = shorter


def clean(text: str) -> str:
    """Plain text: templates by what they show, breaks as blanks, marks at the ends and one pair of quotes around it dropped."""
    text = re.sub(r"<ref[^>]*/>|<ref[^>]*>.*?(?:</ref>|$)|<!--.*?-->", "", text, flags=re.S)
    text = strip_markup(expanded(re.sub(r"<\s*(?:br|p)\b[^>]*>", " ", text, flags=re.I))).strip(" \t:;–—-")
    return text[1:-1].strip() if len(text) >= 2 and text[0] + text[-1] in ("«»", '""') else text


def is_saying(text: str) -> bool:
    """A text of fitting length for its script, with a letter, and no link, markup or page name."""
    low = text.casefold()
    return (
        (LEAST_DENSE if DENSE.search(text) else LEAST) <= len(text) <= MOST and "http" not in low and "www." not in low
        and text[0] not in "#*=|{<[" and not low.startswith(PREFIXES) and any(c.isalpha() for c in text)
    )


def sayings(wikitext: str | None) -> Iterator[tuple[str, str]]:
    """(kind, text) in this order: citations, list entries, HTML blocks, sentences as templates."""
    text = wikitext or ""
    found = [("citation", _saying(c)) for n, c in templates(text) if n in CITATIONS]
    found += [("list", m.group(1)) for m in re.finditer(r"^[*#](?![*#])(.*)$", text, re.M)]
    if re.search(r"<(?:p|br)\b", text, re.I):
        found += [("block", part) for part in re.split(r"</?p\b[^>]*>|<br\b[^>]*>", text, flags=re.I)]
    for kind, raw in found:
        if is_saying(shown := clean(raw)):
            yield kind, shown
    for name, content in templates(text):
        if "|" not in content and not name.startswith(":") and name not in CITATIONS | WRAPPERS | OTHERS:
            shown = clean(content)
            if is_saying(shown) and (len(shown.split()) >= WORDS or DENSE.search(shown)):
                yield "sentence", shown


@udtf(returnType="position int, kind string, saying string")
class Sayings:
    """Table function: the different sayings of a page, told apart by letters and digits alone."""

    def eval(self, wikitext: str):
        seen = set()
        for kind, shown in sayings(wikitext):
            key = "".join(c for c in shown.casefold() if c.isalnum())
            if key not in seen:
                seen.add(key)
                yield len(seen) - 1, kind, shown
