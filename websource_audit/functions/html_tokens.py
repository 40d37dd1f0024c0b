"""A small per-document helper: the findings of one HTML text, in one pass of the standard library's tokenizer."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from . import patterns as P

_JS_LINK = re.compile(r"href=[\"']\s*javascript:", re.IGNORECASE)
_EVENTS = frozenset(P.EVENT_HANDLERS)
REMOTE = ("http:", "https:", "//")

#: (start_line, end_line, category, code_type, source_type, snippet, full_code, html_context)
Row = tuple[int, int, str, str, str, str, str, str]
#: (kind, tag or line, attribute, part): findings of a file are in this order; tags and comments count from 1, as attributes of a tag do
Place = tuple[int, int, int, int]


def opening_tag(name: str, attrs: dict[str, str]) -> str:
    """The tag as it opens, with quotes in values escaped."""
    quote = '"'
    return f"<{name} {' '.join(f'{k}={quote}{v.replace(quote, '&quot;')}{quote}' for k, v in attrs.items())}>"


class _Tokens(HTMLParser):
    """Gathers findings by kind, so that they can be put out kind by kind, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.scripts: list[tuple[Place, Row]] = []
        self.handlers: list[tuple[Place, Row]] = []
        self.styles: list[tuple[Place, Row]] = []
        self.style_attrs: list[tuple[Place, Row]] = []
        self.links: list[tuple[Place, Row]] = []
        self.block: tuple[str, int, int] | None = None
        self.tag_no = 0
        self.text: list[str] = []

    def handle_starttag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        self._opened(tag, pairs, False)

    def handle_startendtag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        self._opened(tag, pairs, True)

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = super().parse_comment(i, report)
        self.tag_no += end >= 0
        return end

    def _opened(self, tag: str, pairs: list[tuple[str, str | None]], closed: bool) -> None:
        attrs = {k: v or "" for k, v in pairs}  # of repeated attributes the last counts
        line = self.getpos()[0]
        self.tag_no += 1
        no = self.tag_no
        at: dict[str, int] = {}
        for n, (k, _) in enumerate(pairs, 1):
            at.setdefault(k, n)
        for k, v in attrs.items():
            if k in _EVENTS:
                self.handlers.append(((2, no, at[k], 0), (line, line + v.count("\n"), "JS", k, "INLINE", f'{k}="{v}"', v, opening_tag(tag, attrs))))
            if k in ("href", "src") and v.lower().strip().startswith("javascript:"):
                self.handlers.append(((2, no, at[k], 1), (line, line + v.count("\n"), "JS", "jsuri", "INLINE", v, v, opening_tag(tag, attrs))))
        if "style" in attrs:
            v = attrs["style"]
            self.style_attrs.append(((4, no, at["style"], 0), (line, line + v.count("\n"), "CSS", "ASP.NET Style" if "<%" in v else "inlinestyle", "INLINE", f'style="{v}"', v, "")))
        if tag == "script" and "src" in attrs:
            self.scripts.append(((1, no, 0, 0), self._reference(line, attrs["src"], "Script", opening_tag(tag, attrs))))
        if tag == "link" and "stylesheet" in attrs.get("rel", "").split() and "href" in attrs:
            self.links.append(((5, no, 0, 0), self._reference(line, attrs["href"], "Style", opening_tag(tag, attrs))))
        if tag in ("script", "style") and not closed and not (tag == "script" and "src" in attrs):
            self.block, self.text = (tag, line, no), []
        elif tag == "style":
            self._style(line, no, "")

    @staticmethod
    def _reference(line: int, url: str, what: str, context: str) -> Row:
        remote = url.lower().startswith(REMOTE)
        kind, where = ("External", "REMOTE") if remote else ("Internal", "LOCAL")
        return (line, line, kind, f"{kind} {what}", where, url, context, context)

    def handle_data(self, data: str) -> None:
        if self.block:
            self.text.append(data)

    def _style(self, line: int, no: int, text: str) -> None:
        code = text.strip()
        end = line + code.count("\n")
        if "@import" in text:
            self.styles.append(((3, no, 0, 0), (line, end, "External", "External Style (@import)", "REMOTE", code[:100], code, "")))
        self.styles.append(((3, no, 0, 1), (line, end, "CSS", "styleblock", "INLINE", code[:200], code, "")))

    def _ended(self) -> None:
        if not self.block:
            return
        (tag, line, no), text = self.block, "".join(self.text)
        self.block = None
        if tag == "style":
            self._style(line, no, text)
        elif text:
            code = text.strip()
            self.scripts.append(((1, no, 0, 0), (line, line + code.count("\n"), "JS", "scriptblock", "INLINE", code[:200], code, "")))

    def handle_endtag(self, tag: str) -> None:
        if self.block and tag == self.block[0]:
            self._ended()


def placed_findings(file_path: str, content: str) -> list[tuple[Place, Row]]:
    """All findings of a file with their places, one for each (start line, type, stripped code), the first one kept."""
    lines = content.splitlines()
    rows: list[tuple[Place, Row]] = [((0, k, 0, 0), (k, k, "JS", "jsuri", "INLINE", s, s, "")) for k, line in enumerate(lines, 1) if _JS_LINK.search(line) and (s := line.strip()) is not None]
    if file_path.lower().endswith(".js") and file_path.rsplit("/", 1)[-1].strip(".").lower() != "js":
        code = content.strip()
        rows.append(((1, 0, 0, 0), (1, len(lines), "JS", "standalone_js", "LOCAL", code[:200], code, "")))
    else:
        t = _Tokens()
        t.feed(content)
        t.close()
        t._ended()
        rows += [*t.scripts, *t.handlers, *t.styles, *t.style_attrs, *t.links]
    seen: set[tuple[int, str, str]] = set()
    out = []
    for place, r in rows:
        key = (r[0], r[3], r[6].strip())
        if key not in seen:
            seen.add(key)
            out.append((place, r))
    return out


def document_findings(file_path: str, content: str) -> list[Row]:
    """placed_findings without the places."""
    return [r for _, r in placed_findings(file_path, content)]
