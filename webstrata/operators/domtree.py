"""Child-index addresses of one page's elements, by the tree rules of the HTML standard.

Covers implied html/head/body, void elements, implied end tags, implied table parts and
re-opened formatting elements, three equal ones at most and none from outside a cell, caption or
object. Misnested formatting across blocks is closed, not moved.
"""

from __future__ import annotations

import re

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr "
                 "basefont bgsound frame keygen".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style "
                      "template title".split())
RAW = ("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "textarea",
       "title")
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search "
    "section summary table ul listing plaintext xmp li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKERS = frozenset("applet caption marquee object td template th".split())
SCOPE = frozenset("html table td th caption marquee object applet template button "
                  "foreignobject".split())
BLOCKS = CLOSES_P - {"p"} | frozenset(
    "body html table tbody thead tfoot tr td th caption button object select".split())
MOST_EQUAL = 3
TABLE_PARTS = {"tr": ("tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",),
               "col": ("colgroup",)}
IMPLIED = {"tr": "tbody", "td": "tr", "th": "tr", "col": "colgroup"}
ENDS = {"option": {"option"}, "optgroup": {"option", "optgroup"}, "rt": {"rt", "rp"},
        "rp": {"rt", "rp"}, "caption": {"caption", "colgroup"}, "colgroup": {"caption", "colgroup"},
        "tbody": {"caption", "colgroup", "tbody", "thead", "tfoot", "tr", "td", "th"},
        "tr": {"caption", "colgroup", "tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]

_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?P<raw_attrs>{_ATTRIBUTES})>"
    rf".*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<tag>[a-z][^\s/>]*+)(?P<attrs>{_ATTRIBUTES})>"
    rf"|</(?P<end>[a-z][^\s/>]*+)[^>]*>", re.I | re.S)
_ATTRIBUTE = re.compile(
    r"""([^\s>/=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")


class _Tree:
    def __init__(self) -> None:
        self.found = [["html", "0>", None, False, None], ["head", "0>0>", None, False, None],
                      ["body", "0>1>", None, False, None]]
        self.counts = {"0>": 2, "0>0>": 0, "0>1>": 0}
        self.open: list[tuple[str, str]] = [("html", "0>"), ("head", "0>0>")]
        # (tag, path, attributes, all attributes as written, path of the enclosing marker)
        self.formatting: list[tuple[str, str, tuple, frozenset, str]] = []

    @property
    def in_head(self) -> bool:
        return len(self.open) == 2 and self.open[1][0] == "head"

    def enter_body(self) -> None:
        if self.in_head:
            self.open[1] = ("body", "0>1>")

    def add(self, tag: str, attrs: tuple, keep_open: bool = True) -> str:
        parent = self.open[-1][1]
        path = f"{parent}{self.counts[parent]}>"
        self.counts[parent] += 1
        self.found.append([tag, path, *attrs])
        if keep_open:
            self.counts[path] = 0
            self.open.append((tag, path))
        return path

    def merge(self, index: int, attrs: tuple) -> None:
        """Attributes of a repeated html, head or body tag fill in what is missing."""
        element = self.found[index]
        element[2] = attrs[0] if element[2] is None else element[2]
        element[3] = element[3] or attrs[1]
        element[4] = attrs[2] if element[4] is None else element[4]

    def pop_to(self, tags, stop: frozenset = SCOPE) -> bool:
        """Close the nearest of ``tags`` and all in it, unless a ``stop`` element is nearer."""
        for at in range(len(self.open) - 1, 1, -1):
            tag = self.open[at][0]
            if tag in tags:
                del self.open[at:]
                return True
            if tag in stop:
                return False
        return False

    def close_item(self, tags) -> None:
        for tag, _ in reversed(self.open[2:]):
            if tag in tags:
                self.pop_to({tag})
                return
            if tag in BLOCKS and tag not in ("address", "div"):
                return

    def marker(self) -> str:
        """Path of the innermost open cell, caption or object; entries of closed ones go."""
        marks = [path for tag, path in self.open if tag in MARKERS]
        while self.formatting and self.formatting[-1][4] not in ("", *marks):
            self.formatting.pop()
        return marks[-1] if marks else ""

    def reopen_formatting(self) -> None:
        if not self.formatting:
            return
        mark = self.marker()
        opened = {path for _, path in self.open}
        for at, (tag, path, attrs, written, own) in enumerate(self.formatting):
            if own == mark and path not in opened:
                self.formatting[at] = (tag, self.add(tag, attrs), attrs, written, own)

    def remember(self, tag: str, path: str, attrs: tuple, written: frozenset) -> None:
        """Note an open formatting element; of more than three equal ones the first is forgotten."""
        mark = self.marker()
        equal = [at for at, entry in enumerate(self.formatting)
                 if entry[0] == tag and entry[3] == written and entry[4] == mark]
        if len(equal) >= MOST_EQUAL:
            del self.formatting[equal[0]]
        self.formatting.append((tag, path, attrs, written, mark))

    def characters(self, text: str) -> None:
        if text and (not self.in_head or text.strip()):
            self.enter_body()
            self.reopen_formatting()

    def start(self, tag: str, attrs: tuple, closed: bool, source: str = "") -> None:
        if tag in ("html", "head", "body"):
            self.merge(("html", "head", "body").index(tag), attrs)
            if tag == "body":
                self.enter_body()
            return
        if self.in_head:
            if tag in HEAD_ONLY:
                self.add(tag, attrs, keep_open=tag == "template")
                return
            self.enter_body()
        if tag in CLOSES_P and tag not in ("li", "dd", "dt"):
            self.pop_to({"p"})
        if tag == "li":
            self.close_item({"li"})
            self.pop_to({"p"})
        elif tag in ("dd", "dt"):
            self.close_item({"dd", "dt"})
            self.pop_to({"p"})
        elif tag in HEADINGS and self.open[-1][0] in HEADINGS:
            self.open.pop()
        elif tag == "button":
            self.pop_to({"button"}, frozenset(SCOPE - {"button"}))
        elif tag == "a":
            self.end("a")
        elif tag in ENDS:
            if tag in TABLE_PARTS or tag in ("caption", "colgroup", "tbody", "thead", "tfoot"):
                while self.pop_to(ENDS[tag], frozenset({"html", "table", "template"})):
                    pass
                if not any(name == "table" for name, _ in self.open):
                    return
            else:
                while self.open[-1][0] in ENDS[tag]:
                    self.open.pop()
        for part in self._missing_parts(tag):
            self.add(part, (None, False, None))
        if tag not in BLOCKS and tag != "p" and tag not in HEAD_ONLY or tag == "button":
            self.reopen_formatting()
        path = self.add(tag, attrs, keep_open=not (closed or tag in VOID or tag in RAW))
        if tag in FORMATTING and not closed:
            self.remember(tag, path, attrs, frozenset(
                (name.lower(), value.strip("'\"")) for name, value in _ATTRIBUTE.findall(source)))

    def _missing_parts(self, tag: str) -> list[str]:
        missing: list[str] = []
        while tag in TABLE_PARTS and not missing and self.open[-1][0] not in TABLE_PARTS[tag] or (
                missing and missing[0] in TABLE_PARTS
                and self.open[-1][0] not in TABLE_PARTS[missing[0]]):
            missing.insert(0, IMPLIED[missing[0] if missing else tag])
        return missing

    def end(self, tag: str) -> None:
        if tag == "head":
            return
        if tag == "p" and not any(name == "p" for name, _ in self.open):
            self.enter_body()
            self.add("p", (None, False, None), keep_open=False)
            return
        if tag == "br":
            self.start("br", (None, False, None), True)
            return
        if tag in FORMATTING:
            mark = self.marker()
            for at in range(len(self.formatting) - 1, -1, -1):
                if self.formatting[at][4] != mark:
                    break
                if self.formatting[at][0] == tag:
                    path = self.formatting.pop(at)[1]
                    if any(path == one for _, one in self.open):
                        self.pop_to({tag})
                    return
        stop = SCOPE - {tag} if tag in ("button", "td", "th", "caption", "object") else SCOPE
        if tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
            stop = frozenset({"html", "table"} - {tag})
        self.pop_to(HEADINGS if tag in HEADINGS else {tag}, frozenset(stop))


def _read_attributes(text: str) -> tuple:
    href, onclick, kind = None, False, None
    if "=" in text or "href" in text.lower() or "onclick" in text.lower():
        for match in _ATTRIBUTE.finditer(text):
            name = match.group(1).lower()
            if name in ("href", "onclick", "type"):
                value = match.group(2) or ""
                if value[:1] in ("'", '"'):
                    value = value[1:-1]
                if name == "onclick":
                    onclick = True
                elif name == "href":
                    href = value if href is None else href
                else:
                    kind = value if kind is None else kind
    return href, onclick, kind


def page_elements(text: str) -> list[list]:
    """``[tag, path, href, has_onclick, type]`` of each element, values undecoded.

    Elements come in document order.
    """
    tree, at, foreign = _Tree(), 0, 0
    for token in _TOKEN.finditer(text):
        tree.characters(text[at:token.start()])
        at = token.end()
        tag = token.group("raw") or token.group("tag")
        if tag is not None:
            tag = tag.lower()
            source = token.group("raw_attrs") if token.group("raw") else token.group("attrs")
            foreign += tag in ("svg", "math")
            closed = bool(foreign) and source.rstrip().endswith("/")
            tree.start(tag, _read_attributes(source), closed, source)
            if closed and tag in ("svg", "math"):
                foreign -= 1
        elif token.group("end") is not None:
            tag = token.group("end").lower()
            if tag in ("svg", "math") and foreign:
                foreign -= 1
            tree.end(tag)
    tree.characters(text[at:])
    head = [element for element in tree.found[3:] if element[1].startswith("0>0>")]
    body = [element for element in tree.found[3:] if not element[1].startswith("0>0>")]
    return [*tree.found[:2], *head, tree.found[2], *body]
