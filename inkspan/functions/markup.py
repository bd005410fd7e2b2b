"""XML as a light tree, and the readings of its mixed content: Markdown, plain text, claim blocks, markup."""

from __future__ import annotations

import re
from typing import NamedTuple
from xml.etree import ElementTree as ET
from xml.parsers import expat

from .columns import ENTITIES, SPACE

#: Elements nested deeper than this make a record malformed.
DEEPEST = 256
_ENTITY = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|&(?=([A-Za-z_:][\w.:-]*);)", re.S)
_DECLARED = re.compile(r"<!ENTITY\s+([\w.:-]+)\s")
_REFERENCE = re.compile(r"([A-Za-z_:][\w.:-]*);")
#: What precedes the root, a doctype, and what that declares itself.
_HEAD = re.compile(r"(?s)(?:<\?.*?\?>|<!--.*?-->|\s)*(<!DOCTYPE[^>\[]*(\[.*?\]\s*)?>)?")
_KNOWN = frozenset(("amp", "lt", "gt", "quot", "apos"))


class Node:
    """An element: its name, attributes in order, and children (texts, marks and nodes). Where it is made from one of the compiled
    tree builder's, the other two are made when they are asked for first."""

    __slots__ = ("tag", "attrs", "kids", "made")

    def __init__(self, tag: str, attrs: list[tuple[str, str]] | None, made: ET.Element | None = None):
        self.tag, self.made = tag, made
        if made is None:
            self.attrs, self.kids = attrs, []

    def __getattr__(self, name: str):
        if name == "attrs":
            self.attrs = self.made.items()
            return self.attrs
        if name == "kids":
            self.kids = _kids(self.made)
            return self.kids
        raise AttributeError(name)

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.attrs if k == name), None) if self.made is None else self.made.get(name)

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def child(self, *names: str) -> Node | None:
        for k in self.kids:
            if isinstance(k, Node) and k.tag in names:
                return k
        return None

    def named(self, *names: str) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node) and k.tag in names]

    def walk(self):
        """This element and all below, in document order."""
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += e.elements()[::-1]

    def text(self) -> str:
        """All text below, trimmed; instructions and comments don't count."""
        if self.made is not None:
            return "".join(self.made.itertext()).strip(SPACE)
        out, todo = [], self.kids[::-1]
        while todo:
            k = todo.pop()
            if isinstance(k, Node):
                todo += k.kids[::-1]
            elif not isinstance(k, Mark):
                out.append(k)
        return "".join(out).strip(SPACE)

    def at(self, *path: str) -> str | None:
        """The text at a path of first children; null if it is not there or blank."""
        if (e := self.made) is not None:
            for name in path:
                if (e := e.find(name)) is None:
                    return None
            return "".join(e.itertext()).strip(SPACE) or None
        e = self
        for name in path:
            if (e := e.child(name)) is None:
                return None
        return e.text() or None

    def first_below(self, *names: str) -> str | None:
        """The text of the first element of these names below; null if that one is blank."""
        if self.made is not None:
            m = next((x for x in self.made.iter() if x is not self.made and x.tag in names), None)
            return "".join(m.itertext()).strip(SPACE) or None if m is not None else None
        e = next((x for x in self.walk() if x is not self and x.tag in names), None)
        return e.text() or None if e is not None else None


class Mark(str):
    """A processing instruction or a comment, as it is written; target and data are those of an instruction."""

    target: str | None = None
    data: str | None = None


class Tree(NamedTuple):
    root: Node
    #: What precedes the root element: declaration and doctype.
    prolog: str


def _escaped(raw: str) -> str:
    """raw, in which references to entities that nobody declares are escaped; those in CDATA, comments and instructions are none."""
    if "&" not in raw:
        return raw
    head = _HEAD.match(raw)
    declared = _KNOWN.union(_DECLARED.findall(head[2])) if head[2] else _KNOWN
    if not (unknown := {m[1] for x in raw.split("&")[1:] if (m := _REFERENCE.match(x))} - declared):
        return raw
    if "<![CDATA[" in raw or "<!--" in raw or any("&" in x.partition("?>")[0] for x in raw.split("<?")[1:]):
        return _ENTITY.sub(lambda m: "&amp;" if m[1] and m[1] not in declared else m[0], raw)
    for name in unknown:
        raw = raw.replace(f"&{name};", f"&amp;{name};")
    return raw


def _comment(text: str) -> ET.Element:
    """A comment as an element; no element's name begins with this sign, nor with the next one. Without text, as that counts as
    the record's."""
    return ET.Element("!", data=text)


def _instruction(target: str, data: str | None = None) -> ET.Element:
    return ET.Element("?", target=target, data=data or "")


def _built(body: str) -> ET.Element | None:
    """The root by the compiled tree builder, with marks as elements; null for what that isn't sure to read as the events do:
    what has namespaces or CDATA, is not well formed, or is nested too deep."""
    if "<![CDATA[" in body or "xmlns" in body or "xml:" in body:
        return None
    parser = ET.XMLParser(target=ET.TreeBuilder(comment_factory=_comment, pi_factory=_instruction, insert_comments=True, insert_pis=True), encoding="utf-8")
    try:
        parser.feed(body)
        root = parser.close()
    except ET.ParseError:
        return None
    if body.count("</") >= DEEPEST:  # else none can be nested deeper
        level, depth = [root], 0
        while level and depth <= DEEPEST:
            level, depth = [k for e in level for k in e], depth + 1
        return root if depth <= DEEPEST else None
    return root


def _mark(text: str, target: str | None = None, data: str | None = None) -> Mark:
    m = Mark(text)
    m.target, m.data = target, data
    return m


def _kids(e: ET.Element) -> list:
    out: list = [e.text] if e.text else []
    for k in e:
        tag = k.tag
        if tag == "?":
            t, d = k.get("target"), k.get("data")
            out.append(_mark(f"<?{t} {d}?>" if d else f"<?{t}?>", t, d or None))
        else:
            out.append(_mark(f"<!--{k.get('data')}-->") if tag == "!" else Node(tag, None, k))
        if k.tail:
            out.append(k.tail)
    return out


def tree(raw: str, wanted=None) -> Tree:
    """Entities that nobody declares stay as they are written. ValueError for what isn't well formed. wanted: says by its name
    whether a child of the root is asked for; what is below others is checked, but need not be kept."""
    raw = raw.lstrip(SPACE)
    head = _HEAD.match(raw)
    body = _escaped(raw)
    declaration = re.match(r"(?s)<\?xml\s.*?\?>", raw)
    found = None if head[2] and "<!" in head[2] else _built(body)
    root = _by_events(body, wanted) if found is None else Node(found.tag, None, found)
    return Tree(root, (declaration[0] if declaration else "") + (head[1] or ""))


def checked_root(raw: str) -> str:
    """The root's name of a record whose parts nobody asks for; ValueError for what isn't well formed, as tree() says it."""
    raw = raw.lstrip(SPACE)
    body, found = _escaped(raw), []
    if body.count("</") < DEEPEST:  # else it may be nested too deep
        parser = expat.ParserCreate("utf-8")

        def start(tag: str, _) -> None:
            found.append(tag)
            parser.StartElementHandler = None

        parser.StartElementHandler = start
        try:
            parser.Parse(body, True)
            return found[0]
        except expat.ExpatError:
            pass
    return _by_events(body, lambda _: False).tag


def _by_events(body: str, wanted=None) -> Node:
    """The root by the parser's events; ValueError for what isn't well formed or nested too deep."""
    root: list[Node] = []
    open_: list[Node] = []
    held: list[str] = []
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = parser.buffer_text = True
    below = 0  # how deep in a child of the root that is not asked for

    def flush() -> None:
        if held:
            if open_:
                open_[-1].kids.append("".join(held))
            held.clear()

    def start(tag: str, attrs: list[str]) -> None:
        if held:
            flush()
        e = Node(tag, list(zip(attrs[::2], attrs[1::2])) if attrs else [])
        (open_[-1].kids if open_ else root).append(e)
        open_.append(e)
        if len(open_) > DEEPEST:
            raise ValueError(f"elements nested more than {DEEPEST} deep")
        if wanted is not None and len(open_) == 2 and not wanted(tag):
            parser.StartElementHandler, parser.EndElementHandler = pass_start, pass_end
            parser.CharacterDataHandler = parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = parser.ProcessingInstructionHandler = parser.CommentHandler = None

    def end(_: str) -> None:
        if held:
            flush()
        open_.pop()

    def pass_start(_: str, __: list[str]) -> None:
        nonlocal below
        below += 1
        if below + 2 > DEEPEST:
            raise ValueError(f"elements nested more than {DEEPEST} deep")

    def pass_end(_: str) -> None:
        nonlocal below
        below -= 1
        if below < 0:
            below = 0
            open_.pop()
            listen()

    def mark(text: str, target: str | None = None, data: str | None = None) -> None:
        flush()
        if open_:
            open_[-1].kids.append(_mark(text, target, data))

    def listen() -> None:
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
        parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = flush
        parser.ProcessingInstructionHandler = lambda t, d: mark(f"<?{t} {d}?>" if d else f"<?{t}?>", t, d or None)
        parser.CommentHandler = lambda d: mark(f"<!--{d}-->")

    listen()
    try:
        parser.Parse(body, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from None
    return root[0]


def decoded(text: str) -> str:
    """The formats' named entities that texts still hold, decoded one name after another."""
    if "&" in text:
        for name, value in ENTITIES:
            text = text.replace(name, value)
    return text


def markup(k) -> str:
    """An element as markup around its content, entities decoded, attributes as they are."""
    if not isinstance(k, Node):
        return decoded(k)
    return f"<{k.tag}{''.join(f' {n}="{v}"' for n, v in k.attrs)}>{''.join(map(markup, k.kids))}</{k.tag}>"


#: What inline elements mean, by family of formats; all others are opaque. Fixed values of the formats.
V4 = {
    "number": "number", "cross-reference": "cross-reference", "figref": "figure", "claim-ref": "claim-reference", "dependent-claim-reference": "claim-reference",
    "b": "bold", "bold": "bold", "i": "italic", "italic": "italic", "highlight": "highlight", "claim-text": "claim-text",
}
V25 = {"PTEXT": "splice", "STEXT": "splice", "PDAT": "data", "BOLD": "bold", "ITALIC": "italic", "HIL": "highlight", "FGREF": "figure", "CLREF": "claim-reference"}
V15 = {k: v for k, v in V4.items() if k not in ("claim-ref", "b", "i")}


class Run(NamedTuple):
    """A piece of inline content: kind "text" holds a string, "opaque" a node or mark, all others a list of runs."""

    kind: str
    content: object
    attrs: list = []


def runs(e: Node, family: dict[str, str]) -> list[Run]:
    """An element's content. Blank texts are dropped; comments too, and instructions outside version 4."""
    out: list[Run] = []
    for k in e.kids:
        if isinstance(k, Mark):
            if family is V4 and k.target:
                out.append(Run("opaque", k))
        elif not isinstance(k, Node):
            if k.strip(SPACE):
                out.append(Run("text", k))
        elif (kind := family.get(k.tag)) is None:
            out.append(Run("opaque", k))
        elif kind == "splice":
            out += runs(k, family)
        elif kind == "data":
            if whole := "".join(x for y in k.walk() for x in y.kids if isinstance(x, str) and not isinstance(x, Mark)):
                if whole.strip(SPACE):
                    out.append(Run("text", whole))
        else:
            out.append(Run(kind, runs(k, family), k.attrs))
    return out


_MARKS = {"bold": "**", "italic": "*"}


def reading(content: list[Run], marked: bool) -> str:
    """Inline content as text; marked: bold and italic in Markdown, but not inside references to figures."""
    out = []
    for r in content:
        if r.kind == "text":
            out.append(decoded(r.content))
        elif r.kind == "opaque":
            out.append(markup(r.content))
        else:
            sign = _MARKS.get(r.kind, "") if marked else ""
            out.append(sign + reading(r.content, marked and r.kind != "figure") + sign)
    return "".join(out)


def _indented(text: str, by: int) -> str:
    return "\n".join(" " * by + x if x else x for x in text.split("\n")) if by else text


def _claim_lines(content: list[Run], by: int, inside: bool) -> str:
    out = ""
    for r in content:
        if r.kind == "text":
            out += _indented(decoded(r.content), by)
        elif r.kind == "opaque":
            out += _indented(markup(r.content), by)
        elif r.kind == "claim-text" and inside:  # one level down, on a line of its own
            out += ("\n" if out and not out.endswith("\n") else "") + _claim_lines(r.content, by + 2, True)
        else:
            out += _claim_lines(r.content, by, True)
    return out


#: White space to str.split, but not to the formats.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(f"[{SPACE}]+")


def squeezed(text: str) -> str:
    return " ".join(filter(None, _SPACES.split(text)) if _SEPARATORS.search(text) else text.split())


def claim_block(content: list[Run]) -> str:
    """A claim's text with nested parts indented; runs of white space within a line become one blank."""
    lines = [x.removesuffix("\r") for x in _claim_lines(content, 0, False).split("\n")]
    return "\n".join(" " * (len(x) - len(x.lstrip(" "))) + squeezed(x) if x.strip(SPACE) else "" for x in lines).rstrip(SPACE)


#: Escapes of text on its way back to XML; what reads as an entity stays.
_BARE = re.compile(r"&(?![A-Za-z0-9#_-]+;)")


def escaped(text: str) -> str:
    return _BARE.sub("&amp;", text).replace("<", "&lt;").replace(">", "&gt;")


def attributes(attrs: list[tuple[str, str]]) -> str:
    return "".join(f' {n}="{escaped(v).replace(chr(34), "&quot;")}"' for n, v in attrs)


def element(tag: str, *inner: str, attrs: list = ()) -> str:
    return f"<{tag}{attributes(attrs)}>{''.join(inner)}</{tag}>"


def source(k, literal_marks: bool = True) -> str:
    """A node, mark or text as XML again. literal_marks: instructions and comments stay; else they become text."""
    if isinstance(k, Node):
        return element(k.tag, *(source(x, literal_marks) for x in k.kids), attrs=k.attrs)
    return str(k) if literal_marks and k.lstrip(SPACE).startswith(("<?", "<!")) else escaped(k)
