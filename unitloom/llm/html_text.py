"""Visible text of web pages, laid out as blocks, lists and aligned tables.

A tokenizer cuts a page into tags and text, a tree builder supplies implied start and end tags and
keeps the path of open elements, and a layout writes visible text line by line. One pass over a
page; the tree is held as its open path only.
"""

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the public HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("script style template title noscript iframe noembed noframes audio video canvas datalist object meter progress".split())
# Of an svg only these show text, unless they are inside definitions.
SVG_SHOWN = {"text", "foreignobject"}
SVG_UNSEEN = set("defs symbol clippath mask pattern marker desc metadata".split())
IN_HEAD = set("base link meta title style script noscript template head".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre dl ul ol menu dir table figure fieldset hr xmp".split())
BLOCKS = CLOSES_P | set("html body li dt dd legend caption optgroup option textarea".split())
LISTS = set("ul ol menu dir".split())
CELLS = {"td", "th"}
ROW_GROUPS = {"thead", "tbody", "tfoot"}
SCOPE = CELLS | {"table", "caption", "html", "template"}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^A-Za-z>][^>]*+(?:>|\Z)|</>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
UNFINISHED = re.compile(r"<[A-Za-z/]")
BLANKS = re.compile(r"[ \t\n\f\r]+")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)
INDENT = 40


def tokens(html):
    """(kind, name or text, attributes) of a page; a tag that never ends swallows the rest."""
    at, n = 0, len(html)
    while at < n:
        cut = html.find("<", at)
        if cut < 0:
            yield "text", html[at:], ""
            return
        if cut > at:
            yield "text", html[at:cut], ""
        found = TOKEN.match(html, cut)
        if not found:
            if UNFINISHED.match(html, cut):
                return
            yield "text", "<", ""
            at = cut + 1
            continue
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            yield "end", tag, ""
            continue
        yield "start", tag, found["attrs"]
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = close.start() if close else n
            yield "raw" if tag not in ("textarea", "title") else "text", html[at:stop], ""
            at = stop


def attributes(text):
    out = {}
    if text.strip(" /\t\n\r\f"):
        for name, *values in ATTRIBUTE.findall(text):
            out.setdefault(name.lower(), unescape("".join(values)))
    return out


def shut(attrs):
    """True for a tag that ends itself, as elements of an svg can."""
    word = attrs.split()[-1:] or [""]
    return word[0].endswith("/") and not ("=" in word[0] and word[0][-2] not in "\"'")


def number(text, default, most):
    found = re.match(r"\s*[+-]?\d+", text or "")
    return max(-most, min(int(found[0]), most)) if found else default


class Flow:
    """Lines of one column of text: the page or a table cell."""

    def __init__(self):
        self.lines, self.parts = [], []
        self.prefix, self.first, self.gap, self.blank = "", None, False, False

    def text(self, text):
        words = BLANKS.split(text)
        if self.blank or words[0] == "" and len(words) > 1:
            if self.parts and any(words) and not self.parts[-1].endswith(" "):
                self.parts.append(" ")
        self.blank = words[-1] == "" and (any(words) or self.blank or len(words) > 1)
        body = " ".join(w for w in words if w)
        if body:
            self.parts.append(body)

    def kept(self, text):
        """Preformatted text."""
        for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.line(True)
            if line:
                self.parts.append(line)

    def line(self, even_empty=False, exact=False):
        """End the line; an empty one counts only if asked for."""
        body = "".join(self.parts)
        body = body if exact else body.rstrip(" ")
        self.parts, self.blank = [], False
        if body or even_empty and (self.lines or self.first):
            self.put(body)

    def put(self, body):
        if self.gap and self.lines:
            self.lines.append(self.prefix.rstrip())
        self.lines.append(((self.prefix if self.first is None else self.first) + body).rstrip())
        self.first, self.gap = None, False

    def block(self, spaced):
        self.line()
        self.gap = self.gap or spaced


class Table:
    def __init__(self):
        self.rows, self.taken, self.next = [], {}, 0

    def row(self):
        self.rows.append([])
        self.next = 0

    def cell(self, lines, colspan, rowspan):
        if not self.rows:
            self.row()
        row, r = self.rows[-1], len(self.rows) - 1
        c = self.next
        while self.taken.get(c, 0) > r:
            c += 1
        row.append((c, colspan, lines))
        self.next = c + colspan
        if rowspan > 1:
            for k in range(c, c + colspan):
                self.taken[k] = r + rowspan

    def lines(self):
        """Rows as lines, columns padded to one width and parted by ' | '."""
        rows = [row for row in self.rows if any(lines for _, _, lines in row)]
        used = sorted({c for row in rows for c, _, lines in row if lines})
        place = {c: i for i, c in enumerate(used)}
        if len(used) < 2:
            return [line for row in rows for _, _, lines in row for line in lines]
        width = [0] * len(used)
        for row in rows:
            for c, span, lines in row:
                if lines and (span == 1 or place[c] == len(used) - 1):
                    width[place[c]] = max(width[place[c]], max(map(len, lines)))
        out = []
        for row in rows:
            cells = {place[c]: lines for c, _, lines in row if lines}
            for k in range(max(map(len, cells.values()))):
                parts = [cells[i][k] if i in cells and k < len(cells[i]) else "" for i in range(len(used))]
                last = max((i for i, part in enumerate(parts) if part), default=0)
                out.append(" | ".join([*(part.ljust(w) for part, w in zip(parts[:last], width)), parts[last]]))
        return out


class Layout:
    """Tree builder and layout of one page."""

    def __init__(self):
        self.path = []  # [tag, hidden, what to restore at the end]
        self.flow, self.tables, self.hidden, self.pre = Flow(), [], 0, 0
        self.in_head, self.svg = False, False  # svg: hidden by an open svg
        self.places = {}  # of each tag, in the path

    def run(self, html):
        for kind, value, attrs in tokens(html):
            if kind == "text":
                self.text(value)
            elif kind == "start" and not ((self.svg or value == "svg") and shut(attrs)):
                self.start(value, attributes(attrs))
            elif kind == "end":
                self.end(value)
        while self.path:
            self.pop()
        self.flow.line()
        lines = self.flow.lines
        return "\n".join(lines).strip("\n").replace("\xa0", " ")

    def text(self, text):
        if self.in_head and self.path and self.path[-1][0] == "head" and text.strip():
            self.pop()
        if self.hidden:
            return
        text = unescape(text).replace("\x00", "")
        if self.pre:
            self.flow.kept(text)
        else:
            self.flow.text(text)

    def find(self, tags, stop):
        """Place of the innermost open element of `tags`, or -1 if one of `stop` is inside it."""
        at, bar = (max((self.places[t][-1] for t in group if self.places.get(t)), default=-1) for group in (tags, stop))
        return at if at >= bar else -1

    def close(self, tags, stop):
        at = self.find(tags, stop)
        while at >= 0 and len(self.path) > at:
            self.pop()
        return at >= 0

    def start(self, tag, attrs):
        if self.in_head and tag not in IN_HEAD:
            self.close({"head"}, ())
        if tag in ("html", "body"):
            if self.find({tag}, ()) >= 0:
                return
        if tag == "head":
            if self.path and self.path[-1][0] != "html":
                return
            self.in_head = True
        if tag in CLOSES_P:
            self.close({"p"}, SCOPE | {"button"})
        if tag == "li":
            self.close({"li"}, SCOPE | LISTS)
        elif tag in ("dt", "dd"):
            self.close({"dt", "dd"}, SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            self.close({"option"} if tag == "option" else {"option", "optgroup"}, SCOPE | {"select", "datalist"})
        elif tag in CELLS | {"tr", "caption"} | ROW_GROUPS:
            if self.find({"table"}, {"html", "template"}) < 0:
                return
            stop = {"table"}
            if tag in CELLS:
                self.close(CELLS | {"caption"}, stop)
                if self.find({"tr"}, stop) < 0:
                    self.push("tr", {})
            elif tag == "tr":
                self.close({"tr", "caption"}, stop)
            else:
                self.close(ROW_GROUPS | {"tr", "caption"}, stop)
        if tag in VOID:
            self.void(tag)
        else:
            self.push(tag, attrs)

    def void(self, tag):
        if self.hidden:
            return
        if tag == "br":
            self.flow.line(True)
        elif tag == "hr":
            self.flow.block(True)
            self.flow.put("---")
            self.flow.block(True)

    def push(self, tag, attrs):
        unseen = tag in HIDDEN or tag == "head" or "hidden" in attrs or bool(UNSEEN.search(attrs.get("style", "")))
        unseen = unseen or tag == "dialog" and "open" not in attrs
        if not unseen and self.path and self.path[-1][0] == "details" and tag != "summary":
            unseen = self.path[-1][2].get("shut", False)
        unseen = unseen or self.svg and tag in SVG_UNSEEN
        keep = {"shut": tag == "details" and "open" not in attrs}
        if not unseen and tag == "svg" and not self.hidden:
            keep["was"], unseen, self.svg = (self.hidden, self.svg), True, True
        elif not unseen and tag in SVG_SHOWN and self.svg and self.hidden == 1:
            keep["was"], self.hidden, self.svg = (self.hidden, self.svg), 0, False
            self.flow.block(False)
        self.hidden += unseen
        self.places.setdefault(tag, []).append(len(self.path))
        self.path.append((tag, unseen, keep))
        if self.hidden:
            keep["hidden"] = True
            return
        flow = self.flow
        if tag in BLOCKS or tag in CELLS:
            nested = tag in LISTS and self.find({"li"}, SCOPE) >= 0
            flow.block(tag in SPACED and not nested)
        if tag in ("pre", "xmp", "textarea"):
            self.pre += 1
        if tag in LISTS:
            keep["count"] = number(attrs.get("start"), 1, 10**9) if tag == "ol" else None
        elif tag in ("li", "blockquote", "dd"):
            mark = {"blockquote": "> ", "dd": "  "}.get(tag, "- ")
            if tag == "li":
                at = self.find(LISTS, SCOPE)
                if at >= 0 and self.path[at][2].get("count") is not None:
                    count = number(attrs.get("value"), self.path[at][2]["count"], 10**9)
                    self.path[at][2]["count"] = count + 1
                    mark = f"{count}. "
            keep["prefix"] = flow.prefix
            flow.first = (flow.prefix if flow.first is None else flow.first) + mark
            deeper = flow.prefix + ("> " if tag == "blockquote" else " " * len(mark))
            flow.prefix = deeper if len(deeper) <= INDENT else flow.prefix
            if len(flow.first) > INDENT + 12:
                flow.first = keep["prefix"] + mark
        elif tag == "table":
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].row()
        elif tag in CELLS:
            keep.update(flow=flow, spans=(min(max(number(attrs.get("colspan"), 1, 1000), 1), 1000), min(max(number(attrs.get("rowspan"), 1, 65534), 1), 65534)), pre=self.pre)
            self.flow, self.pre = Flow(), 0

    def pop(self):
        tag, unseen, keep = self.path.pop()
        self.places[tag].pop()
        self.hidden -= unseen
        if "was" in keep:
            self.hidden, self.svg = keep["was"]
        if tag == "head":
            self.in_head = False
        if keep.get("hidden"):
            return
        flow = self.flow
        if "was" in keep:
            flow.block(False)
        if tag in ("pre", "xmp", "textarea"):
            self.pre -= 1
        if tag in CELLS:
            flow.line()
            self.flow, self.pre = keep["flow"], keep["pre"]
            if self.tables:
                self.tables[-1].cell(_trimmed(flow.lines), *keep["spans"])
            return
        if tag == "table" and self.tables:
            flow.block(True)
            for line in self.tables.pop().lines():
                flow.put(line)
        if tag in BLOCKS:
            flow.block(tag in SPACED and not (tag in LISTS and self.find({"li"}, SCOPE) >= 0))
        if "prefix" in keep:
            flow.prefix, flow.first = keep["prefix"], None

    def end(self, tag):
        if tag == "br":
            self.void("br")
        elif tag == "p":
            if not self.close({"p"}, SCOPE | {"button"}) and not self.hidden:
                self.flow.block(True)
        elif re.fullmatch("h[1-6]", tag):
            self.close({"h1", "h2", "h3", "h4", "h5", "h6"}, SCOPE)
        elif tag in ("html", "body") or tag in VOID:
            return
        elif tag in CELLS | {"tr", "caption"} | ROW_GROUPS:
            self.close({tag}, {"table"})
        elif tag == "table":
            self.close({"table"}, {"html", "template"})
        elif tag == "li":
            self.close({"li"}, SCOPE | LISTS)
        else:
            self.close({tag}, SCOPE - {tag})


def _trimmed(lines):
    full = [i for i, line in enumerate(lines) if line]
    return lines[full[0] : full[-1] + 1] if full else []


def visible_text(html):
    return Layout().run(html)


def _texts(batches):
    for batch in batches:
        out = [None if html is None else visible_text(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.string())], ["page_id", "text"])


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) for every row of `pages` (page_id, html).

    Text of elements that a browser does not show (by tag, the hidden attribute or inline style) is
    left out; blocks start lines, blocks with margins are parted by a blank line, list items carry
    marks, cells of a table row stand in padded columns. A null page gives null, an empty one empty
    text. Repeated rows and null ids each give a row; further columns play no part; an empty table
    gives no rows. Whole pages are read, in one pass.
    """
    return pages.select("page_id", "html").mapInArrow(_texts, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string")
