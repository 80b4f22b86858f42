"""HTML, Markdown, wiki and LaTeX residue: which kinds a text holds, and its clean text.

Code and formulas are set aside first, so that nothing reads their inside. HTML goes through the
standard library's streaming parser: its events decide whether the text holds HTML, build the lines
and count the tags. The ratio of text to tags of each line is smoothed by a Gaussian, and two-means
clustering gives the threshold that selects the content regions; link-only lines outside of them are
dropped, all others stay. What only looks like a tag stays text, and an element that is left open hides
nothing. Markdown, wiki and LaTeX are then read line by line.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.operators.once import once_each

KINDS = ("html", "markdown", "wiki", "latex")

# Names of elements.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template text textarea tfoot th thead time title tr track tt type u ul var video wbr xml document page".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul br".split())
SKIPPED = frozenset("script style template noscript".split())
# Attributes without a value.
BARE_ATTRIBUTES = frozenset("allowfullscreen async autofocus autoplay checked compact controls declare default defer disabled formnovalidate hidden inert ismap itemscope loop multiple muted nohref nomodule noresize noshade novalidate nowrap open playsinline readonly required reversed selected".split())
#: Lists in lists are indented to this depth; deeper items stand there.
DEEPEST = 20
# LaTeX commands that need no braces.
COMMANDS = "item section subsection subsubsection paragraph chapter label ref cite caption footnote centering hline maketitle tableofcontents newpage noindent textbf textit texttt emph underline frac sum prod int sqrt times leq geq neq approx cdot pm infty alpha beta gamma delta epsilon lambda mu pi rho sigma tau phi omega Delta Sigma Omega partial nabla rightarrow leftarrow left right begin end usepackage documentclass"

_TAG = re.compile(r"</?([a-zA-Z][\w.-]*+(?::[\w.-]++)?+)((?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>]++))?+|\s*+/)*+\s*+)>")
_LOOSE_TAG = re.compile(r"<([a-zA-Z][\w.-]*+(?::[\w.-]++)?+)(\s[^<>]*=[^<>]*)>")
_VALUED = re.compile(r"[^\s\"'<>/=]++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>]++)")
_DECLARATION = re.compile(r"<!doctype\b[^<>]*>|<\?[a-zA-Z][^<>]*>", re.I)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]++(\S[^\n]*)$", re.M)
_SETEXT = re.compile(r"^(?=[^\n]*\w)([^\n]+)\n[ ]{0,3}(={3,}|-{3,})[ \t]*$", re.M)
_NO_HEADING = re.compile(r"\s*(?:[-*+>|]|\d{1,9}[.)])\s")
_LINK = re.compile(r"(!?)\[([^\[\]\n]*)\]\(\s*<?([^()\s<>]*(?:\([^()\s]*\)[^()\s<>]*)*)>?(?:\s+\"[^\"\n]*\")?\s*\)")
_REF_LINK = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S+|\[\^\w+\]", re.M)
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)[^\n`]*$", re.M)
_CODE = re.compile(r"(?<!`)(`)(?![`\s])([^`\n]++)(?<!\s)`(?!`)|(?<!`)(``)(?![`\s])((?:[^`\n]|`(?!`))++)(?<!\s)``(?!`)")
_BOLD = re.compile(r"(?<![*\w])\*\*(?=[^\s*])([^*\n]*[^\s*])\*\*(?![*\w])|(?<![\w_])__(?=[^\s_])([^\n]*?[^\s_])__(?![\w_])|(?<!~)~~(?=\S)([^~\n]*\S)~~(?!~)")
_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]*[^\s_])_(?![\w_])")
_TASK = re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+(?=\S)", re.M)
_PIPES = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|[ \t:-]*$", re.M)
_QUOTE = re.compile(r"^> ?\S[^\n]*\n> ?\S", re.M)

_W_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\n](?:[^\n]*[^=\n])?)[ \t]*\1[ \t]*$", re.M)
_W_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
_W_TEMPLATE = re.compile(r"\{\{\s*[A-Za-z#!:][^{}]*\}\}")
_W_BOLD = re.compile(r"(?<!')('''''|'''|'')(?![\s'])(?:[^'\n]|'(?!'))++(?<!\s)\1(?!')")
_W_TABLE = re.compile(r"^[ \t]*\{\|", re.M)
_W_EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\]]+[ \t]+([^\]\n]+)\]")
_W_OTHER = re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|<ref[ >/]|^#REDIRECT", re.M)

_T_ENVIRONMENT = re.compile(r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}")
_T_COMMAND = re.compile(r"(?<![\\\w:])\\[a-zA-Z]+\*?\s*(?:\[[^\]\n]*\])?\{")
_T_KNOWN = re.compile(rf"(?<![\\\w:/.])\\(?:{'|'.join(COMMANDS.split())})(?![a-zA-Z\\.])")
_T_MATH = re.compile(r"\\\((?:[^\\]|\\(?![()]))++\\\)|\\\[(?:[^\\]|\\(?![\[\]]))++\\\]|\$\$(?![$\s])(?:[^$]|\$(?!\$))++\$\$")
_T_INLINE = re.compile(r"(?<![\\$\w{])\$(?![\s$])([^$\n]++)(?<![\s\\])\$(?![\w$])")
_T_ESCAPE = re.compile(r"(?<!\\)\\[%$#&_](?=\S)")
_T_FORMULA = re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math|alignat|flalign)\*?)\}")
_T_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\}(?:\[[^\]\n]*\])?")


def has_html(text: str) -> bool:
    """The parser reports a tag of a known or qualified name (or any that is closed), a comment, a declaration or a character reference, also if escaped."""
    return ("<" in text or "&" in text) and read_html(text).found


def has_markdown(text: str) -> bool:
    if "`" in text and (any(_is_code(m) for m in _CODE.finditer(text)) or len(_FENCE.findall(text)) > 1):
        return True
    if "](" in text and any(m[1] or m[3] and _is_target(m[2], m[3]) for m in _LINK.finditer(text)):
        return True
    if "#" in text and any(not m[2].startswith("of ") for m in _ATX.finditer(text)):  # "# of shares" is a number
        return True
    if ("\n---" in text or "\n===" in text or "\n " in text) and any(_is_setext(m) for m in _SETEXT.finditer(text)):
        return True
    if ("**" in text or "__" in text or "~~" in text) and any(_inside(text, m) for m in _BOLD.finditer(text)):
        return True
    if "*" in text or "_" in text:
        if any(_inside(text, m) for m in _EM.finditer(text)):
            return True
    return bool("[" in text and (_TASK.search(text) or _REF_LINK.search(text)) or "--" in text and "|" in text and _PIPES.search(text) or "> " in text and _QUOTE.search(text))


def _is_code(m: re.Match) -> bool:
    return bool(m[1]) or "''" not in m[4]  # else it is a quotation as LaTeX writes it


def _is_target(label: str, target: str) -> bool:
    """A footnote such as [1](a) is no link."""
    return not label.strip().isdigit() or any(c in target for c in "./:#?")


def _is_setext(m: re.Match) -> bool:
    return not _W_HEADING.match(m[1]) and not _NO_HEADING.match(m[1])


def _inside(text: str, m: re.Match) -> bool:
    """The match is more than a whole line that is set off by its marks, or a name in capitals and underscores."""
    start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
    line = text[start : end if end >= 0 else len(text)]
    if m.re is _BOLD and m[2] and re.fullmatch(r"[A-Z]+", m[2]):
        return False
    return line.strip() != m[0]


def has_wiki(text: str) -> bool:
    return bool(
        "==" in text and _W_HEADING.search(text)
        or "[[" in text and _W_LINK.search(text)
        or "{{" in text and _W_TEMPLATE.search(text)
        or "{|" in text and _W_TABLE.search(text)
        or "''" in text and _W_BOLD.search(text)
        or "[http" in text and _W_EXTERNAL.search(text)
        or ("__" in text or "<ref" in text or "#REDIRECT" in text) and _W_OTHER.search(text)
    )


def has_latex(text: str) -> bool:
    if "\\" in text and (_T_ENVIRONMENT.search(text) or _T_COMMAND.search(text) or _T_KNOWN.search(text) or _T_ESCAPE.search(text) or _T_MATH.search(text)):
        return True
    return "$" in text and bool("$$" in text and _T_MATH.search(text) or any(_is_formula(m) for m in _T_INLINE.finditer(text)))


def _is_formula(m: re.Match) -> bool:
    return "\\" in m[1] or "^" in m[1] and not m[1][0].isdigit()


def markups_of(text: str) -> list[str]:
    return [k for k, has in zip(KINDS, (has_html, has_markdown, has_wiki, has_latex), strict=True) if has(text)]


class Vault:
    """Code and formulas that are set aside: a mark stands in the text for each, made of characters that the text doesn't hold."""

    def __init__(self, text: str) -> None:
        free = (chr(c) for c in range(0xE000, 0xF900) if chr(c) not in text)
        self.open, self.close, self.less, self.amp = (next(free) for _ in range(4))
        self.held: list[str] = []
        self._mark = re.compile(f"{self.open}(\\d+){self.close}")

    def put(self, text: str) -> str:
        self.held.append(text)
        return f"{self.open}{len(self.held) - 1}{self.close}"

    def back(self, text: str) -> str:
        return self._mark.sub(lambda m: self.back(self.held[int(m[1])]), text)


class _Reader(HTMLParser):
    """Lines of text with their numbers of tags and of characters in links, from the parser's events."""

    def __init__(self, text: str, vault: Vault) -> None:
        super().__init__(convert_charrefs=False)
        self.vault = vault
        self.rows: list[tuple[list, int, int]] = []
        self.parts: list = []  # strings, and (name, source) of tags of unknown names
        self.tags = self.linked = 0
        self.solid = self.found = self.mark = False
        self.opened: set[str] = set()
        self.closed: set[str] = set()
        low = text.lower()
        self.ends = {k: low.count(f"</{k}") for k in ("pre", "code", "table")}  # ends that are still to come
        self.skip = ""
        self.link = self.cells = 0
        self.code = ""  # the element whose text is gathered in `inside`
        self.inside: list[str] = []
        self.lists: list[int] = []  # the next number of each open list, 0 where there are none
        self.row = self.cell = self.table = False

    def _line(self) -> None:
        self.rows.append((self.parts, self.tags, self.linked))
        self.parts, self.tags, self.linked, self.solid, self.mark = [], 0, 0, False, False

    def _break(self) -> None:
        if self.cell:
            self.parts.append(" ")
        elif self.solid or self.mark:
            self._line()

    def _write(self, text: str) -> None:
        self.parts.append(text)
        self.solid = self.solid or not text.isspace()

    def _end_code(self, whole: bool = True) -> None:
        text, kind = "".join(self.inside), self.code
        self.code, self.inside = "", []
        if kind == "pre":
            self._break()
            self._write(self.vault.put("```\n" + text.strip("\n") + "\n```"))
            self._break()
        elif text.strip() and whole:
            self._write(self.vault.put(f"`{text}`"))
        else:
            self.handle_data(text)

    def _unknown(self, tag: str, source: str, into: set[str]) -> bool:
        if tag in ELEMENTS or ":" in tag:
            self.found = True
            return False
        into.add(tag)
        self.parts.append((tag, source))
        return True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._unknown(tag, self.get_starttag_text() or "", self.opened) or self.skip:
            return
        if tag in SKIPPED:
            self.skip = tag
            return
        if self.code == "code" and tag in BLOCKS:  # it was left open
            self._end_code(whole=False)
        if self.code:
            if tag == "br":
                self.inside.append("\n")
            return
        if tag in ("td", "th") and self.row:
            self.cell = False
            if self.cells:
                self._write(" | ")
            self.cells += 1
            self.cell = True
        elif tag in ("tr", "table", "tbody", "thead", "tfoot"):
            self.cell = False
            self._break()
            self.table = self.ends["table"] > 0
            self.row = tag == "tr" and self.table
            self.cells = 0
        elif tag in BLOCKS:
            self._break()
        self.tags += 1
        if tag in ("ul", "ol", "menu", "dir"):
            first = dict(attrs).get("start") or "1"
            self.lists.append(int(first) if tag == "ol" and first.isdigit() and len(first) < 10 else int(tag == "ol"))
        elif tag == "li" and not self.cell:
            depth = min(max(len(self.lists), 1), DEEPEST)
            number = self.lists[-1] if self.lists else 0
            self._write("  " * (depth - 1) + (f"{number}. " if number else "- "))
            if number:
                self.lists[-1] += 1
            self.mark = True
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and not self.cell:
            self._write("#" * int(tag[1]) + " ")
            self.mark = True
        elif tag in ("pre", "code") and self.ends[tag] > 0:
            self.code = tag
        elif tag == "a":
            self.link += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in ("a", "pre", "code", *SKIPPED):  # empty elements
            self._unknown(tag, "", self.opened)
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.ends:
            self.ends[tag] -= 1
        if self._unknown(tag, f"</{tag}>", self.closed):
            return
        if self.skip:
            self.skip = "" if tag == self.skip else self.skip
            return
        if self.code:
            if tag == self.code:
                self.tags += 1
                self._end_code()
            elif self.code == "code" and tag in BLOCKS:
                self._end_code(whole=False)
                self.handle_endtag(tag)
            return
        self.tags += 1
        if tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in ("td", "th"):
            self.cell = False
        elif tag in ("tr", "table"):
            self.row = self.cell = False
            self.table = self.table and tag == "tr"
            self._break()
        elif tag in ("ul", "ol", "menu", "dir"):
            self.lists = self.lists[:-1]
            self._break()
        elif tag in BLOCKS and tag != "br":
            self._break()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.code:
            self.inside.append(data)
            return
        if (self.row or self.table) and not self.cell and data.isspace():
            return  # the source's lines are no lines of the table
        if self.row:
            data = data.replace("\n", " ")
        for i, part in enumerate(data.split("\n")):
            if i and not self.mark:
                self._line()
            if self.mark:
                part = part.lstrip()
                self.mark = not part
            if part:
                self._write(part)
                if self.link:
                    self.linked += len(part)

    def handle_entityref(self, name: str) -> None:
        self.found = True
        self.handle_data(html.unescape(f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.found = True
        self.handle_data(html.unescape(f"&#{name};"))

    def handle_comment(self, data: str) -> None:
        self.found = True

    def handle_decl(self, decl: str) -> None:
        self.found = True

    def unknown_decl(self, data: str) -> None:
        self.found = True
        self.handle_data(data.removeprefix("CDATA["))

    def lines(self) -> list[tuple[str, int, int]]:
        if self.code:
            self._end_code(whole=False)
        self._line()
        named = self.opened & self.closed
        self.found = self.found or bool(named)
        text = lambda parts: "".join(x if isinstance(x, str) else "" if x[0] in named else x[1] for x in parts)
        return [(text(p), tags, linked) for p, tags, linked in self.rows]


def _is_tag(m: re.Match) -> bool:
    """Its attributes have values, or names that need none; else it is a comparison such as a <b and c> d."""
    return not m[2].strip(" /\t\n") or all(w.lower() in BARE_ATTRIBUTES or w == "/" for w in _VALUED.sub(" ", m[2]).split())


def _marked(text: str, vault: Vault) -> str:
    """text in which each < and & that begins no tag, comment or reference is replaced, and each start of a hidden element that never ends is made harmless."""
    out, at, low = [], 0, ""
    no_comment = no_section = False
    endless: set[str] = set()
    for m in re.finditer("[<&]", text):
        i = m.start()
        if i < at:
            continue
        out.append(text[at:i])
        at = i
        if m[0] == "&":
            ref = _REFERENCE.match(text, i)
            good = ref and (ref[0][1] == "#" or ref[0][1:] in html.entities.html5)
            out.append(ref[0] if good else vault.amp)
            at = ref.end() if good else i + 1
            continue
        end = -1
        if text.startswith("<!--", i) and not no_comment:
            end = text.find("-->", i + 4)
            no_comment = end < 0
            end = end + 3 if end >= 0 else -1
        elif text.startswith("<![CDATA[", i) and not no_section:
            end = text.find("]]>", i)
            no_section = end < 0
            end = end + 3 if end >= 0 else -1
        elif tag := _DECLARATION.match(text, i):
            end = tag.end()
        elif (tag := _TAG.match(text, i)) and _is_tag(tag) or (tag := _LOOSE_TAG.match(text, i)):
            end, name = tag.end(), tag[1].lower()
            if name in SKIPPED and text[i + 1] != "/" and not tag[0].endswith("/>"):
                low = low or text.lower()
                close = -1 if name in endless else low.find(f"</{name}", end)
                if close < 0:
                    endless.add(name)
                again = low.find(f"<{name}", end) if close >= 0 else -1
                if close < 0 or name in ("noscript", "template") and 0 <= again < close:
                    out.append("<span>")
                    at = end
                    continue
                if name in ("script", "style"):
                    end = close
        if end < 0:
            out.append(vault.less)
            at = i + 1
        else:
            out.append(text[i:end])
            at = end
    return "".join([*out, text[at:]])


class Page:
    """found: whether the parser saw HTML; lines: text, tags, characters in links."""

    def __init__(self, text: str, vault: Vault) -> None:
        reader = _Reader(text, vault)
        reader.feed(_marked(text, vault))
        reader.close()
        self.lines = [(t.replace(vault.less, "<").replace(vault.amp, "&"), k, n) for t, k, n in reader.lines()]
        vault.held = [t.replace(vault.less, "<").replace(vault.amp, "&") for t in vault.held]
        self.found = reader.found


def read_html(text: str, vault: Vault | None = None) -> Page:
    return Page(text, vault or Vault(text))


def content_lines(lines: list[tuple[str, int, int]]) -> list[str]:
    """Lines that are content: their smoothed ratio of text to tags is in the upper cluster, or they are more than links."""
    if not lines:
        return []
    size = np.array([len(t.strip()) for t, _, _ in lines], float)
    ratio = np.log1p(size / np.maximum(1, [k for _, k, _ in lines]))
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    smooth = np.convolve(np.pad(ratio, 2, mode="edge"), kernel / kernel.sum(), "valid")
    low, high = smooth.min(), smooth.max()
    for _ in range(20):  # two means in one dimension
        cut = (low + high) / 2
        below, above = smooth[smooth <= cut], smooth[smooth > cut]
        if not len(below) or not len(above):
            break
        low, high = below.mean(), above.mean()
    cut = (low + high) / 2
    return [t for (t, k, links), s, n in zip(lines, smooth, size, strict=True) if s >= cut or not k or not n or links < 0.8 * n]


def from_html(text: str, vault: Vault | None = None) -> str:
    """Text of the content regions; lists keep their depth and numbers, tables their cells. Code goes to the vault, if there is one."""
    own = vault or Vault(text)
    out = "\n".join(content_lines(read_html(text, own).lines))
    if "<" in out or "&" in out:  # tags that were escaped
        again = read_html(out, own)
        out = "\n".join(t for t, _, _ in again.lines) if again.found else out
    out = out.replace("\xa0", " ")
    return out if vault else own.back(out)


def from_wiki(text: str) -> str:
    text = _W_HEADING.sub(lambda m: f"{'#' * len(m[1])} {m[2].strip()}", text)
    text = _W_LINK.sub(lambda m: "" if m[1].lower().startswith(("file:", "image:", "category:")) else m[1].rsplit("|", 1)[-1], text)
    while (less := _W_TEMPLATE.sub(_template_text, text)) != text:
        text = less
    text = re.sub("'{2,5}", "", text) if "''" in text else text
    text = _W_EXTERNAL.sub(r"\1", text)
    text = _W_ITEM.sub(lambda m: "  " * (len(m[1]) - 1) + "- ", text)
    if _W_TABLE.search(text):
        out, table = [], False
        for line in text.split("\n"):
            s = line.strip()
            table = (table or s.startswith("{|")) and not s.startswith("|}")
            if s.startswith(("{|", "|}", "|-")):
                continue
            out.append(" | ".join(_W_CELL.sub("", x).strip() for x in s[1:].replace("!!", "||").split("||")) if table and s.startswith(("|", "!")) else line)
        text = "\n".join(out)
    return _W_OTHER.sub("", text)


_W_ITEM = re.compile(r"^(\*{1,9})[ \t]*(?=[^\s*])(?![^\n]*\*[ \t]*$)", re.M)
_W_CELL = re.compile(r"^\s*(?:[a-z]+\s*=\s*(?:\"[^\"]*\"|\S+)\s*)+\|(?!\|)")


def _template_text(m: re.Match) -> str:
    name, *values = m[0][2:-2].split("|")
    plain = [v.strip() for v in values if "=" not in v]
    return " ".join(plain) if name.strip().lower() == "convert" and plain else ""


# LaTeX commands whose argument is plain text, and the depth of headings.
_T_WRAP = "textbf textit texttt emph underline textrm textsc textsf mbox text footnote caption url".split()
_T_DEPTH = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_T_TOKEN = re.compile(rf"\\href\s*\{{[^{{}}\n]*\}}\s*\{{|\\({'|'.join([*_T_WRAP, *_T_DEPTH])})\*?\s*\{{|(?<!\\)[{{}}]")


def _unwrapped(text: str) -> str:
    """Commands around plain text go, headings become lines with #, other braces stay."""
    out, at, open_ = [], 0, []
    for m in _T_TOKEN.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "{":
            open_.append("{")
            out.append("{")
        elif m[0] == "}":
            kind = open_.pop() if open_ else "{"
            out.append("}" if kind == "{" else "\n" if kind in _T_DEPTH else "")
        else:
            open_.append(m[1] or "href")
            out.append(f"\n{'#' * _T_DEPTH[m[1]]} " if m[1] in _T_DEPTH else "")
    return "".join([*out, text[at:]])


_T_LIST = re.compile(r"\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?|(?<![\w\\:])\\item(?![a-zA-Z])(?:\[([^\]\n]*)\])?[ \t]*")


def _items(text: str) -> str:
    lists: list[int] = []

    def one(m: re.Match) -> str:
        if m[1] == "begin":
            lists.append(int(m[2] == "enumerate"))
            return ""
        if m[1] == "end":
            del lists[-1:]
            return ""
        depth = min(len(lists), DEEPEST)
        indent = ("\n" if m.string[max(0, m.start() - 80) : m.start()].rstrip(" \t")[-1:] not in ("", "\n") else "") + "  " * max(0, depth - 1)
        label = f"{m[3]} " if m[3] else ""
        if lists and lists[-1]:
            lists[-1] += 1
            return f"{indent}{lists[-1] - 1}. {label}"
        return f"{indent}- {label}"

    return _T_LIST.sub(one, text)


def from_latex(text: str) -> str:
    """Headings, items and emphasis become plain; formulas have been set aside."""
    text = _items(_unwrapped(text))
    table = "\\begin{tabular}" in text
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\{[^{}]*\}|\[[^\]]*\])*", "", text)
    text = re.sub(r"(?<![\w\\:])\\(?:hline|centering|noindent|newpage|maketitle|tableofcontents|label\{[^{}]*\})", "", text)
    if table:
        text = re.sub(r"[ \t]*(?<!\\)&[ \t]*", " | ", re.sub(r"[ \t]*\\\\[ \t]*$", "", text, flags=re.M))
    return _T_ESCAPE.sub(lambda m: m[0][1], text)


def from_markdown(text: str) -> str:
    """Headings and list items keep their marks; emphasis and link targets go. Code has been set aside, but for a fence without an end."""
    out, code = [], False
    for line in _SETEXT.sub(lambda m: f"{'#' if m[2][0] == '=' else '##'} {m[1]}" if _is_setext(m) else m[0], text).split("\n"):
        if _FENCE.fullmatch(line):
            code = True
            out.append("```")
            continue
        if not code:
            line = _TASK.sub("- ", line)
            if _PIPES.fullmatch(line):
                continue
            if (bare := line.strip()).startswith("|") and bare.endswith("|") and len(bare) > 1:
                line = " | ".join(x.strip() for x in bare[1:-1].split("|"))
            line = _LINK.sub(lambda m: m[2] if m[1] or _is_target(m[2], m[3]) else m[0], line)
            whole = line
            line = _BOLD.sub(lambda m: next(g for g in m.groups() if g) if _inside(whole, m) else m[0], line)
            line = _EM.sub(lambda m: next(g for g in m.groups() if g) if _inside(line, m) else m[0], line)  # noqa: B023
        out.append(line)
    return "\n".join(out)


def set_aside(text: str, kinds: list[str], vault: Vault) -> str:
    """text with a mark for each block and span of code (Markdown, LaTeX) and each formula."""
    if "markdown" in kinds and ("`" in text or "~~~" in text):
        text = _fences(text, vault)
        text = _CODE.sub(lambda m: vault.put(f"`{m[2] or m[4]}`") if _is_code(m) else m[0], text)
    if "latex" in kinds:
        text = _environments(text, _T_VERBATIM, lambda m, body: vault.put("```\n" + body.strip("\n") + "\n```"))
        text = _environments(text, _T_FORMULA, lambda m, body: vault.put(f"{m[0]}{body}\\end{{{m[1]}}}"))
        text = _T_MATH.sub(lambda m: vault.put(m[0]), text)
        text = _T_INLINE.sub(lambda m: vault.put(m[0]) if any(c in m[1] for c in "\\^_") else m[0], text)
    return text


def _fences(text: str, vault: Vault) -> str:
    """A fence ends at the next line of as many of its marks."""
    out: list[str] = []
    mark, began = "", 0
    for line in text.split("\n"):
        m = _FENCE.fullmatch(line)
        out.append(line)
        if not m:
            continue
        if not mark:
            mark, began = m[1], len(out)
        elif m[1].startswith(mark) and line.strip() == m[1]:
            out[began - 1 :] = [vault.put("\n".join(["```", *out[began:-1], "```"]))]
            mark = ""
    return "\n".join(out)


def _environments(text: str, begin: re.Pattern, held) -> str:  # noqa: ANN001
    """Each environment that also ends is replaced by held(its beginning, its body)."""
    out, at = [], 0
    for m in begin.finditer(text):
        if m.start() < at:
            continue
        close = f"\\end{{{m[1]}}}"
        end = text.find(close, m.end())
        if end < 0:
            break
        out += [text[at : m.start()], held(m, text[m.end() : end])]
        at = end + len(close)
    return "".join([*out, text[at:]])


def clean(text: str) -> tuple[str, list[str]]:
    """Clean text and the kinds of markup found; a text without any comes back as it stands."""
    kinds = markups_of(text)
    if not kinds:
        return text, kinds
    vault = Vault(text)
    text = set_aside(text, kinds, vault)
    if "html" in kinds:
        text = from_html(text, vault)
    if "wiki" in kinds:
        text = from_wiki(text)
    if "latex" in kinds:
        text = from_latex(text)
    if "markdown" in kinds:
        text = from_markdown(text)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<![ \t])[ \t]++$", "", text, flags=re.M)).strip("\n")
    return vault.back(text), kinds


def clean_markup(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """id, markups array, text: clean text of each distinct (id, text).

    Headings come as lines with one to six #, list items with "- " or their number and two blanks for each
    level, table cells (empty ones too) joined by " | ", code between ``` or in back quotes, formulas as they
    stand. Null texts give no row, an empty text stays empty; the whole text is read, the url plays no
    part. Extra columns are ignored.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [clean(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for _, k in rows], pa.list_(pa.string())), pa.array([t for t, _ in rows], pa.string())], ["id", "markups", "text"])

    rows = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return once_each(rows).mapInArrow(convert, "id string, markups array<string>, text string")
