"""The words of a LaTeX text as a reader of the typeset page sees them.

Plain functions on strings, called inside Arrow batches. Groups in braces are matched to any depth by
counting, all other patterns are linear in the text. Text without LaTeX passes through unharmed.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

# Characters that the document's macros may add to a text: a definition that doubles itself at every
# level would fill the memory. Uses beyond it are left out; the bodies have streams of their own.
MAX_ADDED = 20_000_000
NEAR = 40  # braces
SHORTEST_BODY = 9  # characters of five words at least: shorter bodies say nothing by themselves

# Accent commands and the combining mark of each; letters that commands stand for.
MARKS = {
    '"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307",
    "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "r": "\u030a", "k": "\u0328", "d": "\u0323",
}
LETTERS = {
    "ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "aa": "å", "l": "ł", "i": "i", "j": "j",
    "AE": "Æ", "OE": "Œ", "O": "Ø", "AA": "Å", "L": "Ł", "SS": "SS",
}
# Commands that leave a blank, and font switches that leave nothing.
BLANKS = frozenset("quad qquad enspace thinspace space par newline linebreak item hfill hline noindent newpage clearpage centering maketitle and ldots dots".split())
SWITCHES = frozenset("em it bf sc sl tt rm sf itshape bfseries scshape slshape ttfamily rmfamily sffamily mdseries upshape normalfont tiny scriptsize footnotesize small normalsize large Large LARGE huge Huge".split())

_ACCENT = re.compile(r"""\\(?:(["'`^~=.])\s*|([uvHcrkd])(?:\s+|(?=\{)))(?:\{\s*\\?([A-Za-z])\s*\}|\\?([A-Za-z])(?:(?<=\\i|\\j)(?![A-Za-z])\s*)?)""")
_LETTER = re.compile(r"\\(ss|SS|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\}|[ \t]*)")
# what looks like a command or a sign but is none: line breaks, escaped signs
_ESCAPED = re.compile(r"\\(?:\\\*?(?:[ \t]*\[[^\[\]\n]*\])?|[{}%$])")
_SOFT = re.compile("\\\\[-/]|\u00ad")
_COMMENT = re.compile(r"%+([^\n]*)(?:\n[ \t]*)?")  # after escaped signs are gone
_DEF = re.compile(
    r"\\(?:(?:re|provide)?newcommand|DeclareRobustCommand|DeclareMathOperator)\*?\s*(?:\{\s*\\([A-Za-z]+)\s*\}|\\([A-Za-z]+))\s*(?:\[(\d)\])?\s*(?:\[([^\]\n]*)\])?\s*(?=\{)"
    r"|\\[gex]?def\s*\\([A-Za-z]+)((?:#\d)*)\s*(?=\{)"
)
_LET = re.compile(r"\\let\s*\\([A-Za-z]+)\s*=?\s*\\([A-Za-z]+)")
_COMMAND = re.compile(r"\\([A-Za-z]+)(\{\}|\\ |\s+)?")
_NAME = re.compile(r"\\([A-Za-z]+)")
_ARGUMENT = re.compile(r"\s*(?:(\\[A-Za-z]+|\\.)|([^\s{}]))", re.S)
_OPTIONAL = re.compile(r"\s*\[([^\]]*)\]")
_BRACE = re.compile(r"[{}]")
_BLANK = re.compile(r"\s*")
_NOTE = re.compile(r"\\(?:footnote|footnotetext|thanks|marginpar|endnote)(?![A-Za-z])\s*(?:\[[^\]]*\])?(?=\{)")
_DOLLARS = re.compile(r"\$\$.*?\$\$", re.S)
_BRACKET, _PAREN, _PARAGRAPH = re.compile(r"\\\["), re.compile(r"\\\("), re.compile(r"\n[ \t]*\n")
_EQUATION = re.compile(r"\\begin\{((?:equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign)\*?)\}")
_DROPPED = re.compile(
    r"\\(?:[A-Za-z]*cite[A-Za-z]*|label|ref|eqref|pageref|cref|Cref|autoref|input|include|includegraphics|bibliographystyle|bibliography|usepackage|documentclass|vspace|hspace|index|pagestyle|graphicspath|newtheorem|setlength|url)\*?"
    r"\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}(?:\{[^{}]*\}(?=\s|$))?"
)
# a formula in the text ends with its paragraph at the latest
_INLINE = re.compile(r"\$((?:[^$\n]|\n(?![ \t]*\n))*+)\$")
_PLAIN_MATH = re.compile(r"(?:[^\W_]|[\s.,:;+-])*+")
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?")
_ANY = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?(\{)?[ \t]*|\\(.)", re.S)
_JOINS = (
    ("-", re.compile(r"-(?<=\w-)(?:[ \t]*\n[ \t]*)?(?=\w)")),
    ("'", re.compile(r"'(?<=\w')(?=\w)")),
)
_RARE_JOINS = re.compile("(?<=\\w)[\u2010\u2011\u2019](?:[ \\t]*\\n[ \\t]*)?(?=\\w)")
_COMBINING = re.compile("[\u0300-\u036f]+")
_NO_WORD = {i: " " for i in range(128) if not chr(i).isalnum()}
_WORD = re.compile(r"[^\W_]+")


def _accent(m: re.Match) -> str:
    letter = m.group(3) or m.group(4)
    return unicodedata.normalize("NFC", letter + MARKS[m.group(1) or m.group(2)])


def _inline(inside: str) -> str:
    return inside if _PLAIN_MATH.fullmatch(inside) else " "


def _any(m: re.Match) -> str:
    name = m.group(1)
    if name is None:
        ch = m.group(3)
        return ch if ch in "%&#" else " "
    if name in BLANKS:
        return " "
    return "" if m.group(2) or name in SWITCHES else " "


class Groups:
    """Where each group of a text ends: looked for from its opening over NEAR braces; where that is not
    enough, all groups are found in one pass, so that the time stays in proportion to the text."""

    def __init__(self, text: str):
        self.text = text
        self.ends: dict[int, int] | None = None

    def end(self, at: int) -> int:
        """Of the group that opens at ``at``; -1 where it is never closed."""
        if self.ends is None:
            depth = 0
            for k, m in enumerate(_BRACE.finditer(self.text, at)):
                depth += 1 if m.group() == "{" else -1
                if depth <= 0:
                    return m.start() if k else -1
                if k == NEAR:
                    break
            self.ends, opened = {}, []
            for m in _BRACE.finditer(self.text):
                if m.group() == "{":
                    opened.append(m.start())
                elif opened:
                    self.ends[opened.pop()] = m.start()
        return self.ends.get(at, -1)


def cut_groups(text: str, head: re.Pattern) -> tuple[str, list[tuple[re.Match, str]]]:
    """(text without the places where ``head`` and a group follow each other, each place's body). A
    group that is never closed stays as it is."""
    out, found, at, groups = [], [], 0, Groups(text)
    for m in head.finditer(text):
        if m.start() < at:
            continue  # inside a place cut already
        end = groups.end(m.end())
        if end < 0:
            continue
        out.append(text[at : m.start()])
        found.append((m, text[m.end() + 1 : end]))
        at = end + 1
    return "".join([*out, text[at:]]) if found else text, found


class _Next:
    """The next place of a text or pattern; asked for with rising positions, it reads the text once."""

    def __init__(self, text: str, what: str | re.Pattern):
        self.text, self.what, self.at, self.end = text, what, -1, False

    def after(self, at: int) -> int:
        """len(text) + 1 where there is none."""
        if self.at < at and not self.end:
            if isinstance(self.what, str):
                self.at = self.text.find(self.what, at)
            else:
                m = self.what.search(self.text, at)
                self.at = m.start() if m else -1
            self.end = self.at < 0
        return len(self.text) + 1 if self.end else self.at


def between(text: str, opening: re.Pattern, closing, instead=lambda inside: " ", limit: re.Pattern | None = None) -> str:
    """Everything from ``opening`` to the literal ``closing(match)`` replaced by ``instead(inside)``; what
    is not closed, or not before ``limit``, stays."""
    out, at, closers = [], 0, {}
    stop = _Next(text, limit) if limit is not None else None
    for m in opening.finditer(text):
        if m.start() < at:
            continue
        literal = closing(m)
        closer = closers.setdefault(literal, _Next(text, literal))
        end = closer.after(m.end())
        if end > len(text) or (stop is not None and stop.after(m.end()) < end):
            continue
        out += [text[at : m.start()], instead(text[m.end() : end])]
        at = end + len(literal)
    return "".join([*out, text[at:]]) if out else text


def _ending(m: re.Match) -> str:
    return f"\\end{{{m.group(1)}}}"


class Macros:
    """The document's own macros: name -> (place, number of arguments, default of the first, body)."""

    def __init__(self, text: str):
        """``plain``: the text without the definitions; places are in it."""
        self.known: dict[str, list[tuple[int, int, str | None, str]]] = {}
        self.bodies: list[str] = []
        self.plain = text
        if "\\newcommand" not in text and "def\\" not in text and "\\let" not in text and "def \\" not in text and "command" not in text and "Operator" not in text:
            return
        out, at, shift, groups = [], 0, 0, Groups(text)
        for m in _DEF.finditer(text):
            if m.start() < at or (end := groups.end(m.end())) < 0:
                continue
            out.append(text[at : m.start()])
            body = text[m.end() + 1 : end]
            name = m.group(1) or m.group(2) or m.group(5)
            count = len(m.group(6)) // 2 if m.group(5) else int(m.group(3) or 0)
            self.known.setdefault(name, []).append((m.start() - shift, count, m.group(4) if count else None, body))
            self.bodies.append(body)
            out.append(" ")
            shift += end + 1 - m.start() - 1
            at = end + 1
        text = "".join([*out, text[at:]])
        for m in _LET.finditer(text):
            target = self.known.get(m.group(2))
            count, default, body = target[-1][1:] if target else (0, None, m.group(2) and "\\" + m.group(2))
            self.known.setdefault(m.group(1), []).append((m.start(), count, default, body))
        self.plain = _LET.sub(lambda m: " " * len(m.group()), text)
        for ds in self.known.values():
            ds.sort(key=lambda d: d[0])
        self._break_cycles()

    def _break_cycles(self) -> None:
        """A macro that needs itself can never be typeset: such uses are taken out of the bodies."""
        uses = {n: {u for d in ds for u in _NAME.findall(d[3]) if u in self.known} for n, ds in self.known.items()}
        users: dict[str, list[str]] = {}
        for n, us in uses.items():
            for u in us:
                users.setdefault(u, []).append(n)
        waiting = {n: len(us) for n, us in uses.items()}
        settled = [n for n, k in waiting.items() if not k]
        for n in settled:  # grows: macros that only need settled ones
            for u in users.get(n, ()):
                waiting[u] -= 1
                if not waiting[u]:
                    settled.append(u)
        for n in [n for n, k in waiting.items() if k]:
            own, todo = set(), [n]
            while todo:  # who needs n, over unsettled ones
                v = todo.pop()
                for u in users.get(v, ()):
                    if u not in own:
                        own.add(u)
                        todo.append(u)
            if n in own:
                self.known[n] = [(*d[:3], _COMMAND.sub(lambda m, own=own: " " if m.group(1) in own else m.group(), d[3])) for d in self.known[n]]

    def _definition(self, name: str, place: int) -> tuple[int, str | None, str] | None:
        ds = self.known.get(name)
        if ds is None:
            return None
        if len(ds) == 1:
            return ds[0][1:]
        return ds[max(bisect_right(ds, place, key=lambda d: d[0]) - 1, 0)][1:]  # before all: the first

    def expanded(self, text: str, place: int | None = None) -> str:
        """Every use replaced by its body, to any depth, with all its arguments. A use takes the last
        definition before it; ``place``: where the text stands in the document, None for ``plain``."""
        if not self.known:
            return text
        out: list[str] = []
        stack, room = [(text, 0, place, Groups(text))], len(text) + MAX_ADDED
        while stack:
            s, at, where, groups = stack.pop()
            found = None
            for m in _COMMAND.finditer(s, at):
                found = self._definition(m.group(1), m.start() if where is None else where)
                if found is not None:
                    break
            if found is None:
                out.append(s[at:])
                continue
            out.append(s[at : m.start()])
            count, default, body = found
            end, args, after = m.end(), [], m.group(2)
            if count:
                end = m.end(1)
                if default is not None:
                    o = _OPTIONAL.match(s, end)
                    args.append(o.group(1) if o else default)
                    end = o.end() if o else end
                while len(args) < count:
                    a = _ARGUMENT.match(s, end)
                    if a:
                        args.append(a.group(1) or a.group(2))
                        end = a.end()
                        continue
                    opens = _BLANK.match(s, end).end()
                    close = groups.end(opens)
                    if close < 0:
                        args.append("")
                        continue
                    args.append(s[opens + 1 : close])
                    end = close + 1
                for k in range(count, 0, -1):
                    body = body.replace(f"#{k}", args[k - 1])
            elif after and after != "{}":
                body += " "
            room -= len(body)
            stack.append((s, end, where, groups))
            if room > 0:
                stack.append((body, 0, m.start() if where is None else where, Groups(body)))
        return "".join(out)


def _typeset(text: str) -> str:
    if "$" in text or "\\" in text:
        if "$$" in text:
            text = _DOLLARS.sub(" ", text)
        if "\\[" in text:
            text = between(text, _BRACKET, lambda m: "\\]")
        if "\\begin{" in text:
            text = between(text, _EQUATION, _ending)
        text = _DROPPED.sub(" ", text)
        text = _INLINE.sub(lambda m: _inline(m.group(1)), text)
        if "\\(" in text:  # ends with its paragraph at the latest
            text = between(text, _PAREN, lambda m: "\\)", _inline, _PARAGRAPH)
        text = _ENVIRONMENT.sub(" ", text)
        text = _ANY.sub(_any, text)
    text = text.replace("{", "").replace("}", "").replace("~", " ")
    for sign, pattern in _JOINS:
        if sign in text:
            text = pattern.sub("", text)
    return text if text.isascii() else _RARE_JOINS.sub("", text)


def _prepared(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\\" in text:
        text = _ESCAPED.sub(" ", text)
        text = _LETTER.sub(lambda m: LETTERS[m.group(1)], _ACCENT.sub(_accent, text))
    return _SOFT.sub("", text)


def words(text: str) -> list[str]:
    """Words of typeset text: case folded, without marks."""
    if text.isascii():
        return text.lower().translate(_NO_WORD).split()
    text = _COMBINING.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return _WORD.findall(text)


def reading_streams(text: str) -> list[list[str]]:
    """Word streams of a whole text: the running text without notes and comments first, then notes,
    comments and macro bodies each in a stream of its own."""
    text = _prepared(text)
    comments: list[str] = []

    def comment(m: re.Match) -> str:
        comments.append(m.group(1))
        return ""

    if "%" in text:
        text = _COMMENT.sub(comment, text)
    parts: list[str] = []
    if "\\" in text:
        macros = Macros(text)
        text, notes = cut_groups(macros.expanded(macros.plain), _NOTE)
        parts += [n for _, n in notes]
        if comments:
            said, notes = cut_groups(macros.expanded("\n".join(comments), len(text)), _NOTE)
            parts += [said, *[n for _, n in notes]]
        parts += [macros.expanded(b, len(text)) for b in macros.bodies if len(b) >= SHORTEST_BODY]
    elif comments:
        parts.append("\n".join(comments))
    return [s for s in [words(_typeset(text)), *[words(_typeset(p)) for p in parts]] if s]


_BIBLIOGRAPHY = re.compile(r"\\begin\{thebibliography\}|\\bibliography\s*\{|\\printbibliography|\\end\{document\}")
_FLOATS = re.compile(r"\\begin\{((?:verbatim|lstlisting|tabular|tikzpicture)\*?)\}")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n\s*\n")


def prose_sentences(text: str) -> list[list[str]]:
    """Words of each sentence of the running prose: no preamble, comments, bibliography, notes,
    formulas, tables or listings. A main file without a body has none; a text without any preamble
    is prose from its start."""
    text = _prepared(text)
    if "%" in text:
        text = _COMMENT.sub("", text)
    if "\\" in text:
        macros = Macros(text)
        text = macros.expanded(macros.plain)
        at = text.find("\\begin{document}")
        if at >= 0:
            text = text[at + 16 :]
        elif "\\documentclass" in text:
            return []
        cut = _BIBLIOGRAPHY.search(text)
        if cut:
            text = text[: cut.start()]
        text, _ = cut_groups(between(text, _FLOATS, _ending), _NOTE)
    return [w for s in _SENTENCE.split(_typeset(text)) if (w := words(s))]
