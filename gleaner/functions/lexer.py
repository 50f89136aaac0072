"""Lexical tokens of a script source: a pushdown automaton over one string.

A stack of modes says what the next sign may begin: text outside tags, code, a string in double quotes, a heredoc
or nowdoc, back-ticks, and inside those an index, a property or the name after ``${``. ``{$`` and ``${`` push code,
and so does an opening brace in code; a closing brace pops, so strings nest in strings to any depth. Each step
reads on from where the last one ended, so the work grows with the text.

Text outside tags is one token, and so is a comment, and a string without variables with its quotes. ``naming``
says how names of namespaces count: 8 takes ``\\system`` as one token, 7 as ``\\`` and ``system`` (and ``#[`` as a
comment, and no ``?->``). An unclosed string in double quotes or back-ticks gives its sign and the rest as text;
an unclosed comment or string in single quotes is one token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_LABEL = r"[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*"
_MORE = r"[A-Za-z0-9_\x80-\U0010ffff]"
# Casts and operators, the longest first.
_CASTS = r"\([ \t]*(?:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)[ \t]*\)"
_OPERATORS = ["<<<", "===", "!==", "<=>", "**=", "...", "<<=", ">>=", "??=", "?->", "==", "!=", "<>", "<=", ">=", "&&", "||", "??", "++", "--", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "->", "=>", "::", "<<", ">>", "**"]

TEXT, CODE, DOUBLE, SHELL, HEREDOC, NOWDOC, INDEX, MEMBER, NAME_OF = range(9)

_OPEN = re.compile(r"<\?(?:php(?=[ \t\r\n]|\Z)|=)", re.I)
#: Signs of a string that begin nothing: up to its end sign, a variable, ``{$`` or ``${``.
_PLAIN = r"(?:[^{end}\\${{]|\\.|\$(?![A-Za-z_\x80-\U0010ffff{{])|\{{(?!\$)|\\\Z)"
_WHOLE = re.compile(r"[bB]?\"" + _PLAIN.format(end='"') + r"*+\"", re.S)
_INSIDE = {
    DOUBLE: re.compile(_PLAIN.format(end='"') + "++", re.S),
    SHELL: re.compile(_PLAIN.format(end="`") + "++", re.S),
    # a line of a heredoc at a time, as its end may begin the next
    HEREDOC: re.compile(r"(?:[^\n\\${]|\\[^\n]|\\(?=\n|\Z)|\$(?![A-Za-z_\x80-\U0010ffff{])|\{(?!\$))*+\n?", re.S),
}
_ENDS = {DOUBLE: '"', SHELL: "`"}
_VARIABLE = re.compile(r"\$" + _LABEL)
_MEMBER_OF = {7: re.compile(r"->(?=[A-Za-z_\x80-\U0010ffff])"), 8: re.compile(r"\??->(?=[A-Za-z_\x80-\U0010ffff])")}
_NAMED = re.compile(_LABEL + r"(?=[\[}])")
_INDEX = re.compile(r"\$?" + _LABEL + r"|0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+|[^\s\\'#]")
_HEREDOC_START = re.compile(r"[bB]?<<<[ \t]*(?P<quote>[\"']?)(?P<label>" + _LABEL + r")(?P=quote)(?:\r?\n|\r)")


def _code(naming: int) -> re.Pattern:
    names = r"\\?" + _LABEL + r"(?:\\" + _LABEL + r")*" if naming >= 8 else _LABEL
    operators = [o for o in _OPERATORS if naming >= 8 or o != "?->"]
    attribute = r"(?P<attribute>\#\[)|" if naming >= 8 else ""
    return re.compile(
        r"(?P<space>[ \t\r\n]+)|(?P<close>\?>(?:\r?\n|\r)?)|" + attribute + r"(?P<line>(?:\#|//)(?:[^?\r\n]|\?(?!>))*+)|(?P<block>/\*.*?(?:\*/|\Z))"
        r"|(?P<heredoc>[bB]?<<<(?=[ \t]*[\"']?[A-Za-z_\x80-\U0010ffff]))|(?P<single>[bB]?'(?:[^'\\]++|\\.|\\\Z)*+(?:'|\Z))|(?P<double>[bB]?\")|(?P<shell>`)"
        r"|(?P<from>yield[ \t\r\n]+from(?!" + _MORE + r"))|(?P<variable>\$" + _LABEL + r")|(?P<name>" + names + r")"
        r"|(?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?)"
        r"|(?P<cast>" + _CASTS + r")|(?P<brace>[{}])|(?P<operator>" + "|".join(map(re.escape, operators)) + r")|(?P<other>.)",
        re.S | re.I,
    )


_CODE = {7: _code(7), 8: _code(8)}


def _end_of(label: str) -> re.Pattern:
    return re.compile(r"[ \t]*" + label + r"(?!" + _MORE + r")")


def scan(source: str, naming: int = 8) -> Iterator[str]:
    """All tokens in order; joined they are the source."""
    naming = 8 if naming >= 8 else 7
    code, member = _CODE[naming], _MEMBER_OF[naming]
    modes: list[int] = [TEXT]
    labels: list[re.Pattern] = []  # of the heredocs that are open
    at, size, halting = 0, len(source), 0
    fresh = False  # whether a heredoc's line begins here
    while at < size:
        mode = modes[-1]
        if mode == TEXT:
            opened = _OPEN.search(source, at)
            if opened is None:
                yield source[at:]
                return
            if opened.start() > at:
                yield source[at : opened.start()]
            yield opened[0]
            at, halting = opened.end(), 0
            modes[-1] = CODE
        elif mode == CODE:
            m = code.match(source, at)
            kind, text = m.lastgroup, m[0]
            if kind == "double":
                whole = _WHOLE.match(source, at)
                if whole is None:
                    modes.append(DOUBLE)
                else:
                    text = whole[0]
            elif kind == "shell":
                modes.append(SHELL)
            elif kind == "heredoc":
                start = _HEREDOC_START.match(source, at)
                if start is None:
                    text = text.lstrip("bB") or text  # an operator, with a name before it if there was a b
                    text = source[at : at + 3] if source[at] == "<" else source[at]
                else:
                    text, fresh = start[0], True
                    labels.append(_end_of(start["label"]))
                    modes.append(NOWDOC if start["quote"] == "'" else HEREDOC)
            elif kind == "brace":
                if text == "{":
                    modes.append(CODE)
                elif len(modes) > 1:
                    modes.pop()
            elif kind == "close":
                modes[-1] = TEXT
            yield text
            at += len(text)
            # after the halting statement and its end all is text
            if text.lower() == "__halt_compiler":
                halting = 1
            elif halting and text == ("(", ")", ";")[halting - 1] or halting == 3 and kind == "close":
                halting += 1
                if halting == 4:
                    if at < size:
                        yield source[at:]
                    return
            elif kind not in ("space", "line", "block"):
                halting = 0
        elif mode == INDEX:
            m = _INDEX.match(source, at)
            if m is None:
                modes.pop()  # white space ends an index as it ends no name
                continue
            yield m[0]
            at = m.end()
            if m[0] == "]":
                modes.pop()
        elif mode == MEMBER:
            arrow, name = member.match(source, at), None
            if arrow:
                yield arrow[0]
                at = arrow.end()
                name = re.compile(_LABEL).match(source, at)
                yield name[0]
                at = name.end()
            modes.pop()
        elif mode == NAME_OF:
            named = _NAMED.match(source, at)
            if named:
                yield named[0]
                at = named.end()
            modes[-1] = CODE
        elif mode == NOWDOC:
            begin = at
            ended = None
            while at < size:
                ended = labels[-1].match(source, at)
                if ended:
                    break
                line = source.find("\n", at)
                at = size if line < 0 else line + 1
            if at > begin:
                yield source[begin:at]
            if ended:
                yield ended[0]
                at = ended.end()
            labels.pop()
            modes.pop()
        else:  # DOUBLE, SHELL or HEREDOC: text, and what begins in it
            begin, ended = at, None
            while at < size:
                if mode == HEREDOC and fresh and (ended := labels[-1].match(source, at)):
                    break
                m = _INSIDE[mode].match(source, at)
                fresh = mode == HEREDOC and m is not None and m[0].endswith("\n")
                if m is None or m.end() == at:
                    break
                at = m.end()
                if not fresh:
                    break
            if at > begin:
                yield source[begin:at]
            if ended:
                yield ended[0]
                at, fresh = ended.end(), False
                labels.pop()
                modes.pop()
                continue
            if at >= size:
                return
            if fresh:
                continue
            if source[at] == _ENDS.get(mode):
                yield source[at]
                at += 1
                modes.pop()
            elif source.startswith("${", at):
                yield "${"
                at += 2
                modes.append(NAME_OF)
            elif source.startswith("{$", at):
                yield "{"
                at += 1
                modes.append(CODE)
            elif v := _VARIABLE.match(source, at):
                yield v[0]
                at = v.end()
                if source.startswith("[", at):
                    modes.append(INDEX)
                    yield "["
                    at += 1
                elif member.match(source, at):
                    modes.append(MEMBER)
            elif at == begin:  # a sign that nothing takes
                yield source[at]
                at += 1


def lex(source: str, naming: int = 8) -> list[str]:
    return list(scan(source, naming))
