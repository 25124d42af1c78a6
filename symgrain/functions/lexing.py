"""Takes comments, and on request the insides of strings, out of source text; line breaks stay."""

from __future__ import annotations

import re

#: What starts something other than plain code, longest first: a line comment, a block comment, a raw string, a character (not a lifetime), a string.
_OPENING = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<marks>\#*)")"""
    r"""|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x[0-9A-Fa-f]{0,2}|[^ux])|[^\\])')|(?P<string>")""",
    re.S,
)
_BLOCK = re.compile(r"/\*|\*/")
_INSIDE = re.compile(r'(?:\\.|[^"\\])*', re.S)


def _blank(text: str, wanted: bool) -> str:
    return re.sub(r"[^\n]", " ", text) if wanted else text


def strip_comments(source: str, blank_strings: bool) -> str:
    """Without // and nested /* */ comments. Comment marks within strings are none, nor quotes within comments. blank_strings: the insides of strings become spaces."""
    out, at = [], 0
    while found := _OPENING.search(source, at):
        out.append(source[at : found.start()])
        at = found.end()
        if found["block"]:
            depth = 1
            while depth:
                mark = _BLOCK.search(source, at)
                stop = mark.end() if mark else len(source)
                out.append("\n" * source.count("\n", at, stop))
                at = stop
                depth = depth + (1 if mark[0] == "/*" else -1) if mark else 0
        elif found["raw"]:
            close = '"' + found["marks"]
            stop = source.find(close, at)
            body = source[at:] if stop < 0 else source[at:stop]
            out += [found[0], _blank(body, blank_strings), "" if stop < 0 else close]
            at = len(source) if stop < 0 else stop + len(close)
        elif found["string"]:
            body = _INSIDE.match(source, at)[0]
            out += ['"', _blank(body, blank_strings)]
            at += len(body)
            if at < len(source):
                out.append(source[at] if source[at] == '"' else _blank(source[at], blank_strings))
                at += 1
        elif found["char"]:
            out.append(found[0])
    return "".join(out) + source[at:]
