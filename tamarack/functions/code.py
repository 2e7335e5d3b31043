"""Source code without comments, white space at line ends and runs of empty lines."""

from __future__ import annotations

import re

from tamarack.functions.detect import code_family, looks_like_code

# In each pattern what has to stay comes first, so that a comment's mark inside it is none. A named group that opens and doesn't end makes the scan incomplete.
_C = re.compile(
    r"""(?P<keep>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?:(?<=[=(,:\[!&|?{};\n])|(?<=return))[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"""
    r"""|(?P<gone>//[^\n]*|/\*.*?\*/)|(?P<broken>/\*|"|`)""",
    re.DOTALL,
)
_PYTHON = re.compile(r"""(?P<keep>[\w]*(?:\"\"\".*?(?<!\\)\"\"\"|'''.*?(?<!\\)'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))|(?P<gone>\#[^\n]*)|(?P<broken>\"\"\"|'''|"|')""", re.DOTALL)


def without_comments(text: str, family: str) -> str | None:
    """None where a string or comment doesn't end. A first line ``#!`` stays."""
    head = re.match(r"#![^\n]*\n", text)
    at, out, end = (head.end(), [head[0]], False) if head else (0, [], False)
    for m in (_PYTHON if family == "python" else _C).finditer(text, at):
        if m["broken"]:
            end = True
            break
        out.append(text[at : m.start()] + (m["keep"] or (" " if m["gone"].startswith("/*") and "\n" not in m["gone"] else "\n" * min(1, m["gone"].count("\n")))))
        at = m.end()
    return None if end else "".join([*out, text[at:]])


def compact_code(text: str, family: str | None = None) -> str:
    """Unchanged if it doesn't look like code or can't be scanned to its end. Strings, templates and patterns keep what they hold."""
    if not looks_like_code(text):
        return text
    bare = without_comments(text, family or code_family(text))
    if bare is None:
        return text
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|\Z)", "", bare)).strip("\n")
