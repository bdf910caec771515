"""Tokens of TypeScript source text."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, template, regex or mark
    text: str
    start: int
    end: int


COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
SPACE = re.compile(r"[\s﻿]+")
NAME = re.compile(r"#?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?")
STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
MARK = re.compile(r"=>|\.\.\.|\?\?=|&&=|\|\|=|\?\?|\?\.(?!\d)|&&|\|\||===|!==|==|!=|<=|\*\*=?|\+\+|--|[+\-*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
#: After these words a slash starts a regular expression.
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}
PAIRS = {")": "(", "]": "[", "}": "{"}


def tokenize(text: str) -> tuple[list[Token], list[Token], dict[int, int]]:
    """Tokens, comments, and for each bracket's index the index of its partner.

    A template literal is a token for each stretch of text and, between them, ``${``, the tokens inside and ``}``.
    """
    tokens: list[Token] = []
    comments: list[Token] = []
    partner: dict[int, int] = {}
    open_at: list[int] = []
    at = 0

    def add(kind: str, end: int) -> None:
        nonlocal at
        tokens.append(Token(kind, text[at:end], at, end))
        at = end

    def template() -> None:
        """From a back quote, or from the end of a substitution, to the next substitution or the end."""
        end = at + 1
        while end < len(text):
            if text[end] == "\\":
                end += 2
                continue
            if text[end] == "`":
                add("template", end + 1)
                return
            if text.startswith("${", end):
                add("template", end)
                open_at.append(len(tokens))
                add("mark", end + 2)
                return
            end += 1
        add("template", len(text))

    while at < len(text):
        if m := SPACE.match(text, at):
            at = m.end()
        elif m := COMMENT.match(text, at):
            comments.append(Token("comment", m[0], at, m.end()))
            at = m.end()
        elif m := NAME.match(text, at):
            add("name", m.end())
        elif text[at].isdigit() or text[at] == "." and text[at + 1 : at + 2].isdigit():
            m = NUMBER.match(text, at)
            add("number", m.end() if m else at + 1)
        elif m := STRING.match(text, at):
            add("string", m.end())
        elif text[at] == "`":
            template()
        else:
            last = tokens[-1] if tokens else None
            free = last is None or last.kind == "mark" and last.text not in (")", "]", "}") or last.kind == "name" and last.text in BEFORE_REGEX
            if text[at] == "/" and free and (m := REGEX.match(text, at)):
                add("regex", m.end())
                continue
            m = MARK.match(text, at)
            mark = m[0] if m else text[at]
            if mark == "}" and open_at and tokens[open_at[-1]].text == "${":
                partner[len(tokens)] = open_at[-1]
                partner[open_at.pop()] = len(tokens)
                tokens.append(Token("mark", "}", at, at + 1))
                template()
                continue
            if mark in ("(", "[", "{"):
                open_at.append(len(tokens))
            elif mark in PAIRS:
                if not open_at or tokens[open_at[-1]].text != PAIRS[mark]:
                    raise SyntaxError(f"unmatched {mark} at {at}")
                partner[len(tokens)] = open_at[-1]
                partner[open_at.pop()] = len(tokens)
            add("mark", at + len(mark))
    if open_at:
        raise SyntaxError(f"unclosed {tokens[open_at[-1]].text} at {tokens[open_at[-1]].start}")
    return tokens, comments, partner
