"""A query string, with AND, OR, NOT, + and -, groups, fields, phrases, edits, wildcards, patterns and ranges, as operators."""

from __future__ import annotations

import re

LEXEMES = re.compile(r"""\s*(?:(?P<phrase>"(?:\\.|[^"])*"(?:~\d+)?)|(?P<regex>/(?:\\.|[^/])+/)|(?P<range>[\[{]\S+\s+TO\s+\S+[\]}])|(?P<mark>[()+!-])|(?P<field>[\w.*]+:)|(?P<word>(?:\\.|[^\s()"])+))""")


def _lexemes(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = LEXEMES.match(query, at)
        if not m:
            raise ValueError(f"cannot read the query at {at}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


def _number(x: str):
    try:
        return int(x)
    except ValueError:
        try:
            return float(x)
        except ValueError:
            return x


class _Reader:
    def __init__(self, lexemes, path):
        self.left, self.path = lexemes, path

    def peek(self):
        return self.left[0] if self.left else (None, None)

    def group(self, path: str) -> dict:
        """Clauses up to a closing mark: required, forbidden and optional ones."""
        must, never, should = [], [], []
        joined = False
        while self.left and self.peek() != ("mark", ")"):
            kind, text = self.peek()
            if kind == "word" and text in ("AND", "&&"):
                self.left.pop(0)
                if should and not joined:
                    must.append(should.pop())
                joined = True
                continue
            if kind == "word" and text in ("OR", "||"):
                self.left.pop(0)
                joined = False
                continue
            sign = None
            if (kind == "mark" and text in "+-!") or (kind == "word" and text == "NOT"):
                self.left.pop(0)
                sign = "+" if text == "+" else "-"
            clause = self.clause(path)
            (never if sign == "-" else must if sign == "+" or joined else should).append(clause)
            joined = False
        if len(should) == 1 and not must and not never:
            return should[0]
        spec = {k: v for k, v in (("must", must), ("mustNot", never), ("should", should)) if v}
        if not spec:
            raise ValueError("an empty group")
        return {"compound": spec}

    def clause(self, path: str) -> dict:
        if not self.left:
            raise ValueError("a clause is missing")
        kind, text = self.left.pop(0)
        if kind == "field":
            if text == "*:" and self.peek() == ("word", "*"):
                self.left.pop(0)
                return {"allDocuments": {}}
            if text.startswith("$"):
                raise ValueError(f"reserved field {text}")
            return self.clause(text[:-1])
        if kind == "mark" and text == "(":
            inner = self.group(path)
            if not self.left:
                raise ValueError("a group is not closed")
            self.left.pop(0)
            return inner
        if kind == "phrase":
            body, _, slop = text.rpartition('"')
            return {"phrase": {"path": path, "query": body[1:], "slop": int(slop[1:] or 0) if slop else 0}}
        if kind == "regex":
            return {"regex": {"path": path, "query": text[1:-1], "allowAnalyzedField": True}}
        if kind == "range":
            low, high = re.split(r"\s+TO\s+", text[1:-1])
            bounds = {}
            if low != "*":
                bounds["gte" if text[0] == "[" else "gt"] = _number(low)
            if high != "*":
                bounds["lte" if text[-1] == "]" else "lt"] = _number(high)
            return {"range": {"path": path, **bounds}} if bounds else {"exists": {"path": path}}
        if kind == "word":
            fuzzy = re.fullmatch(r"(.+)~(\d?)", text)
            if fuzzy:
                return {"text": {"path": path, "query": fuzzy[1], "fuzzy": {"maxEdits": int(fuzzy[2] or 2)}}}
            if re.search(r"(?<!\\)[*?]", text):
                return {"wildcard": {"path": path, "query": text.lower(), "allowAnalyzedField": True}}
            return {"text": {"path": path, "query": text}}
        raise ValueError(f"unexpected {text}")


def parse(query: str, path: str) -> dict:
    reader = _Reader(_lexemes(query), path)
    out = reader.group(path)
    if reader.left:
        raise ValueError("a group is closed that was not opened")
    return out
