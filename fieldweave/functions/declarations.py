"""Interface definitions as rows: files, messages, fields, enums and services.

`compat` reads line by line with the patterns below, quirks included: a block is the lines between those of its braces, comments that hold
an assignment are fields, block comments aren't known. `strict` reads tokens and has none of these quirks. Both give the
same rows for files in the usual layout.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from fieldweave.schemas import DECLARATION

# The patterns of compat mode.
SYNTAX = re.compile(r'syntax\s*=\s*"(proto[23])"\s*;')
PACKAGE = re.compile(r"package\s+([\w.]+)\s*;")
IMPORT = re.compile(r'import\s+"([^"]+)"\s*;')
HEADER = {kind: re.compile(kind + r"\s+(\w+)\s*\{") for kind in ("message", "enum", "service", "oneof")}
RPC = re.compile(r"rpc\s+(\w+)\s*\(\s*([\w.]+)\s*\)\s*returns\s*\(\s*([\w.]+)\s*\)")
VALUE = re.compile(r"(\w+)\s*=\s*(-?\d+)")
FIELD = re.compile(r"(required|optional|repeated)?\s*([\w.]+)\s+(\w+)\s*=\s*(\d+)")
MAP = re.compile(r"(required|optional|repeated)?\s*map\s*<\s*([\w.]+)\s*,\s*([\w.]+)\s*>\s+(\w+)\s*=\s*(\d+)")
OPTION = re.compile(r"option\s+")
LARGEST = 2**63 - 1


class _Rows:
    """Collects the rows of one file."""

    def __init__(self):
        self.found: list[dict] = []
        self.messages = 0

    def message(self, name, parents, comment):
        self.found.append({"kind": "message", "msg_ord": self.messages, "parents": parents, "message_name": name, "name": name, "comment": comment, "ord": 0})
        self.messages += 1
        return {"ord": self.messages - 1, "name": name, "parents": parents, "fields": 0}

    def field(self, owner, name, kind, number, label, comment):
        number = int(number)
        self.found.append({"kind": "field", "msg_ord": owner["ord"], "parents": owner["parents"], "message_name": owner["name"], "ord": owner["fields"], "name": name, "type": kind, "number": number if number <= LARGEST else None, "label": label, "comment": comment})
        owner["fields"] += 1

    def enum(self, owner, name, values, comment=""):
        self.found.append({"kind": "enum", "msg_ord": owner["ord"] if owner else None, "message_name": owner["name"] if owner else None, "parents": owner["parents"] if owner else [], "name": name, "values": values, "comment": comment, "ord": len(self.found)})

    def service(self, name, rpcs):
        self.found.append({"kind": "service", "parents": [], "name": name, "rpcs": rpcs, "ord": len(self.found)})


def _number(text: str) -> int | None:
    return n if abs(n := int(text)) <= LARGEST else None


class _Layout:
    """The lines of a file and how deep in braces each stands, summed up once."""

    def __init__(self, text: str):
        self.raw = text.splitlines()
        self.bare = [x.strip() for x in self.raw]
        self.depth = list(accumulate((x.count("{") - x.count("}") for x in self.raw), initial=0))
        self.reaching: dict[int, list[int]] = {}  # depth -> the lines after which it holds
        for line, depth in enumerate(self.depth[1:]):
            self.reaching.setdefault(depth, []).append(line)

    def last_of(self, head: int, end: int) -> int:
        """The line that ends the block whose header is line `head`: the first one from there after which the depth is what it was before.

        A block that stays open takes all lines before `end` but the last.
        """
        ends = self.reaching.get(self.depth[head], [])
        i = bisect_left(ends, head)
        return ends[i] if i < len(ends) and ends[i] < end else end - 1

    def first(self, pattern: re.Pattern, default: str) -> str:
        return next((m[1] for x in self.raw if (m := pattern.search(x))), default)


# What a line can be, tried in this order; at the top of a file, and inside a message.
AT_TOP = [(kind, HEADER[kind]) for kind in ("message", "enum", "service")]
IN_MESSAGE = [*((kind, HEADER[kind]) for kind in ("message", "enum", "oneof")), ("map", MAP), ("field", FIELD)]


def _kind_of(line: str, inside: bool) -> tuple[str, re.Match | None]:
    """What a line is, with its match. `note`: a comment on what follows; `void`: cuts a comment off; `pass`: leaves it waiting."""
    if inside and (not line or line == "}" or OPTION.match(line)):
        return "pass", None
    if line.startswith("//"):
        if not inside:
            return ("void" if HEADER["message"].search(line) else "note"), None
        if "=" not in line:
            return "note", None
    found = ((kind, m) for kind, pattern in (IN_MESSAGE if inside else AT_TOP) if (m := pattern.search(line)))
    return next(found, ("pass" if inside else "void", None))


def _as_field(kind: str, m: re.Match) -> tuple[str, str, str, str]:
    """name, type, number, label."""
    return (m[4], f"map<{m[2]}, {m[3]}>", m[5], m[1] or "optional") if kind == "map" else (m[3], m[2], m[4], m[1] or "optional")


def read_lines(text: str) -> tuple[str, str, list[str], list[dict]]:
    """Compat mode: (syntax, package, imports, rows).

    One walk down the lines. `open_` holds the last line and the message of every message the walk is in; other blocks are read where
    they begin, and the walk goes on after them.
    """
    file, rows = _Layout(text), _Rows()
    open_: list[tuple[int, dict | None]] = [(len(file.bare), None)]
    at, waiting = 0, ""
    while at < len(file.bare):
        end, owner = open_[-1]
        if at >= end:
            open_.pop()
            at, waiting = end + 1, ""
            continue
        line = file.bare[at]
        kind, m = _kind_of(line, owner is not None)
        last = file.last_of(at, end) if kind in HEADER else at
        block = file.bare[at + 1 : last] if kind != "message" else []
        behind = line.partition("//")[2].strip()
        if kind == "note":
            waiting = line.lstrip("/ ").strip()
        elif kind == "message":
            open_.append((last, rows.message(m[1], [*owner["parents"], m[1]] if owner else [], waiting)))
            last = at
        elif kind == "enum":
            said = (VALUE.match(x) for x in block if not x.startswith("//") and not OPTION.match(x))
            rows.enum(owner, m[1], [(v[1], _number(v[2])) for v in said if v], "" if owner else waiting)
        elif kind == "service":
            rows.service(m[1], [v.groups() for v in map(RPC.search, block) if v])
        elif kind == "oneof":
            for choice in block:
                if v := FIELD.search(choice):
                    rows.field(owner, *_as_field("field", v)[:3], "optional", choice.partition("//")[2].strip() or waiting)
                    waiting = ""
        elif kind in ("map", "field"):
            rows.field(owner, *_as_field(kind, m), behind or waiting)
        if kind not in ("note", "pass", "oneof"):
            waiting = ""
        at = last + 1
    return file.first(SYNTAX, "proto2"), file.first(PACKAGE, ""), [m[1] for x in file.raw if (m := IMPORT.search(x))], rows.found


TOKEN = re.compile(r'(?P<note>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<text>"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|(?P<word>[.\w]+)|(?P<mark>[^\s\w])', re.S)


class _Tokens:
    """Tokens with their lines, and the comments that stand before and behind a declaration."""

    def __init__(self, text: str):
        self.items: list[tuple[str, int]] = []
        self.notes: dict[int, str] = {}  # by line
        line, at = 1, 0
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        for m in TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if m["note"] is not None or m["block"] is not None:
                body = m[0].lstrip("/ ") if m["note"] is not None else " ".join(x.strip().lstrip("*").strip() for x in m[0][2:].removesuffix("*/").splitlines())
                self.notes[line + m[0].count("\n")] = body.strip()
            else:
                self.items.append((m[0], line))
        self.code = {n for _, n in self.items}
        self.found: dict[int, str] = {}
        self.at = 0

    def peek(self, n=0):
        return self.items[self.at + n][0] if self.at + n < len(self.items) else ""

    def line(self):
        return self.items[min(self.at, len(self.items) - 1)][1] if self.items else 0

    def next(self):
        self.at += 1
        return self.items[self.at - 1][0] if self.at <= len(self.items) else ""

    def statement(self) -> list[str]:
        """Tokens up to `;`, or up to a block's brace, which stays; braces inside brackets and option values are part of it."""
        out, depth = [], 0
        while (t := self.peek()) and not (depth == 0 and t in (";", "{", "}")):
            depth += (t in "[(<") - (t in "])>")
            out.append(self.next())
        return out

    def skip_block(self):
        depth = 0
        while t := self.next():
            depth += (t == "{") - (t == "}")
            if depth == 0:
                return

    def before(self, line):
        """The comment on the nearest line above that holds one, with only comments and blank lines between."""
        if line not in self.found:
            n = line - 1
            while n > 0 and n not in self.code and n not in self.notes:
                n -= 1
            self.found[line] = self.notes.get(n, "") if n not in self.code else ""
        return self.found[line]


def read_tokens(text: str) -> tuple[str, str, list[str], list[dict]]:
    """Strict mode: (syntax, package, imports, rows)."""
    t, rows = _Tokens(text), _Rows()
    head = {"syntax": "proto2", "package": "", "imports": []}
    # A frame is an open block: its message or None, and what it is.
    frames: list[tuple[dict | None, str]] = [(None, "file")]
    while t.at < len(t.items):
        owner, kind = frames[-1]
        start, word = t.line(), t.peek()
        if word in ("}", ";"):
            t.next()
            if word == "}" and len(frames) > 1:
                frames.pop()
            continue
        said = t.statement()
        opens = t.peek() == "{"
        note = t.notes.get(t.line(), "") if not opens and t.line() else ""
        note = note or t.before(start)
        if opens and said[:1] in (["message"], ["oneof"], ["extend"], ["service"], ["enum"]) and len(said) > 1:
            name = said[1]
            if said[0] == "enum":
                rows.enum(owner, name, _enum_block(t), t.before(start))
            elif said[0] == "service":
                rows.service(name, _service_block(t))
            elif said[0] == "extend":
                t.skip_block()  # fields of another message
            else:
                t.next()
                if said[0] == "message":
                    frames.append((rows.message(name, [*owner["parents"], name] if owner else [], t.before(start)), "message"))
                else:
                    frames.append((owner, "oneof"))
        elif opens:
            _group(rows, owner, kind, said, note)
            t.skip_block()
        elif said[:1] == ["syntax"] and len(said) > 2:
            head["syntax"] = said[2].strip("\"'")
        elif said[:1] == ["package"] and len(said) > 1 and owner is None:
            head["package"] = said[1]
        elif said[:1] == ["import"] and said[-1][:1] in "\"'":
            head["imports"].append(said[-1].strip("\"'"))
        elif owner is not None:
            _field(rows, owner, kind, said, note)
    return head["syntax"], head["package"], head["imports"], rows.found


def _field(rows, owner, kind, said, note):
    if said[:1] and said[0] in ("option", "reserved", "extensions") and (len(said) < 3 or said[2] != "="):
        return
    label = "optional"
    if said and said[0] in ("required", "optional", "repeated") and len(said) > 3 and said[1] != "=":
        label, said = said[0], said[1:]
    if kind == "oneof":
        label = "optional"
    if said[:2] == ["map", "<"] and ">" in said:
        end = said.index(">")
        parts = "".join(said[2:end]).split(",")
        kind_, said = f"map<{', '.join(parts)}>", ["", *said[end + 1 :]]
    else:
        kind_ = said[0] if said else ""
    if len(said) > 3 and said[2] == "=" and said[3].isdigit():
        rows.field(owner, said[1], kind_, said[3], label, note)


def _group(rows, owner, kind, said, note):
    """A group is a field whose type is declared with it; its own fields don't belong to the message around it."""
    if owner is not None and "group" in said[:2]:
        label = said[0] if said[0] != "group" and kind != "oneof" else "optional"
        rest = said[said.index("group") + 1 :]
        if len(rest) > 2 and rest[1] == "=" and rest[2].isdigit():
            rows.field(owner, rest[0].lower(), rest[0], rest[2], label, note)


def _enum_block(t):
    t.next()
    values = []
    while t.peek() and t.peek() != "}":
        said = t.statement()
        if t.peek() == "{":
            t.skip_block()
        elif t.peek() == ";":
            t.next()
        text = "".join(said[2:4])
        if len(said) > 2 and said[1] == "=" and said[0] != "option" and re.fullmatch(r"-?\d+", re.sub(r"\[.*", "", text)):
            values.append((said[0], _number(re.sub(r"\[.*", "", text))))
    t.next()
    return values


def _service_block(t):
    t.next()
    rpcs = []
    while t.peek() and t.peek() != "}":
        said = [x for x in t.statement() if x != "stream"]
        if t.peek() == "{":
            t.skip_block()
        elif t.peek() == ";":
            t.next()
        if said[:1] == ["rpc"] and len(said) > 8 and "returns" in said:
            rpcs.append((said[1], said[3], said[said.index("returns") + 2]))
    t.next()
    return rpcs


MODES = {"compat": read_lines, "strict": read_tokens}
_FIELDS = [x.split()[0].strip("`") for x in re.split(r", ?(?![^<]*>)", DECLARATION)]


def declarations_of(order: int, path: str, text: str, mode: str = "compat") -> Iterator[tuple]:
    """The rows of one file; the first stands for the file itself."""
    syntax, package, imports, found = MODES[mode](text)
    for row in [{"kind": "file", "parents": []}, *found]:
        row = {"file_ord": order, "file_path": path, "syntax": syntax, "package": package, "imports": imports} | row
        yield tuple(row.get(name) for name in _FIELDS)


def parse(files: DataFrame, mode: str = "compat") -> DataFrame:
    """Declarations of all files. A file that can't be read or parsed has one row of kind `file` with `error`, and no others."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for order, path, text, error in pdf.itertuples(index=False):
                try:
                    if error is not None and error == error:
                        raise ValueError(error)
                    out += declarations_of(order, path, text, mode)
                except Exception as e:
                    row = {"file_ord": order, "file_path": path, "kind": "file", "error": str(e)}
                    out.append(tuple(row.get(name) for name in _FIELDS))
            frame = pd.DataFrame(out, columns=_FIELDS)
            for c in ("msg_ord", "ord", "number"):
                frame[c] = frame[c].astype("Int64")
            for c in ("values", "rpcs"):
                names = ("name", "number") if c == "values" else ("name", "request_type", "response_type")
                frame[c] = [[dict(zip(names, v, strict=True)) for v in x] if isinstance(x, list) else None for x in frame[c]]
            yield frame

    return files.select("file_ord", "file_path", "content", "error").mapInPandas(run, DECLARATION)
