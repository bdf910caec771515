"""One source file to flat records: declarations, callables, call sites, variables, imports and what resolution needs.

A small recursive descent over declarations; types and expressions are skipped by balanced brackets. Bodies are walked
once: anonymous callbacks belong to the nearest named callable; named functions, classes and variables that hold a
function are records of their own; nested namespaces inside bodies are left out.
"""

from __future__ import annotations

import bisect
import json
import math
import posixpath
import re
from collections.abc import Iterator

from callweave.sources.lexer import Token, tokenize

MODIFIERS = {"public", "private", "protected", "static", "abstract", "readonly", "async", "declare", "override", "export", "default", "accessor"}
NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "of", "in", "with", "void", "delete", "throw", "case", "yield", "else", "do", "instanceof", "keyof"}
ARRAY_CALLBACKS = {"map", "filter", "forEach", "find", "findIndex", "some", "every", "flatMap", "findLast"}
CONTINUES = {".", "?.", "(", "[", ",", "?", ":", "=", "=>", "&&", "||", "??", "+", "-", "*", "/", "%", "|", "&", "<", ">", "==", "===", "!=", "!=="}
DECISIONS = {"if", "for", "while", "do", "case", "catch", "&&", "||", "??", "?"}


class Parser:
    def __init__(self, file_key: str, text: str):
        self.file, self.text = file_key, text
        self.t, self.comments, self.partner = tokenize(text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.module = re.sub(r"\.(?:tsx|ts|jsx|js|mts|cts|mjs|cjs)$", "", re.sub(r"\.d\.ts$", "", file_key))
        self.ambient = file_key.endswith(".d.ts")
        self.rows: list[tuple[str, dict]] = []
        self.done: set[int] = set()
        self.pending: dict[str, list[dict]] = {}  # signatures without a body that wait for their implementation
        self.top: list[int] = []  # first tokens of the module's own statements

    # --- places -------------------------------------------------------------------------------------------------------
    def at(self, i: int) -> Token:
        return self.t[i] if 0 <= i < len(self.t) else Token("end", "", len(self.text), len(self.text))

    def is_(self, i: int, *texts: str) -> bool:
        return self.at(i).text in texts and self.at(i).kind in ("mark", "name")

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.lines, offset)

    def span(self, i: int, j: int) -> dict:
        """Lines and columns, from 1, of tokens i to j - 1."""
        a, b = self.at(i).start, self.at(max(i, j - 1)).end
        la, lb = self.line(a), self.line(b)
        return {"start_line": la, "start_column": a - self.lines[la - 1] + 1, "end_line": lb, "end_column": b - self.lines[lb - 1] + 1}

    def source(self, i: int, j: int) -> str | None:
        return self.text[self.at(i).start : self.at(j - 1).end] if j > i else None

    def docstring(self, i: int) -> str | None:
        end = self.at(i).start
        found = [c for c in self.comments if c.end <= end and not self.text[c.end : end].strip()]
        return found[-1].text.strip() if found and found[-1].text.startswith("/**") else None

    def emit(self, record: str, **fields) -> None:
        self.rows.append((record, fields))

    # --- skipping -----------------------------------------------------------------------------------------------------
    def past(self, i: int) -> int:
        """Behind token i, or behind its partner if it opens a bracket."""
        return self.partner.get(i, i) + 1 if self.at(i).text in ("(", "[", "{", "${") else i + 1

    def angles(self, i: int) -> int | None:
        """Behind type arguments or parameters that start at i; None if they are none."""
        depth = 0
        while i < len(self.t):
            x = self.at(i)
            if x.text == "<":
                depth += 1
            elif x.text == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif x.text in (";", ")", "}", "]", "&&", "||", "+", "-") or x.kind == "regex":
                return None
            i = self.past(i)
        return None

    def type_end(self, i: int) -> int:
        """Behind a type that starts at i."""
        while True:
            while self.is_(i, "keyof", "typeof", "readonly", "unique", "infer", "asserts", "abstract", "new", "|", "&", "-"):
                i += 1
            if self.is_(i, "<"):
                i = self.angles(i) or i + 1
            list_of_parameters = self.is_(i, "(")
            if self.at(i).kind == "template":
                while self.is_(i + 1, "${"):
                    i = self.past(i + 1)
                i += 1
            else:
                i = self.past(i)
            while True:
                if self.is_(i, "."):
                    i += 2
                elif self.is_(i, "<") and (end := self.angles(i)):
                    i = end
                elif self.is_(i, "[") and "\n" not in self.text[self.at(i - 1).end : self.at(i).start]:
                    i = self.past(i)
                else:
                    break
            if self.is_(i, "|", "&", "is", "extends") or self.is_(i, "=>") and list_of_parameters:
                i += 1
            elif self.is_(i, "?") and not self.is_(i + 1, ":", ",", ")"):
                i = self.type_end(i + 1)
                if self.is_(i, ":"):
                    i += 1
                    continue
                return i
            else:
                return i

    def expression_end(self, i: int, stop: tuple[str, ...] = (",", ";")) -> int:
        """Behind an expression that starts at i: at a stop, a closing bracket, or a line end after which none goes on."""
        first = i
        while i < len(self.t):
            x = self.at(i)
            if x.text in stop or x.text in (")", "]", "}"):
                return i
            if i > first and "\n" in self.text[self.at(i - 1).end : x.start]:
                before = self.at(i - 1)
                ends = before.kind in ("name", "number", "string", "template", "regex") or before.text in (")", "]", "}", "++", "--", ">")
                if ends and before.text not in ("new", "return", "typeof", "await") and not (x.kind == "mark" and x.text in CONTINUES or x.text in ("instanceof", "in", "as", "satisfies") or x.kind == "template" and before.text == "}"):
                    return i
            i = self.past(i)
        return i

    def type_ref(self, i: int, j: int) -> dict:
        """What resolution needs of a type: its text, its name, and whether it is an array of that."""
        text = self.source(i, j)
        name, array = (text or "").strip(), False
        for _ in range(4):
            if m := re.fullmatch(r"(?:Promise|Readonly|Awaited|Partial|Required|NonNullable)<(.*)>", name, re.S):
                name = m[1].strip()
            elif m := re.fullmatch(r"(?:Array|ReadonlyArray|Set|Iterable)<(.*)>", name, re.S):
                name, array = m[1].strip(), True
            elif name.endswith("[]"):
                name, array = name[:-2].strip().removeprefix("readonly "), True
            elif m := re.fullmatch(r"(.*?)\s*\|\s*(?:null|undefined)", name, re.S):
                name = m[1].strip()
        m = re.match(r"[\w$.]+(?=\s*(?:<|$))", name)
        return {"type": text, "type_name": m[0] if m and "|" not in name and "&" not in name else None, "type_array": array}

    # --- small parts --------------------------------------------------------------------------------------------------
    def decorators(self, i: int) -> tuple[list[dict], int]:
        found = []
        while self.is_(i, "@"):
            j = i + 2
            while self.is_(j, "."):
                j += 2
            name, positional, keyword, end = self.source(i + 1, j), [], {}, j
            if self.is_(j, "("):
                end, k = self.past(j), j + 1
                while k < end - 1:
                    e = self.expression_end(k)
                    if self.is_(k, "{"):
                        a = k + 1
                        while a < self.partner[k]:
                            b = self.expression_end(a)
                            if self.is_(a + 1, ":"):
                                keyword[self.at(a).text.strip("'\"")] = self.source(a + 2, b) or ""
                            elif self.at(a).kind == "name":
                                keyword[self.at(a).text] = self.source(a, b) or ""
                            a = b + 1
                    else:
                        positional.append(self.source(k, e))
                    k = e + 1
            found.append({"name": name.split(".")[-1], "qualified_name": name, "positional_arguments": positional, "keyword_arguments": keyword} | self.span(i, end))
            i = end
        return found, i

    def modifiers(self, i: int) -> tuple[set[str], int]:
        found = set()
        while self.at(i).text in MODIFIERS and self.at(i).kind == "name" and not self.is_(i + 1, "(", ":", "=", ";", "?", "!", ",", ")", "<", "}"):
            found.add(self.at(i).text)
            i += 1
        return found, i

    def type_parameters(self, i: int) -> tuple[list[dict], int]:
        if not self.is_(i, "<") or not (end := self.angles(i)):
            return [], i
        found, k = [], i + 1
        while k < end - 1:
            while self.is_(k, "const", "in", "out"):
                k += 1
            one = {"name": self.at(k).text, "constraint": None, "default": None}
            k += 1
            if self.is_(k, "extends"):
                e = self.type_end(k + 1)
                one["constraint"], k = self.source(k + 1, e), e
            if self.is_(k, "="):
                e = self.type_end(k + 1)
                one["default"], k = self.source(k + 1, e), e
            found.append(one)
            k += 1
        return found, end

    def parameters(self, i: int) -> list[dict]:
        """The parameters between the bracket at i and its partner."""
        found, end, k = [], self.partner[i], i + 1
        while k < end:
            first = k
            decorators, k = self.decorators(k)
            flags, k = self.modifiers(k)
            rest = self.is_(k, "...")
            k += rest
            a, k = k, self.past(k)
            name, optional = self.source(a, k), self.is_(k, "?")
            k += optional
            ref = {"type": None, "type_name": None, "type_array": False}
            if self.is_(k, ":"):
                e = self.type_end(k + 1)
                ref, k = self.type_ref(k + 1, e), e
            default = None
            if self.is_(k, "="):
                e = self.expression_end(k + 1)
                default, k = self.source(k + 1, e), e
            access = next((x for x in ("public", "private", "protected") if x in flags), None)
            found.append(ref | {"name": name, "default_value": default, "is_optional": optional or default is not None, "is_rest": rest, "is_readonly": "readonly" in flags, "accessibility": access, "decorators": decorators} | self.span(first, k))
            k += 1
        return [p for p in found if p["name"] != "this"]

    # --- callables ----------------------------------------------------------------------------------------------------
    def callable(self, first: int, name: str, kind: str, scope: list[str], owner_kind: str, params: list[dict], body: tuple[int, int] | None, end: int, flags: set[str], **more) -> str:
        """Emits a callable and walks its body; ``scope`` goes from the module to the owner."""
        signature = f"{scope[-1]}.{name}"
        concise = bool(body) and not self.is_(body[0], "{")
        ref = more.pop("ref", None) or {"type": None, "type_name": None, "type_array": False}
        at = self.span(more.pop("at", first), end)
        accessor = kind if kind in ("getter", "setter") else None
        overload = not body and not accessor and owner_kind != "interface" and not self.ambient and not flags & {"abstract", "declare"}
        complexity = 0
        if not overload:
            for p in params:
                if re.fullmatch(r"[\w$]+", p["name"] or ""):
                    self.binding([*scope, signature], p["name"], type_name=p["type_name"], type_array=p["type_array"] and not p["is_rest"])
        if body:
            complexity = 1 + self.body(*body, [*scope, signature], concise)
        row = {
            "signature": signature, "map_key": signature + ({"getter": "#get", "setter": "#set"}.get(kind, "")), "name": name, "kind": kind,
            "owner_signature": scope[-1], "owner_kind": owner_kind, "depth": len(scope), "path": self.file, "parameters": params,
            "return_type": ref["type"], "return_name": ref["type_name"], "return_array": ref["type_array"],
            "code": (self.source(first, end) or "")[:20_000], "docstring": self.docstring(first),
            "code_start_line": self.line(self.at(first).start), "cyclomatic_complexity": complexity,
            "accessibility": next((x for x in ("public", "private", "protected") if x in flags), None),
            "is_static": "static" in flags, "is_abstract": "abstract" in flags, "is_async": "async" in flags, "is_exported": "export" in flags,
            "is_ambient": self.ambient or "declare" in flags, "is_implicit": False, "is_readonly": False, "accessor_kind": accessor,
            "has_body": bool(body), "order": self.at(first).start, "function_line": at["start_line"], "function_column": at["start_column"],
        }
        row |= {"decorators": [], "type_parameters": [], "is_generator": False, "is_optional": False} | more | self.span(first, end)
        if overload:
            self.pending.setdefault(signature, []).append(row)
            return signature
        kept = ("parameters", "return_type", "type_parameters", "start_line", "end_line")
        row["overloads"] = [{k: o[k] for k in kept} for o in self.pending.pop(signature, [])] if body else []
        self.emit("callable", **row)
        return signature

    def function_like(self, i: int) -> dict:
        """From type parameters or the parameter list at i: parameters, return type, body and end."""
        types, i = self.type_parameters(i)
        params, i = self.parameters(i), self.past(i)
        ref = None
        if self.is_(i, ":"):
            e = self.type_end(i + 1)
            ref, i = self.type_ref(i + 1, e), e
        return {"types": types, "params": params, "ref": ref, "at": i}

    def arrow(self, i: int) -> dict | None:
        """An arrow function or function expression that starts at i."""
        first, flags = i, set()
        if self.is_(i, "async") and not self.is_(i + 1, "=>"):
            flags, i = {"async"}, i + 1
        if self.is_(i, "function"):
            generator = self.is_(i + 1, "*")
            i += 1 + generator
            i += self.at(i).kind == "name"
            if not self.is_(i, "(", "<"):
                return None
            f = self.function_like(i)
            return f | {"kind": "function_expression", "flags": flags, "body": (f["at"], self.past(f["at"])), "end": self.past(f["at"]), "generator": generator}
        if self.at(i).kind == "name" and self.is_(i + 1, "=>"):
            p = {"name": self.at(i).text, "type": None, "type_name": None, "type_array": False, "default_value": None, "is_optional": False, "is_rest": False, "is_readonly": False, "accessibility": None, "decorators": []} | self.span(i, i + 1)
            f = {"types": [], "params": [p], "ref": None, "at": i + 1}
        elif self.is_(i, "(") or self.is_(i, "<") and (e := self.angles(i)) and self.is_(e, "("):
            j = i if self.is_(i, "(") else self.angles(i)
            k = self.past(j)
            if not (self.is_(k, "=>") or self.is_(k, ":") and self.is_(self.type_end(k + 1), "=>")):
                return None
            f = self.function_like(i)
        else:
            return None
        if not self.is_(f["at"], "=>"):
            return None
        b = f["at"] + 1
        end = self.past(b) if self.is_(b, "{") else self.expression_end(b)
        return f | {"kind": "arrow", "flags": flags, "body": (b, end), "end": end, "generator": False, "first": first}

    # --- expressions --------------------------------------------------------------------------------------------------
    def chain_start(self, k: int) -> int:
        """The first token of the callee whose last token is k - 1."""
        i = k
        while i > 0:
            x = self.at(i - 1)
            if x.text in (")", "]") and i - 1 in self.partner:
                i = self.partner[i - 1]
                if i > 0 and (self.at(i - 1).kind == "name" and self.at(i - 1).text not in NOT_CALLED or self.at(i - 1).text in (")", "]", "?.")):
                    continue
            elif x.text in ("?.", "!"):
                i -= 1
                continue
            elif x.kind in ("name", "string", "template", "regex", "number"):
                i -= 1
            else:
                return i
            if self.is_(i - 1, ".", "?."):
                i -= 1
                continue
            if self.is_(i - 1, "new"):
                i -= 1
            return i
        return i

    def chain(self, i: int, j: int) -> dict | None:
        """The expression of tokens i to j - 1 as a root and steps (member, called, element); None if it is something else."""
        while self.is_(i, "await") or self.is_(i, "(") and self.partner[i] == j - 1:
            i, j = (i + 1, j) if self.is_(i, "await") else (i + 1, j - 1)
        steps: list[dict] = []
        if self.is_(i, "new"):
            k = i + 1
            while self.at(k).kind == "name" or self.is_(k, "."):
                k += 1
            root, steps = "new", [{"member": self.source(i + 1, k), "called": True, "element": False}]
            if self.is_(k, "<") and (e := self.angles(k)):
                k = e
            k = self.past(k) if self.is_(k, "(") else k
        elif self.at(i).kind == "name" and self.at(i).text not in NOT_CALLED:
            root, k = self.at(i).text, i + 1
        else:
            return None
        while k < j:
            if self.is_(k, "<") and (e := self.angles(k)) and self.is_(e, "("):
                k = e
            elif self.is_(k, "("):
                if steps and not steps[-1]["called"]:
                    steps[-1]["called"] = True
                elif not steps:
                    steps.append({"member": "", "called": True, "element": False})
                else:
                    return None
                k = self.past(k)
            elif self.is_(k, ".", "?.") and self.at(k + 1).kind == "name":
                steps.append({"member": self.at(k + 1).text, "called": False, "element": False})
                k += 2
            elif self.is_(k, "["):
                steps.append({"member": "", "called": False, "element": True})
                k = self.past(k)
            elif self.is_(k, "!", "?."):
                k += 1
            else:
                return None
        return {"root": root, "steps": steps}

    def binding(self, scope: list[str], name: str, type_name: str | None = None, type_array: bool = False, chain: dict | None = None, element: bool = False) -> None:
        self.emit("binding", scope=scope[-1], scopes=scope, name=name, type_name=type_name, type_array=type_array, root=(chain or {}).get("root"), steps=(chain or {}).get("steps", []), element=element)

    def call(self, opening: int, scope: list[str], start: int | None = None) -> None:
        """Records the call whose argument list opens at ``opening``."""
        self.done.add(opening)
        k = opening
        types: list[str] = []
        if self.is_(k - 1, ">"):
            a = k - 1
            depth = 0
            while a >= 0:
                depth += self.is_(a, ">") - self.is_(a, "<")
                if depth == 0:
                    break
                a -= 1
            types, k = [self.source(a + 1, k - 1) or ""], a
        i = self.chain_start(k) if start is None else start
        new, end = self.is_(i, "new"), self.past(opening)
        c = self.chain(i, end)
        arguments, a = [], opening + 1
        while a < self.partner[opening]:
            e = self.expression_end(a)
            if e == a:
                break
            arguments.append((a, e))
            a = e + 1
        name = c["steps"][-1]["member"] or c["root"] if c else self.at(k - 1).text
        if new:
            name = c["steps"][0]["member"].split(".")[-1] if c else name
        dot = k - 2 if self.is_(k - 2, ".", "?.") else None
        receiver = (self.source(i + 1, k - 2) if k - 2 > i + 1 else None) if new else self.source(i, dot) if dot and dot > i else None
        self.emit(
            "call_site", caller=scope[-1], scopes=scope, method_name=name, receiver_expr=receiver, argument_texts=[self.source(a, b) for a, b in arguments], argument_types=[self.literal_type(a, b) for a, b in arguments], type_arguments=types, is_constructor_call=new,
            is_optional_chain=any(self.is_(x, "?.") for x in range(i, k)) or self.is_(opening - 1, "?."), root=c["root"] if c else None, steps=c["steps"] if c else [], order=self.at(i).start,
            required=self.required(i) if c and c["root"] == "require" else None, **self.span(i, end),
        )
        if c and arguments and len(c["steps"]) > 0 and name in ARRAY_CALLBACKS:
            f = self.arrow(arguments[0][0])
            if f and f["params"] and re.fullmatch(r"[\w$]+", f["params"][0]["name"]) and not f["params"][0]["type"]:
                self.binding(scope, f["params"][0]["name"], chain={"root": c["root"], "steps": c["steps"][:-1]}, element=True)

    def literal_type(self, i: int, j: int) -> str:
        """The type of an argument that its text alone tells."""
        x = self.at(i)
        if self.is_(i, "new"):
            k = i + 1
            while self.at(k).kind == "name" or self.is_(k, "."):
                k += 1
            return self.source(i + 1, k) or "unknown"
        if j == i + 1 and x.kind == "name":
            return {"true": "boolean", "false": "boolean", "null": "null", "undefined": "undefined"}.get(x.text, "unknown")
        if j == i + 1 or x.kind == "template" and self.at(j - 1).kind == "template":
            return {"number": "bigint" if x.text.endswith("n") and not x.text.startswith("0x") else "number", "string": "string", "template": "string", "regex": "RegExp"}.get(x.kind, "unknown")
        return "number" if j == i + 2 and self.is_(i, "-", "+") and self.at(i + 1).kind == "number" else "unknown"

    def required(self, i: int) -> str | None:
        return self.at(i + 2).text[1:-1] if self.is_(i, "require") and self.is_(i + 1, "(") and self.at(i + 2).kind == "string" else None

    def body(self, i: int, j: int, scope: list[str], concise: bool = False) -> int:
        """Walks tokens i to j - 1 and returns the number of decisions."""
        skipped = None
        decisions = 0
        if concise:
            depth0, k = [], i
            while k < j:
                depth0.append(k)
                k = self.past(k)
            if self.is_(depth0[-1], "(") and self.past(depth0[-1]) == j and (self.chain_start(depth0[-1]) == i or self.is_(i, "new")):
                skipped = depth0[-1]
            operators = [self.at(k).text for k in depth0 if self.at(k).kind == "mark"]
            decisions -= "=>" not in operators and any(x in operators for x in ("?", "&&", "||", "??"))
        loops = set()
        k = i
        while k < j:
            x = self.at(k)
            member = self.is_(k - 1, ".", "?.")
            if x.kind == "name" and not member:
                statement = self.is_(k - 1, ";", "{", "}", ")", "async", "export", "default", "else") or k == i
                if x.text == "function" and statement and (self.at(k + 1).kind == "name" or self.is_(k + 1, "*")):
                    k = self.function(k, scope, {"async"} if self.is_(k - 1, "async") else set())
                    continue
                if x.text == "class" and not self.is_(k + 1, ":", ",", ")") and (self.at(k + 1).kind == "name" or self.is_(k + 1, "{")):
                    k = self.class_(k, scope, set(), [])
                    continue
                if x.text in ("namespace", "module") and self.at(k + 1).kind == "name" and self.is_(k + 2, "{"):
                    k = self.past(k + 2)
                    continue
                if x.text in ("const", "let", "var") and (self.at(k + 1).kind == "name" or self.is_(k + 1, "{", "[")) and not (x.text == "const" and self.is_(k + 1, "enum")):
                    k, initializers = self.variables(k, scope, "function", set())
                    decisions += sum(self.body(a, b, scope) for a, b in initializers)
                    continue
                if x.text == "do" and self.is_(k + 1, "{"):
                    loops.add(self.past(k + 1))
                if x.text == "new" and not self.is_(k + 1, "."):
                    a = k + 1
                    while self.at(a).kind == "name" or self.is_(a, "."):
                        a += 1
                    if self.is_(a, "<") and (e := self.angles(a)):
                        a = e
                    if self.is_(a, "(") and a != skipped:
                        self.call(a, scope, k)
                    elif self.is_(a, "("):
                        self.done.add(a)
                if x.text in DECISIONS and k not in loops and not self.is_(k + 1, ":"):
                    decisions += 1
            elif x.kind == "mark":
                if x.text in ("&&", "||", "??") or x.text == "?" and not self.is_(k + 1, ":", ",", ")", "="):
                    decisions += 1
                if x.text == "(" and k not in self.done and k != skipped and k > i:
                    before = self.at(k - 1)
                    after = self.past(k)
                    named = before.kind == "name" and (before.text not in NOT_CALLED or self.is_(k - 2, ".", "?.")) and not self.is_(k - 2, "function")
                    generic = before.text == ">" and self.called_with_types(k)
                    method = named and self.is_(after, "{") and not self.is_(k - 2, ".", "?.") and self.is_(k - 2, "{", ",", "async", "get", "set")
                    arrow = self.is_(after, "=>") or before.text == "async" and self.is_(after, ":")
                    if (named or generic or before.text in (")", "]", "?.") and not self.is_(after, "=>") and self.is_callee(k)) and not method and not arrow:
                        self.call(k, scope)
            k += 1
        return decisions

    def is_callee(self, k: int) -> bool:
        """Whether the bracket at k follows a value: not the head of a statement such as ``if (x) (y)``."""
        if self.is_(k - 1, "?."):
            return True
        a = self.partner.get(k - 1)
        return a is not None and not self.is_(a - 1, "if", "for", "while", "switch", "catch")

    def called_with_types(self, k: int) -> bool:
        depth, a = 0, k - 1
        while a >= 0:
            depth += self.is_(a, ">") - self.is_(a, "<")
            if depth == 0:
                return self.at(a - 1).kind == "name" and self.angles(a) == k
            if self.is_(a, ";", "{", "}", ")", "&&", "||"):
                return False
            a -= 1
        return False

    # --- declarations -------------------------------------------------------------------------------------------------
    def variables(self, i: int, scope: list[str], kind: str, flags: set[str]) -> tuple[int, list[tuple[int, int]]]:
        """Declarators from the keyword at i. Returns where they end and, for bodies, the initializers to walk."""
        word, k = self.at(i).text, i + 1
        inside, walked = kind == "function", []
        while True:
            first = k
            k = self.past(k)
            name, ref = self.source(first, k), {"type": None, "type_name": None, "type_array": False}
            if self.is_(k, "!"):
                k += 1
            if self.is_(k, ":"):
                e = self.type_end(k + 1)
                ref, k = self.type_ref(k + 1, e), e
            plain = re.fullmatch(r"[\w$]+", name or "") is not None
            if self.is_(k, "of", "in"):
                e = self.expression_end(k + 1)
                self.emit("variable", owner=scope[-1], name=name, scope=kind, declaration_kind="unknown", is_readonly=False, is_exported=False, initializer=None, value=None, **ref, **self.span(first, k))
                if plain and self.is_(k, "of"):
                    self.binding(scope, name, ref["type_name"], ref["type_array"], self.chain(k + 1, e), True)
                return k, walked
            if not self.is_(k, "="):
                self.emit("variable", owner=scope[-1], name=name, scope=kind, declaration_kind=word, is_readonly=word == "const", is_exported="export" in flags, initializer=None, value=None, **ref, **self.span(first, k))
                if plain:
                    self.binding(scope, name, ref["type_name"], ref["type_array"])
                if self.is_(k, ","):
                    k += 1
                    continue
                return k, walked
            e = self.expression_end(k + 1)
            start, f = k + 1, self.arrow(k + 1)
            if f and plain:
                self.callable(first, name, f["kind"], scope, "function" if inside else kind, f["params"], f["body"], f["end"], flags | f["flags"], at=start, ref=f["ref"] or None, type_parameters=f["types"], is_generator=f["generator"])
                k = f["end"]
            else:
                self.emit("variable", owner=scope[-1], name=name, scope=kind, declaration_kind=word, is_readonly=word == "const", is_exported="export" in flags, initializer=self.source(k + 1, e), value=None, **ref, **self.span(first, e))
                c = self.chain(k + 1, e)
                if plain:
                    self.binding(scope, name, ref["type_name"], ref["type_array"], None if ref["type_name"] else c)
                if not inside and c and c["root"] == "require" and (m := self.required(k + 1)):
                    self.requires(first, m, c["steps"][1]["member"] if len(c["steps"]) > 1 else None)
                if inside:
                    walked.append((k + 1, e))
                else:
                    self.news(k + 1, e, scope)
                k = e
            if self.is_(k, ","):
                k += 1
                continue
            return k, walked

    def requires(self, first: int, module: str, member: str | None) -> None:
        if self.is_(first, "{"):
            k = first + 1
            while k < self.partner[first]:
                local = self.at(k + 2).text if self.is_(k + 1, ":") else self.at(k).text
                self.emit("require", local=local, module=module, member=self.at(k).text, namespace=False)
                k = self.expression_end(k) + 1
        else:
            self.emit("require", local=self.at(first).text, module=module, member=member, namespace=member is None)

    def news(self, i: int, j: int, scope: list[str]) -> None:
        """``new`` expressions outside callables: they count as instantiations, not as calls."""
        for k in range(i, j):
            if self.is_(k, "new") and self.at(k + 1).kind == "name" and not self.is_(k - 1, "."):
                a = k + 1
                while self.at(a).kind == "name" or self.is_(a, "."):
                    a += 1
                self.emit("new_expr", scopes=scope, type_name=self.source(k + 1, a), **self.span(k, a))

    def function(self, i: int, scope: list[str], flags: set[str], owner_kind: str = "function", decorators: list | None = None) -> int:
        generator = self.is_(i + 1, "*")
        k = i + 1 + generator
        name = self.at(k).text if self.at(k).kind == "name" else "default" if "default" in flags else "(anonymous)"
        k += self.at(k).kind == "name"
        f = self.function_like(k)
        body = (f["at"], self.past(f["at"])) if self.is_(f["at"], "{") else None
        self.callable(i, name, "function", scope, owner_kind, f["params"], body, body[1] if body else f["at"], flags, at=i - self.is_(i - 1, "async"), ref=f["ref"], type_parameters=f["types"], is_generator=generator, decorators=decorators or [])
        return body[1] if body else f["at"]

    def declaration(self, first: int, end: int, kind: str, name: str, scope: list[str], flags: set[str], **more) -> None:
        signature = f"{scope[-1]}.{name}"
        self.emit("declaration", **({"base_classes": [], "implements_types": [], "type_parameters": [], "members": [], "decorators": [], "call_signatures": [], "index_signatures": [], "aliased_type": None, "is_const": False} | more),
            signature=signature, map_key=signature, kind=kind, owner_signature=scope[-1], scopes=scope, depth=len(scope), name=name, code=(self.source(first, end) or "")[:20_000], docstring=self.docstring(first), is_abstract="abstract" in flags,
            is_exported="export" in flags, is_ambient=self.ambient or "declare" in flags, order=self.at(first).start, **self.span(first, end))

    def heritage(self, k: int, stop: int) -> tuple[list[str], int]:
        found = []
        while k < stop:
            e = k
            while self.at(e).kind == "name" and not self.is_(e, "implements", "extends") or self.is_(e, "."):
                e += 1
            found.append(self.source(k, e) or "")
            if self.is_(e, "<"):
                e = self.angles(e) or e + 1
            elif self.is_(e, "("):
                e = self.past(e)
            if not self.is_(e, ","):
                return [x for x in found if x], e
            k = e + 1
        return found, k

    def class_(self, i: int, scope: list[str], flags: set[str], decorators: list[dict]) -> int:
        k = i + 1
        name = self.at(k).text if self.at(k).kind == "name" and not self.is_(k, "extends", "implements") else "default" if "default" in flags else "(anonymous)"
        k += name == self.at(k).text
        types, k = self.type_parameters(k)
        bases, implemented = [], []
        while not self.is_(k, "{") and k < len(self.t):
            if self.is_(k, "extends"):
                bases, k = self.heritage(k + 1, len(self.t))
            elif self.is_(k, "implements"):
                implemented, k = self.heritage(k + 1, len(self.t))
            else:
                k = self.past(k)
        end, inner = self.past(k), [*scope, f"{scope[-1]}.{name}"]
        self.declaration(i, end, "class", name, scope, flags, base_classes=[*bases, *implemented], implements_types=implemented, type_parameters=types, decorators=decorators, extends_types=bases)
        self.members(k, inner, "class", "declare" in flags)
        return end

    def members(self, opening: int, scope: list[str], owner_kind: str, ambient: bool = False) -> list[str]:
        """Members of a class or an interface. Returns call and index signatures."""
        k, end, other = opening + 1, self.partner[opening], []
        attributes: dict[str, dict] = {}
        constructor = False
        while k < end:
            if self.is_(k, ";", ","):
                k += 1
                continue
            first = k
            decorators, k = self.decorators(k)
            flags, k = self.modifiers(k)
            flags |= {"declare"} if ambient else set()
            if self.is_(k, "{"):
                k = self.past(k)
                continue
            kind, generator = "method", self.is_(k, "*")
            k += generator
            if self.is_(k, "get", "set") and not self.is_(k + 1, "(", ":", "=", ";", "?", "<", "!", "}"):
                kind, k = {"get": "getter", "set": "setter"}[self.at(k).text], k + 1
            if self.is_(k, "(", "<") or self.is_(k, "new") and self.is_(k + 1, "("):
                f = self.function_like(k + self.is_(k, "new"))
                other.append(self.source(first, f["at"]))
                k = f["at"]
                continue
            if self.is_(k, "[") and self.at(k + 1).kind == "name" and self.is_(k + 2, ":", "in"):
                k = self.past(k)
                k = self.type_end(k + 1) if self.is_(k, ":") else k
                other.append(self.source(first, k))
                continue
            a, k = k, self.past(k)
            name, optional = (self.source(a, k) or "").strip("'\""), self.is_(k, "?")
            k += optional or self.is_(k, "!")
            if self.is_(k, "(", "<"):
                f = self.function_like(k)
                body = (f["at"], self.past(f["at"])) if self.is_(f["at"], "{") else None
                k = body[1] if body else f["at"]
                if name == "constructor" and owner_kind == "class":
                    kind, constructor = "constructor", True
                    for p in f["params"]:
                        if p["accessibility"] or p["is_readonly"]:
                            attributes[p["name"]] = {x: p[x] for x in ("type", "type_name", "type_array", "accessibility", "is_readonly", "is_optional", "decorators", "start_line", "start_column", "end_line", "end_column")} | {"initializer": p["default_value"], "is_static": False, "is_abstract": False}
                self.callable(first, name, kind, scope, owner_kind, f["params"], body, k, flags, ref=f["ref"], type_parameters=f["types"], is_generator=generator, is_optional=optional, decorators=decorators)
                continue
            ref, initializer, chain = {"type": None, "type_name": None, "type_array": False}, None, None
            if self.is_(k, ":"):
                e = self.type_end(k + 1)
                ref, k = self.type_ref(k + 1, e), e
            if self.is_(k, "="):
                e = self.expression_end(k + 1, (",", ";") if owner_kind == "interface" else (";",))
                initializer, chain = self.source(k + 1, e), self.chain(k + 1, e)
                self.news(k + 1, e, scope)
                k = e
            if chain and chain["root"] == "new" and not ref["type_name"]:
                ref = ref | {"type_name": chain["steps"][0]["member"]}
            attributes[name] = ref | {"initializer": initializer, "accessibility": next((x for x in ("public", "private", "protected") if x in flags), None), "is_static": "static" in flags, "is_readonly": "readonly" in flags, "is_optional": optional, "is_abstract": "abstract" in flags, "decorators": decorators} | self.span(first, k)
            if k == first:
                k += 1
        for name, one in attributes.items():
            self.emit("attribute", owner=scope[-1], name=name, **one)
        if owner_kind == "class" and not constructor and not ambient:
            none = {"start_line": -1, "end_line": -1, "start_column": -1, "end_column": -1}
            self.emit("callable", signature=f"{scope[-1]}.constructor", map_key=f"{scope[-1]}.constructor", name="constructor", kind="constructor", owner_signature=scope[-1], owner_kind="class", depth=len(scope), path=self.file, parameters=[], return_type=None,
                return_name=None, return_array=False, code=None, docstring=None, code_start_line=-1, cyclomatic_complexity=0, accessibility=None, is_static=False, is_abstract=False, is_async=False, is_exported=False, is_ambient=self.ambient, is_implicit=True,
                is_readonly=False, accessor_kind=None, has_body=False, order=self.at(opening).start, decorators=[], type_parameters=[], is_generator=False, is_optional=False, **none)
        return other

    def interface(self, i: int, scope: list[str], flags: set[str]) -> int:
        name, (types, k) = self.at(i + 1).text, self.type_parameters(i + 2)
        bases = []
        if self.is_(k, "extends"):
            bases, k = self.heritage(k + 1, len(self.t))
        end = self.past(k)
        other = self.members(k, [*scope, f"{scope[-1]}.{name}"], "interface")
        self.declaration(i, end, "interface", name, scope, flags, base_classes=bases, extends_types=bases, type_parameters=types, call_signatures=[x for x in other if not x.startswith("[")], index_signatures=[x for x in other if x.startswith("[")])
        return end

    def enum(self, i: int, scope: list[str], flags: set[str], const: bool) -> int:
        name, k = self.at(i + 1).text, i + 3
        end, members = self.past(i + 2), []
        known: dict[str, str | float] = {}
        following: float | None = 0
        while k < end - 1:
            e = self.expression_end(k)
            label = self.at(k).text.strip("'\"")
            if self.is_(k + 1, "="):
                value = Constant(self, name, known).value(k + 2, e)
                text = self.source(k + 2, e) if value is None else spelled(value)
                following = value + 1 if isinstance(value, (int, float)) else None
            else:
                value = following
                text = None if following is None else spelled(following)
                following = None if following is None else following + 1
            if value is not None:
                known[label] = value
            members.append({"name": label, "value": text})
            k = e + 1
        self.declaration(i, end, "enum", name, scope, flags, members=members, is_const=const)
        return end

    def statements(self, i: int, j: int, scope: list[str], kind: str) -> None:
        """Declarations of a module or a namespace."""
        k = i
        while k < j:
            first = k
            if len(scope) == 1:
                self.top.append(k)
            decorators, k = self.decorators(k)
            flags, k = self.modifiers(k)
            const = self.is_(k, "const") and self.is_(k + 1, "enum")
            if "default" in flags and not self.is_(k, "interface"):
                named = k + 1 if self.is_(k, "function", "class") else k
                named += self.is_(named, "*")
                self.emit("default_export", name=self.at(named).text if self.at(named).kind == "name" else "default")
            if self.is_(k, "function"):
                k = self.function(k, scope, flags, kind, decorators)
            elif self.is_(k, "class"):
                k = self.class_(k, scope, flags, decorators)
            elif self.is_(k, "interface") and self.at(k + 1).kind == "name":
                k = self.interface(k, scope, flags)
            elif const or self.is_(k, "enum") and self.at(k + 1).kind == "name":
                k = self.enum(k + const, scope, flags, const)
            elif self.is_(k, "type") and self.at(k + 1).kind == "name" and self.is_(k + 2, "=", "<"):
                types, e = self.type_parameters(k + 2)
                end = self.type_end(e + 1)
                self.declaration(k, end, "type_alias", self.at(k + 1).text, scope, flags, type_parameters=types, aliased_type=self.source(e + 1, end))
                k = end
            elif self.is_(k, "namespace", "module") and self.at(k + 1).kind in ("name", "string") and not self.is_(k + 1, "="):
                e = k + 2
                while self.is_(e, "."):
                    e += 2
                if self.is_(e, "{"):
                    name = (self.source(k + 1, e) or "").strip("'\"")
                    self.declaration(k, self.past(e), "namespace", name, scope, flags)
                    self.statements(e + 1, self.partner[e], [*scope, f"{scope[-1]}.{name}"], "namespace")
                    e = self.past(e)
                k = e
            elif self.is_(k, "const", "let", "var", "using"):
                k, _ = self.variables(k, scope, kind, flags)
            elif self.is_(k, "import") and not self.is_(k + 1, "(", "."):
                k = self.import_(k)
            elif "export" in flags and self.is_(k, "{", "*", "type"):
                k = self.export(first, k)
            elif "export" in flags and "default" in flags and (f := self.arrow(k)):
                self.callable(k, "default", f["kind"], scope, kind, f["params"], f["body"], f["end"], flags | f["flags"], ref=f["ref"], type_parameters=f["types"], is_generator=f["generator"])
                k = f["end"]
            else:
                if self.is_(k, "export"):
                    k = self.export(k, k + 1)
                    continue
                end = max(k + 1, self.expression_end(k, (";",)))
                self.news(k, end, scope)
                k = end

    def import_(self, i: int) -> int:
        k, types = i + 1, False
        if self.is_(k, "type") and not self.is_(k + 1, "from", ","):
            types, k = True, k + 1
        names: list[tuple[str, str | None, str, bool]] = []
        while k < len(self.t) and self.at(k).kind != "string" and not self.is_(k, ";", "="):
            if self.is_(k, "*"):
                names.append(("*", self.at(k + 2).text, "namespace", types))
                k += 3
            elif self.is_(k, "{"):
                a, end = k + 1, self.partner[k]
                while a < end:
                    only = self.is_(a, "type") and not self.is_(a + 1, ",", "}", "as")
                    a += only
                    alias = self.at(a + 2).text if self.is_(a + 1, "as") else None
                    names.append((self.at(a).text, alias, "named", types or only))
                    a += (3 if alias else 1) + 1
                k = end + 1
            elif self.is_(k, "from", ","):
                k += 1
            else:
                names.append((self.at(k).text, None, "default", types))
                k += 1
        if self.at(k).kind != "string":
            return self.expression_end(k, (";",))
        module, span = self.at(k).text[1:-1], self.span(i, k + 1)
        for name, alias, kind, only in names or [("", None, "side_effect", False)]:
            self.emit("import", module=module, name=name, alias=alias, is_type_only=only, import_kind=kind, local=alias or name, target=self.target(module), order=self.at(i).start, **span)
        return k + 1

    def target(self, module: str) -> str | None:
        """The module prefix that a relative specifier names."""
        if not module.startswith("."):
            return None
        path = posixpath.normpath(posixpath.join(posixpath.dirname(self.file), module))
        return re.sub(r"\.(?:tsx|ts|jsx|js|mts|cts|mjs|cjs)$", "", re.sub(r"\.d\.ts$", "", path))

    def export(self, first: int, k: int) -> int:
        types = self.is_(k, "type")
        k += types
        names: list[tuple[str, str | None, str]] = []
        if self.is_(k, "*"):
            alias = self.at(k + 2).text if self.is_(k + 1, "as") else None
            names.append(("*", alias, "namespace" if alias else "re_export"))
            k += 3 if alias else 1
        elif self.is_(k, "{"):
            a, end = k + 1, self.partner[k]
            while a < end:
                a += self.is_(a, "type") and not self.is_(a + 1, ",", "}", "as")
                alias = self.at(a + 2).text if self.is_(a + 1, "as") else None
                names.append((self.at(a).text, alias, "named"))
                a += (3 if alias else 1) + 1
            k = end + 1
        else:
            return max(k + 1, self.expression_end(k, (";",)))
        module = self.at(k + 1).text[1:-1] if self.is_(k, "from") else None
        k += 2 * (module is not None)
        for name, alias, kind in names:
            self.emit("export", module=module, name=name, alias=alias, is_type_only=types, export_kind="re_export" if module and kind == "named" else kind, target=self.target(module) if module else None, order=self.at(first).start, **self.span(first, k))
        return k

    def leading(self) -> list[Token]:
        """The comments before the module's own statements; one on the line where the token before it ends trails that."""
        found = []
        for i in self.top:
            before = self.at(i - 1).end if i else 0
            for c in self.comments[bisect.bisect_left(self.comments, before, key=lambda c: c.start) :]:
                if c.start >= self.at(i).start:
                    break
                if not i or "\n" in self.text[before : c.start]:
                    found.append(c)
        return found

    def run(self) -> list[tuple[str, dict]]:
        self.statements(0, len(self.t), [self.module], "module")
        for rows in self.pending.values():
            for row in rows:
                self.emit("callable", **row, overloads=[])
        comments = []
        for c in self.leading():
            la, lb = self.line(c.start), self.line(c.end)
            comments.append({"content": c.text, "is_docstring": c.text.startswith("/**"), "start_line": la, "start_column": c.start - self.lines[la - 1] + 1, "end_line": lb, "end_column": c.end - self.lines[lb - 1] + 1})
        self.emit("module", module_name=self.module, is_tsx=self.file.endswith(".tsx"), is_declaration_file=self.ambient, comments=comments)
        return self.rows


def spelled(value: str | float) -> str:
    """A constant as text: whole numbers without a point."""
    return value if isinstance(value, str) else str(int(value)) if float(value).is_integer() else repr(value)


def whole(value: float) -> int:
    """A number as the signed 32 bits that bit operators take."""
    return (int(value) + (1 << 31)) % (1 << 32) - (1 << 31)


class Constant:
    """The value of a constant expression in an enum: numbers, strings, members before it, and operators."""

    # What binds weaker comes first.
    LEVELS = [("|",), ("^",), ("&",), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",)]

    def __init__(self, parser: Parser, name: str, known: dict[str, str | float]):
        self.p, self.name, self.known = parser, name, known

    def value(self, i: int, j: int) -> str | float | None:
        try:
            out, at = self.level(i, j, 0)
            return out if at == j else None
        except (ValueError, TypeError, ZeroDivisionError, OverflowError):
            return None

    def operator(self, i: int, j: int) -> str:
        """Shifts are two or three marks in a row."""
        n = next((n for n in (3, 2) if i + n <= j and all(self.p.is_(k, ">") for k in range(i, i + n)) or n == 2 and i + 2 <= j and self.p.is_(i, "<") and self.p.is_(i + 1, "<")), 1)
        return "".join(self.p.at(k).text for k in range(i, i + n)) if i < j else ""

    def level(self, i: int, j: int, depth: int) -> tuple[str | float, int]:
        if depth == len(self.LEVELS):
            return self.operand(i, j)
        left, i = self.level(i, j, depth + 1)
        while (op := self.operator(i, j)) in self.LEVELS[depth]:
            again = op == "**"
            right, i = self.level(i + (len(op) if op in ("<<", ">>", ">>>") else 1), j, depth if again else depth + 1)
            left = self.applied(op, left, right)
        return left, i

    def applied(self, op: str, a: str | float, b: str | float) -> str | float:
        if op == "+" and (isinstance(a, str) or isinstance(b, str)):
            return spelled(a) + spelled(b)
        if isinstance(a, str) or isinstance(b, str):
            raise TypeError(op)
        bits = {"|": lambda: whole(a) | whole(b), "^": lambda: whole(a) ^ whole(b), "&": lambda: whole(a) & whole(b)}
        shifts = {"<<": lambda: whole(whole(a) << (whole(b) & 31)), ">>": lambda: whole(a) >> (whole(b) & 31), ">>>": lambda: whole(a) % (1 << 32) >> (whole(b) & 31)}
        plain = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "**": lambda: a**b}
        return (bits | shifts | plain)[op]()

    def operand(self, i: int, j: int) -> tuple[str | float, int]:
        x = self.p.at(i)
        if i >= j:
            raise ValueError("nothing to evaluate")
        if self.p.is_(i, "-", "+", "~"):
            v, e = self.operand(i + 1, j)
            return {"-": lambda: -v, "+": lambda: +v, "~": lambda: ~whole(v)}[x.text](), e
        if self.p.is_(i, "("):
            v, e = self.level(i + 1, self.p.partner[i], 0)
            return v, e + 1
        if x.kind == "string" or x.kind == "template" and x.text.endswith("`") and len(x.text) > 1:
            return x.text[1:-1], i + 1
        if x.kind == "number":
            text = x.text.replace("_", "")
            return (int(text, 0) if re.fullmatch(r"0[xXbBoO][\da-fA-F]+", text) else int(text) if text.isdigit() else float(text)), i + 1
        if x.kind == "name" and x.text == self.name and self.p.is_(i + 1, ".") and self.p.at(i + 2).text in self.known:
            return self.known[self.p.at(i + 2).text], i + 3
        if x.kind == "name" and x.text in self.known:
            return self.known[x.text], i + 1
        raise ValueError(x.text)


def parse(file_key: str, text: str) -> Iterator[tuple[str, str]]:
    """(record, JSON) of one file. A file that cannot be read gives one ``error`` and its bare module."""
    try:
        rows = Parser(file_key, text).run()
    except (SyntaxError, KeyError, IndexError, RecursionError) as e:
        prefix = re.sub(r"\.(?:tsx|ts|mts|cts)$", "", re.sub(r"\.d\.ts$", "", file_key))
        rows = [("error", {"message": f"{type(e).__name__}: {e}"}), ("module", {"module_name": prefix, "is_tsx": file_key.endswith(".tsx"), "is_declaration_file": file_key.endswith(".d.ts"), "comments": []})]
    for record, fields in rows:
        yield record, json.dumps(fields)
